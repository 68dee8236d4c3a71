"""Ranked search: reciprocal ranks of two retrievers, boosts by symbols, and decay by hops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.operators.dense import dense
from codelode.operators.graph import centrality, first_callees, first_callers
from codelode.operators.lexical import bm25f, top
from codelode.operators.relations import HOP_DECAY, Scope
from codelode.session import broadcast_if_small, cut

#: Fixed values of the ranking.
RANK_OFFSET, DENSE_WEIGHT, SPARSE_WEIGHT, SYMBOL_BOOST, FAN_OUT = 60, 1.0, 0.85, 0.020, 3


def ranked(best: DataFrame, score: str, rank: str) -> DataFrame:
    """(chunk_id, rank) of a list that was already cut to a few rows."""
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.round(score, 12).desc(), "chunk_id"))).select("chunk_id", rank)


def reciprocal(rank: str, weight: float) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(RANK_OFFSET) + F.col(rank)), F.lit(0.0))


def fuse(dense_list: DataFrame, sparse_list: DataFrame) -> DataFrame:
    """(chunk_id, dense_rank, sparse_rank, score): both lists put together."""
    return dense_list.join(sparse_list, "chunk_id", "full_outer").withColumn("score", reciprocal("dense_rank", DENSE_WEIGHT) + reciprocal("sparse_rank", SPARSE_WEIGHT))


def candidates(by_vector: DataFrame, by_words: DataFrame, top_k: int) -> DataFrame:
    """The fused lists of both retrievers, (chunk_id, similarity) and (chunk_id, score), each FAN_OUT times as long as the result will be."""
    n = FAN_OUT * top_k
    return fuse(ranked(top(by_vector, n, "similarity"), "similarity", "dense_rank"), ranked(top(by_words, n), "score", "sparse_rank"))


def hybrid(chunks: DataFrame, edges: DataFrame, query: str, query_vectors: DataFrame, top_k: int = 8, scope: Scope | None = None) -> DataFrame:
    """The top_k chunks for a query, from contents and vectors as they are in the table of chunks."""
    own = chunks if scope is None else scope.filter(chunks)
    return rerank(own, dense(own, query_vectors), bm25f(own, query), edges, query, top_k, scope)


def rerank(chunks: DataFrame, by_vector: DataFrame, by_words: DataFrame, edges: DataFrame, query: str, top_k: int, scope: Scope | None = None) -> DataFrame:
    """The top_k of what both retrievers found, with their ranks, score, relation and hops.

    Only the few candidates are joined with chunks, edges and scope; ties go by dense rank, sparse rank and id.
    """
    shown = chunks.select("chunk_id", "repo_id", "file_path", "symbol_name", "start_line")
    # a few dozen rows, from which all that follows is taken; without the cut both retrievers would run once for each use
    found = cut(candidates(by_vector, by_words, top_k))
    rows = cut(shown.join(F.broadcast(found), "chunk_id").dropDuplicates(["chunk_id"]))
    named = rows.where("symbol_name <> ''").select(F.col("symbol_name").alias("name"), F.col("repo_id").alias("owner"))
    boosts = centrality(edges, named)
    low, asked = F.lower("symbol_name"), F.lit(query.lower())
    hit = (F.col("symbol_name") != "") & (F.contains(low, asked) | F.contains(asked, low))
    rows = rows.join(boosts, (F.col("symbol_name") == F.col("name")) & (F.col("repo_id") == F.col("owner")), "left").drop("name", "owner")
    score = F.col("score") + F.when(hit, SYMBOL_BOOST).otherwise(0.0) + F.coalesce("centrality", F.lit(0.0))
    if scope is not None and scope.rows is not None:
        rows = rows.join(broadcast_if_small(scope.rows), "repo_id", "left")
        score = score * F.when(F.col("relation") == "expanded", F.pow(F.lit(HOP_DECAY), F.greatest(F.lit(1), "hops"))).otherwise(1.0)
    else:
        rows = rows.withColumns({"relation": F.lit("primary"), "direction": F.lit(None).cast("string"), "hops": F.lit(0)})
    rows = rows.withColumn("score", score)
    best = rows.orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "chunk_id").limit(top_k)
    return best.select("chunk_id", "repo_id", "file_path", "symbol_name", "dense_rank", "sparse_rank", F.round("score", 6).alias("score"), "relation", "direction", "hops")


def enrich(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results with the first three callers (of any repository) and callees (of their own) of their symbols."""
    results = cut(results)
    names = results.select("symbol_name").distinct()
    into = first_callers(edges.join(F.broadcast(names.withColumnRenamed("symbol_name", "target_symbol")), "target_symbol", "left_semi"))
    caller = F.struct("rank", "source_repo", "source_file", "source_symbol", "edge_type", "line_number")
    into = into.groupBy("target_symbol").agg(F.array_sort(F.collect_list(caller)).alias("related_callers"))
    sources = results.select(F.col("repo_id").alias("source_repo"), F.col("symbol_name").alias("source_symbol")).distinct()
    out = first_callees(edges.join(F.broadcast(sources), ["source_repo", "source_symbol"], "left_semi"))
    callee = F.struct("rank", "target_symbol", "target_repo", "target_file", "edge_type", "line_number")
    out = out.groupBy("source_repo", "source_symbol").agg(F.array_sort(F.collect_list(callee)).alias("related_callees"))
    return (
        results.join(into, F.col("symbol_name") == F.col("target_symbol"), "left").drop("target_symbol")
        .join(out, (F.col("repo_id") == F.col("source_repo")) & (F.col("symbol_name") == F.col("source_symbol")), "left").drop("source_repo", "source_symbol")
    )
