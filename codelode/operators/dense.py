"""Search by two vectors per chunk: its signature and its body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.vectors import similarity, vector
from codelode.operators.lexical import in_scope

SIGNATURE_WEIGHT = 0.6
LEAST = 0.05


def dense(chunks: DataFrame, query: DataFrame, repo_ids: Sequence[str] | None = None) -> DataFrame:
    """(chunk_id, similarity) of the chunks of the scope that are more than barely similar to the query.

    query has one row with the arrays query_sig and query_body. Vectors are compared where they are read; only
    ids and similarities are shuffled, to drop repeated rows.
    """
    own = in_scope(chunks, repo_ids).select("chunk_id", vector(F.col("sig_embedding_json")).alias("sig"), vector(F.col("body_embedding_json")).alias("body"))
    return dense_stored(own, query).dropDuplicates(["chunk_id"])


def dense_stored(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """The same for chunks whose vectors (sig, body) are stored as arrays, once per chunk."""
    score = SIGNATURE_WEIGHT * similarity(F.col("sig"), F.col("query_sig")) + (1 - SIGNATURE_WEIGHT) * similarity(F.col("body"), F.col("query_body"))
    return vectors.join(F.broadcast(query.limit(1))).select("chunk_id", score.alias("similarity")).where(F.col("similarity") > LEAST)


def vectors_of(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The vectors of a chunk as a query."""
    return chunks.where(F.col("chunk_id") == chunk_id).select(vector(F.col("sig_embedding_json")).alias("query_sig"), vector(F.col("body_embedding_json")).alias("query_body")).limit(1)
