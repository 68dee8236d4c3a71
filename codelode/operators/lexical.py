"""Field-weighted BM25 over chunks: postings, lengths, statistics and ranking.

The fields are the symbol name, the first three lines, the docstring and the whole content. All
statistics are those of the scope. A search looks at each row by itself first: how often it has each token of
the query, and how long its fields are. Only these numbers are shuffled, and repeated rows of a chunk, which give
equal numbers, are dropped then; contents stay where they are read. From stored postings and lengths a search
reads nothing but those of its tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import first_lines, token_count, token_frequency, tokens

#: Fixed values of the ranking: weight and length normalization of each field, its default mean length, and saturation.
FIELDS = {"symbol": (4.0, 0.5, 2.0), "signature": (2.5, 0.6, 10.0), "docstring": (2.0, 0.75, 15.0), "body": (1.0, 0.85, 50.0)}
K1 = 1.2


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id."""
    return chunks.dropDuplicates(["chunk_id"])


def in_scope(frame: DataFrame, repo_ids: Sequence[str] | None, column: str = "repo_id") -> DataFrame:
    """The rows of the repositories; None is all of them, an empty list none."""
    return frame if repo_ids is None else frame.where(F.col(column).isin(list(repo_ids))) if repo_ids else frame.limit(0)


def fields(chunks: DataFrame) -> DataFrame:
    """(chunk_id, repo_id, symbol, signature, docstring, body): the texts of the fields in lower case; null is empty."""
    texts = {"symbol": F.col("symbol_name"), "signature": first_lines(F.col("raw_content")), "docstring": F.col("docstring"), "body": F.col("raw_content")}
    return chunks.select("chunk_id", "repo_id", *[F.lower(F.coalesce(text, F.lit(""))).alias(f) for f, text in texts.items()])


def lengths(fielded: DataFrame) -> DataFrame:
    """(chunk_id, repo_id, len_symbol, len_signature, len_docstring, len_body)."""
    return fielded.select("chunk_id", "repo_id", *[token_count(F.col(f)).alias(f"len_{f}") for f in FIELDS])


def _tagged(field: str) -> Column:
    return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("token"), F.lit(field).alias("field")))


def postings(fielded: DataFrame) -> DataFrame:
    """(token, chunk_id, repo_id, tf_symbol, tf_signature, tf_docstring, tf_body) of all tokens; chunks must be unique."""
    every = fielded.select("chunk_id", "repo_id", F.explode(F.concat(*map(_tagged, FIELDS))).alias("x")).select("chunk_id", "repo_id", "x.token", "x.field")
    counts = [F.count_if(F.col("field") == f).cast("int").alias(f"tf_{f}") for f in FIELDS]
    return every.groupBy("token", "chunk_id", "repo_id").agg(*counts)


def statistics(measured: DataFrame) -> DataFrame:
    """One row: the number of chunks and the mean length of each field, at least 1, defaults for means of 0."""
    means = [F.greatest(F.lit(1.0), F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(default))).alias(f"avg_{f}") for f, (_, _, default) in FIELDS.items()]
    return measured.agg(F.greatest(F.count("*"), F.lit(1)).alias("n_chunks"), *means)


def query_tokens(text: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    import re

    out: dict[str, None] = {}
    for word in re.findall("[a-z0-9_]+", text.lower()):
        runs = re.findall("[a-z]+|[0-9]+", word)
        out.update(dict.fromkeys([word, *(runs if len(runs) > 1 else [])]))
    return list(out)


def hits(fielded: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(token, chunk_id, tf_symbol, tf_signature, tf_docstring, tf_body) of some tokens, once per chunk."""
    each = [F.struct(F.lit(t).alias("token"), *[token_frequency(F.col(f), t).alias(f"tf_{f}") for f in FIELDS]) for t in wanted]
    rows = fielded.select("chunk_id", F.explode(F.array(*each)).alias("x")).select("x.token", "chunk_id", *[f"x.tf_{f}" for f in FIELDS])
    return rows.where(" + ".join(f"tf_{f}" for f in FIELDS) + " > 0").dropDuplicates(["token", "chunk_id"])


def ranked(matching: DataFrame, measured: DataFrame) -> DataFrame:
    """(chunk_id, score, matched_terms) from the postings of the tokens of a query and the lengths of all chunks of the scope.

    Both have a row for each chunk, and Spark would broadcast either by its compressed size; so they are merged.
    """
    seen = matching.groupBy("token").agg(F.count("*").alias("n_token"))  # as many rows as the query has tokens
    joined = matching.join(F.broadcast(seen), "token").join(measured.select("chunk_id", *[f"len_{f}" for f in FIELDS]).hint("merge"), "chunk_id").join(F.broadcast(statistics(measured)))
    idf = F.ln(F.lit(1.0) + (F.col("n_chunks") - F.col("n_token") + 0.5) / (F.col("n_token") + 0.5))
    frequency = sum((w * F.col(f"tf_{f}") / (F.lit(1.0 - b) + b * F.col(f"len_{f}") / F.col(f"avg_{f}")) for f, (w, b, _) in FIELDS.items()), F.lit(0.0))
    scored = joined.withColumn("term_score", idf * frequency / (F.lit(K1) + frequency))
    return scored.groupBy("chunk_id").agg(F.sum("term_score").alias("score"), F.array_sort(F.collect_set("token")).alias("matched_terms"))


def _nothing(frame: DataFrame) -> DataFrame:
    return frame.select("chunk_id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched_terms")).limit(0)


def bm25f(chunks: DataFrame, query: str, repo_ids: Sequence[str] | None = None) -> DataFrame:
    """(chunk_id, score, matched_terms) of each chunk of the scope that has a token of the query."""
    wanted = query_tokens(query)
    if not wanted:
        return _nothing(chunks)
    fielded = fields(in_scope(chunks, repo_ids))
    return ranked(hits(fielded, wanted), lengths(fielded).dropDuplicates(["chunk_id"]))


def bm25f_stored(stored: DataFrame, measured: DataFrame, query: str) -> DataFrame:
    """The same from stored postings and lengths (of the scope); only rows of the tokens of the query are read."""
    wanted = query_tokens(query)
    return ranked(stored.where(F.col("token").isin(wanted)).drop("repo_id"), measured) if wanted else _nothing(measured)


def top(ranked: DataFrame, n: int, score: str = "score") -> DataFrame:
    """The n best rows; noise of summing in another order cannot change them, ties go by chunk_id."""
    return ranked.orderBy(F.round(score, 12).desc(), "chunk_id").limit(n)
