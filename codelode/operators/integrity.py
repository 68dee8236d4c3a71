"""References to records that do not exist: orphans per edge, and their number per table and month.

The work is split by skew. References are first added up per key and month, which shrinks hot keys
on the map side. A key with more than ``heavy_share`` of all rows is heavy; there can be no more than
``1 / heavy_share`` of them, so their verdicts are broadcast. All other keys are shuffled and joined
with the keys that exist. Both halves are put together again.

Defined results: an edge without a target repository (null or blank) refers to nothing. Repeated rows
of an edge count once, at their earliest time; rows without an edge_id count once per distinct row.
A null target file or symbol counts as empty text. A null time of an edge is later than any other
(so it is never early), a null time of a symbol is earlier than any other. Of the latest rows of a
symbol with the same time, one with removed_at decides. Empty tables: no edges give no rows, no
symbols or repositories leave every reference an orphan. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import small

HEAVY_SHARE = 0.001
FAR_FUTURE = "9999-12-31 00:00:00"
FAR_PAST = "0001-01-01 00:00:00"


def _clean(name: str) -> Column:
    return F.coalesce(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""), F.lit(""))


def _time(name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("timestamp_ntz"), F.lit(default).cast("timestamp_ntz"))


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, repo, key, at) for each row that refers to a record; repeated rows are still in."""
    repo, file, symbol = _clean("target_repo"), _clean("target_file"), _clean("target_symbol")
    key = (
        F.when(symbol.startswith(F.concat(repo, F.lit(":"))), symbol)
        .when(F.col("edge_type") == "CROSS_REPO_API", F.concat(repo, F.lit(":endpoint:"), symbol))
        .otherwise(F.concat_ws(":", repo, file, symbol))
    )
    return (
        edges.select("edge_id", repo.alias("repo"), key.alias("key"), _time("indexed_at", FAR_FUTURE).alias("at"))
        .where(F.col("repo") != "")
    )


def first_sent(refs: DataFrame) -> DataFrame:
    """One row per edge: the earliest one; of rows at the same time the one with the smallest key."""
    own = F.when(F.col("edge_id").isNull(), F.struct("key", "at"))
    return (
        refs.withColumn("anonymous", own)
        .groupBy("edge_id", "anonymous")
        .agg(F.min(F.struct("at", "repo", "key")).alias("first"))
        .select("edge_id", "first.repo", "first.key", "first.at")
    )


def symbol_states(symbols: DataFrame) -> DataFrame:
    """(key, removed, since) per symbol_id: whether its latest row is removed, and its earliest time."""
    at = _time("indexed_at", FAR_PAST)
    return (
        symbols.where(F.col("symbol_id").isNotNull())
        .select(F.col("symbol_id").alias("key"), at.alias("at"), F.col("removed_at").isNotNull().alias("gone"))
        .groupBy("key")
        .agg(F.max(F.struct("at", "gone"))["gone"].alias("removed"), F.min("at").alias("since"))
    )


def heavy_keys(refs: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(key, repo) with more than heavy_share of all rows: at most 1 / heavy_share rows."""
    monthly = refs.groupBy("key", "repo", F.trunc("at", "month").alias("month")).agg(F.count("*").alias("n"))
    counts = monthly.groupBy("key", "repo").agg(F.sum("n").alias("n"))
    total = refs.agg(F.count("*").alias("n")).first()["n"]
    return counts.where(F.col("n") > heavy_share * total).select("key", "repo")


def _verdict() -> Column:
    """ref_table and state of a reference from known (its repository exists), removed, since and at."""
    return (
        F.when(F.col("known").isNull(), F.struct(F.lit("repositories").alias("ref_table"), F.lit("missing").alias("state")))
        .when(F.col("since").isNull(), F.struct(F.lit("symbols").alias("ref_table"), F.lit("missing").alias("state")))
        .when(F.col("removed"), F.struct(F.lit("symbols").alias("ref_table"), F.lit("deleted").alias("state")))
        .when(F.col("since") > F.col("at"), F.struct(F.lit("symbols").alias("ref_table"), F.lit("late").alias("state")))
    )


def _with_repositories(rows: DataFrame, repositories: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """rows with known. A few repositories are broadcast; of many, those that very many rows name are, the others are shuffled."""
    known = repositories.where(F.col("repo_id").isNotNull()).select(F.col("repo_id").alias("repo"), F.lit(True).alias("known")).distinct()
    if small(known):
        return rows.join(F.broadcast(known), "repo", "left")
    named = rows.groupBy("repo").agg(F.count("*").alias("n"))
    most = rows.count() * heavy_share
    heavy = named.where(F.col("n") > most).select("repo").join(known, "repo", "left")  # at most 1 / heavy_share rows
    rest = rows.join(F.broadcast(heavy.select("repo")), "repo", "left_anti").join(known, "repo", "left")
    return rows.join(F.broadcast(heavy), "repo").unionByName(rest)


def _with_states(rows: DataFrame, refs: DataFrame, symbols: DataFrame, repositories: DataFrame, heavy_share: float) -> DataFrame:
    """rows (with repo and key) with known, removed and since; heavy keys by broadcast, others by shuffle."""
    heavy = heavy_keys(refs, heavy_share)
    ids = heavy.select(F.col("key").alias("symbol_id")).distinct()
    verdicts = heavy.join(symbol_states(symbols.join(F.broadcast(ids), "symbol_id", "left_semi")), "key", "left")
    hot = rows.join(F.broadcast(verdicts), ["key", "repo"])
    rest = rows.join(F.broadcast(heavy), ["key", "repo"], "left_anti").join(symbol_states(symbols), "key", "left")
    return _with_repositories(hot.unionByName(rest), repositories, heavy_share)


def orphans(edges: DataFrame, symbols: DataFrame, repositories: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(edge_id, ref_table, state, month): the edges whose reference fails, by the first check that fails."""
    refs = references(edges)
    rows = _with_states(first_sent(refs), refs, symbols, repositories, heavy_share)
    return (
        rows.withColumn("verdict", _verdict())
        .where(F.col("verdict").isNotNull())
        .select("edge_id", "verdict.ref_table", "verdict.state", F.date_format("at", "yyyy-MM").alias("month"))
    )


def orphan_counts(edges: DataFrame, symbols: DataFrame, repositories: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(ref_table, state, month, orphans): counted from sums per key and month.

    Missing and deleted records fail for a whole group of references, so the sums are enough; only a
    group that has references both before and after its record came is looked at edge by edge.
    """
    refs = references(edges)
    sent = first_sent(refs)
    groups = sent.groupBy("key", "repo", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("at").alias("at"), F.max("at").alias("last"))
    states = _with_states(groups, refs, symbols, repositories, heavy_share).withColumn("verdict", _verdict())
    straddling = (F.col("verdict.state") == "late") & (F.col("last") >= F.col("since"))
    whole = states.where(F.col("verdict").isNotNull() & ~straddling).groupBy("verdict.ref_table", "verdict.state", "month").agg(F.sum("n").alias("orphans"))
    split = states.where(straddling).select("key", "repo", "month", "since")
    parts = (
        sent.withColumn("month", F.date_format("at", "yyyy-MM"))
        .join(split, ["key", "repo", "month"])
        .where(F.col("at") < F.col("since"))
        .groupBy(F.lit("symbols").alias("ref_table"), F.lit("late").alias("state"), "month")
        .agg(F.count("*").alias("orphans"))
    )
    return whole.unionByName(parts).groupBy("ref_table", "state", "month").agg(F.sum("orphans").cast("long").alias("orphans"))
