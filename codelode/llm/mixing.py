"""Mixing sources to target weights by balanced sampling.

The budget of a mixture is its share of the tokens of all documents, and each source has a share of the
budget. A source that must be used 2.3 times gives each of its documents twice, and a third time with
probability 0.3. That fraction is drawn by the cube method: probabilities move through the null space of
the constraints (the sum of tokens and the number of documents), so that both sums stay what they are,
until all but two of a block are decided. The undecided of all blocks are put into blocks again, and so
on, until one block per source is left. Its last two documents, with a reserve of ``RESERVE`` others that
each source sets aside before the first round, are decided by trying all their subsets (the landing): a very
large document is often among the last two, and the reserve makes up for it.

Blocks are made by a hash of doc_id and hold about ``BLOCK`` documents, also those of a source that has a
third of all rows; each round leaves two undecided per block, so the number of rounds is the logarithm of
the largest source. Draws depend only on the ids, so a lost task gives the same result again.

Defined results: a source that is too small is used max_repeats times whole, and what is lacking is
reported, not made up by others; a source without documents, or with no tokens, gives none. Documents
without tokens (null or empty text) and those without an id are in no mixture, their tokens count in the
total; repeated rows of a document count once, the smallest source deciding. Null shares, ratios and
repeats count as 0, 0 and 1. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.tokens import encode_corpus
from codelode.session import broadcast_if_small, cut

BLOCK = 4096
#: Documents per source, taken by hash, that are left for the landing besides the last two.
RESERVE = 14
_EPS = 1e-9


def _move(p: list[float], at: list[int], u: list[float], draw: float) -> None:
    """Moves the probabilities at some places along u or against it, as far as one gets to 0 or 1."""
    up = down = float("inf")
    for i, x in zip(at, u):
        if x > 0:
            up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
        elif x < 0:
            up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
    step = up if draw * (up + down) < down else -down
    for i, x in zip(at, u):
        value = p[i] + step * x
        p[i] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value


def flight(p: list[float], sizes: list[float], draws: np.random.Generator) -> list[int]:
    """Decides all but two of the units, keeping the sums of p and of p times size; returns the undecided."""
    open_units: list[int] = []
    for unit in range(len(p)):
        if 0 < p[unit] < 1:
            open_units.append(unit)
        while len(open_units) == 3:
            a, b, c = (sizes[i] for i in open_units)
            u = [b - c, c - a, a - b]
            _move(p, open_units, u if any(u) else [1.0, -1.0, 0.0], draws.random())
            open_units = [i for i in open_units if 0 < p[i] < 1]
    return open_units


def landing(p: list[float], sizes: list[float], open_units: list[int], draws: np.random.Generator) -> None:
    """Decides the last units: of all their subsets, the one that keeps both sums best, tokens before documents."""
    if not open_units:
        return
    odds, own = np.array([p[i] for i in open_units]), np.array([sizes[i] for i in open_units])
    subsets = (np.arange(1 << len(open_units))[:, None] >> np.arange(len(open_units))) & 1
    tokens = np.abs(subsets @ own - odds @ own) / max(1.0, own.mean())
    number = np.abs(subsets.sum(axis=1) - odds.sum())
    best = subsets[np.argmin(tokens + 0.01 * number + 1e-6 * draws.random(len(subsets)))]
    for i, x in zip(open_units, best):
        p[i] = float(x)


_UNITS = "mix_id string, source string, doc_id long, tokens long, base int, p double"


def _round(last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id"])
        draws = np.random.default_rng(zlib.crc32(repr((last, *key)).encode()))
        p, sizes = group.p.tolist(), group.tokens.astype(float).tolist()
        kept = min(RESERVE, len(p)) if last else 0
        moved = p[kept:]
        left = [kept + i for i in flight(moved, sizes[kept:], draws)]
        p[kept:] = moved
        if last:
            landing(p, sizes, [i for i in range(kept) if 0 < p[i] < 1] + left, draws)
        return group.assign(p=p)[["mix_id", "source", "doc_id", "tokens", "base", "p"]]

    return run


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of each row, by the tokenizer of the vocabulary file."""
    named = documents.select(F.struct("doc_id", "source").alias("__doc"), "text")
    return encode_corpus(named, "__doc", "text", path).select("__doc.doc_id", "__doc.source", F.size("ids").cast("long").alias("tokens"))


def plans(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, target_tokens, available, docs, rate): what each source has to give."""
    goals = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").select(
        "mix_id", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("budget_ratio", F.lit(0.0)).alias("budget_ratio")
    ).dropDuplicates(["mix_id", "source"])
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    stock = _usable(sizes).groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
    goal = F.col("target_share") * F.col("budget_ratio") * F.lit(float(total))
    return (
        goals.join(stock, "source", "left")
        .select("mix_id", "source", "target_share", "max_repeats", goal.alias("target_tokens"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("docs", F.lit(0)).alias("docs"))
        .withColumn("rate", F.when(F.col("available") > 0, F.least(F.col("target_tokens") / F.col("available"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    )


def _usable(sizes: DataFrame) -> DataFrame:
    kept = sizes.where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0")
    return kept.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")


def mix(sizes: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats): how often each document is in each mixture."""
    largest = plan.agg(F.max("docs").alias("n")).first()["n"] or 0
    base = F.floor("rate").cast("int")
    units = _usable(sizes).join(broadcast_if_small(plan.select("mix_id", "source", "rate", "docs")), "source").where("rate > 0")
    units = units.select("mix_id", "source", "doc_id", "tokens", base.alias("base"), (F.col("rate") - base).alias("p"), F.ceil(F.col("docs") / block).alias("blocks"))
    decided, undecided = units.where("p <= 0").drop("blocks"), units.where("p > 0")
    order, reserve = F.xxhash64("doc_id", "mix_id").alias("order"), None
    if largest > block:
        # those that the last round would keep: set aside in every source, whatever the size of the largest
        ranked = undecided.withColumn("rank", F.row_number().over(Window.partitionBy("mix_id", "source").orderBy(order, "doc_id")))
        reserve = cut(ranked.where(F.col("rank") <= RESERVE).drop("rank"))
        undecided = undecided.join(broadcast_if_small(reserve.select("mix_id", "source", "doc_id")), ["mix_id", "source", "doc_id"], "left_anti")
    while True:
        last = largest <= block
        if last and reserve is not None:
            undecided = undecided.unionByName(reserve, allowMissingColumns=True)
        place = F.lit(0) if last else F.pmod(F.xxhash64("mix_id", "doc_id"), F.col("blocks"))
        keyed = undecided.select("mix_id", "source", "doc_id", "tokens", "base", "p", order, place.alias("block"))
        done = keyed.groupBy("mix_id", "source", "block").applyInPandas(_round(last), _UNITS)
        if last:
            every = decided.unionByName(done)
            return every.select("mix_id", "source", "doc_id", "tokens", (F.col("base") + F.round("p").cast("int")).alias("repeats")).where("repeats > 0")
        done = cut(done)
        decided = decided.unionByName(done.where("p = 0 OR p = 1"))
        largest = 2 * -(-largest // block)
        undecided = done.where("p > 0 AND p < 1").withColumn("blocks", F.lit(-(-largest // block)))


def report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """The share that each source reached, beside its target."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"), F.count("*").alias("used"), F.max("repeats").alias("most"))
    whole = got.groupBy("mix_id").agg(F.sum("n").alias("mixture_tokens"))
    tokens = F.coalesce("n", F.lit(0))
    return plan.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select(
        "mix_id", "source", "target_share", "target_tokens", "available", "docs", tokens.alias("actual_tokens"), F.coalesce("used", F.lit(0)).alias("docs_used"), F.coalesce("most", F.lit(0)).alias("most_repeats"),
        F.coalesce(tokens / F.col("mixture_tokens"), F.lit(0.0)).alias("actual_share"), (F.col("target_tokens") - tokens).alias("lacking_tokens"),
    )
