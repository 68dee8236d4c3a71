"""Changes between two states of a table, and putting them in: the parts of an incremental sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(previous: DataFrame, current: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """(keys, change): what was added, modified or deleted from one state to the other."""
    old = previous.select(*keys, F.col(content).alias("__old"), F.lit(True).alias("__was"))
    new = current.select(*keys, F.col(content).alias("__new"), F.lit(True).alias("__is"))
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "deleted").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return new.join(old, list(keys), "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the order, which must tell rows of a key apart."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows with the new ones put in, which replace those with their keys."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows and those new ones whose keys are not there yet."""
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def remove(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows without those of the keys."""
    return stored.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def stale(indexed: DataFrame, provenance: DataFrame, provider: str, model: str | None, dimension: int | None = None) -> DataFrame:
    """(repo_id) of indexed repositories whose vectors are not of the current model.

    A repository without a record is taken over if the dimension that is known for the model is the one given.
    """
    fits = (F.col("provider") == provider) & F.col("model").eqNullSafe(F.lit(model))
    own = indexed.select("repo_id").distinct()
    known = provenance.where(fits).agg(F.first("dimension", ignorenulls=True).alias("d")).first()["d"] if dimension is not None else None
    if known is not None and known == dimension:
        recorded = provenance.select("repo_id")
        own = own.join(recorded, "repo_id", "left_semi")
    return own.join(provenance.where(fits).select("repo_id"), "repo_id", "left_anti")
