"""An encoder without a model: weighted words, their parts and letter n-grams, hashed into buckets.

Everything is a DataFrame expression. The hash is the first 32 bits of MD5, the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
#: Fixed values of the encoder: what a field is worth, and the words that are worth more.
FIELD_WEIGHTS = {"symbol": 3.5, "signature": 2.5, "docstring": 2.0, "body": 1.0}
OTHER_WEIGHT = 1.5
KEYWORDS = (
    "function", "def", "async", "class", "interface", "struct", "enum", "type", "import", "from", "export", "return", "const", "let", "var", "public", "private", "get", "post", "put", "delete", "route", "endpoint", "api", "jwt", "auth", "token",
)


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def weighted_tokens(frame: DataFrame, key: str, text: str, field: str = "general") -> DataFrame:
    """(key, token, weight): words in lower case, their runs of letters or digits, and their 3-grams and 4-grams."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[A-Za-z0-9_]+|[^\s\w]"), F.lit(0))
    each = frame.select(F.col(key), F.posexplode(words).alias("place", "word")).withColumn("low", F.lower("word"))
    factor = (
        F.when(F.col("low").isin(*KEYWORDS), 2.2)
        .when(F.col("word").rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length("word") > 1), 2.0)
        .when(F.substring("word", 2, 1 << 30).rlike("[A-Z]"), 2.5)
        .otherwise(1.0)
    )
    weight = F.lit(FIELD_WEIGHTS.get(field, OTHER_WEIGHT)) * F.greatest(F.lit(0.5), F.lit(1.0) - F.col("place") / 400.0) * factor
    runs = F.regexp_extract_all("low", F.lit("[a-z]+|[0-9]+"), F.lit(0))
    none = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1)))
        return F.when(F.length("low") >= n, F.transform(starts, lambda i: F.concat(F.lit(f"c{n}_"), F.substring("low", i, F.lit(n))))).otherwise(none)

    def valued(tokens: Column, share: float) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(share).alias("share")))

    parts = F.concat(valued(F.array("low"), 1.0), valued(F.when(F.size(runs) > 1, runs).otherwise(none), 1.3), valued(grams(3), 0.7), valued(grams(4), 0.5))
    return each.select(key, weight.alias("w"), F.explode(parts).alias("x")).select(key, F.col("x.token").alias("token"), (F.col("w") * F.col("x.share")).alias("weight"))


def _cells(frame: DataFrame, key: str, text: str, field: str, dimensions: int) -> DataFrame:
    """(key, cells, norm): the components that are not zero, at most as many as there are buckets, and their length."""
    # texts are parted by key once, with a number, as they are few bytes for much work; all sums are local then
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = weighted_tokens(frame.select(key, text).repartition(tasks, key), key, text, field)
    shares = F.array(F.struct(bucket(F.col("token"), dimensions).alias("bucket"), F.lit(0.75).alias("share")), F.struct(bucket(F.concat(F.lit("rot_"), "token"), dimensions).alias("bucket"), F.lit(0.25).alias("share")))
    sums = tokens.select(key, "weight", F.explode(shares).alias("x")).groupBy(key, F.col("x.bucket").alias("bucket")).agg(F.sum(F.col("weight") * F.col("x.share")).alias("total"))
    log = F.lit(1.0) + F.ln("total")
    return sums.groupBy(key).agg(F.collect_list(F.struct("bucket", log.alias("log"))).alias("cells"), F.sqrt(F.sum(log * log)).alias("norm"))


def bucket_weights(frame: DataFrame, key: str, text: str, field: str = "general", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, value): the components of the vectors that are not zero, each vector of length one."""
    return _cells(frame, key, text, field, dimensions).select(key, "norm", F.explode("cells").alias("x")).select(key, F.col("x.bucket").alias("bucket"), (F.col("x.log") / F.col("norm")).alias("value"))


def _dense(dimensions: int):
    def run(buckets: pd.Series, values: pd.Series, norms: pd.Series) -> pd.Series:
        out = []
        for at, value, norm in zip(buckets, values, norms):
            vector = np.zeros(dimensions)
            vector[at] = value / norm
            out.append(vector)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")


def encode(frame: DataFrame, key: str, text: str, field: str = "general", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vector array<double>): a vector for each key whose text has any word."""
    # only putting the components in place is done in Python
    cells = _cells(frame, key, text, field, dimensions)
    return cells.select(key, _dense(dimensions)("cells.bucket", "cells.log", "norm").alias("vector"))


class Encoder:
    """What makes vectors of texts: a name for the records, and a way to encode a column."""

    provider: str
    model: str | None

    def encode(self, frame: DataFrame, key: str, text: str, field: str) -> DataFrame:
        """(key, vector array<double>) of the texts; a text without anything to encode may have no row."""
        raise NotImplementedError


class SubwordEncoder(Encoder):
    """The encoder without a model, of any number of dimensions."""

    provider = "subword"

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.model, self.dimensions = f"md5-{dimensions}", dimensions

    def encode(self, frame: DataFrame, key: str, text: str, field: str) -> DataFrame:
        return encode(frame, key, text, field, self.dimensions)


class FunctionEncoder(Encoder):
    """An encoder that is a function of a list of texts and a field, called in tasks with so many texts at a time."""

    def __init__(self, provider: str, model: str | None, function: Callable[[list[str], str], list[list[float]]], batch: int = 64) -> None:
        self.provider, self.model, self.function, self.batch = provider, model, function, batch

    def encode(self, frame: DataFrame, key: str, text: str, field: str) -> DataFrame:
        function, size = self.function, self.batch

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                asked = ["" if t is None else t for t in texts]
                parts = (function(asked[i : i + size], field) for i in range(0, len(asked), size))
                yield pd.Series([[float(x) for x in v] for part in parts for v in part], dtype=object)

        return frame.select(key, F.pandas_udf(run, "array<double>")(F.col(text)).alias("vector"))
