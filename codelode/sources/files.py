"""Scanning trees of source files with Spark: what is indexed, its hash, and its text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.sources.paths import MAX_BYTES, ignored, pruned

_FOUND = "repo_id string, file_path string, sha256 string, last_modified double, size_bytes long, content string"


def _text(contents: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that are none; every line end a line feed."""
    return pd.Series([bytes(c).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in contents], dtype=object)


def _tree(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """(path from the root, size) of each file; folders of which nothing can be indexed are not opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    open_folders = [""]
    while open_folders:
        folder = open_folders.pop()
        for status in fs.listStatus(path(f"{root}/{folder}" if folder else root)):
            name = f"{folder}/{status.getPath().getName()}" if folder else status.getPath().getName()
            if not status.isDirectory():
                yield name, status.getLen()
            elif not pruned(name):
                open_folders.append(name)


def ignore_globs(spark: SparkSession, root: str) -> list[str]:
    """The patterns of the ignore file at the root of a tree; none if there is no such file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        lines = bytes(stream.readAllBytes()).decode("utf-8", "ignore").splitlines()
    finally:
        stream.close()
    return [line.strip() for line in lines if line.strip() and not line.strip().startswith("#")]


def scan(spark: SparkSession, root: str, repo_id: str, globs: Sequence[str] | None = None) -> DataFrame:
    """(repo_id, file_path, sha256, last_modified, size_bytes, content) of the files below root that are indexed.

    The patterns are those of the tree's ignore file unless they are given. Only names and sizes are looked at to
    choose the files, and only those chosen are read. The hash is that of the bytes as they are.
    """
    root = root.rstrip("/")
    names = spark.createDataFrame(list(_tree(spark, root)), "file_path string, size long")
    patterns = ignore_globs(spark, root) if globs is None else globs
    kept = names.where((F.col("size") <= MAX_BYTES) & ~ignored(F.col("file_path"), patterns)).collect()  # paths of one tree, as Spark lists them too
    return read_files(spark, root, repo_id, [r.file_path for r in kept])


def read_files(spark: SparkSession, root: str, repo_id: str, paths: Sequence[str]) -> DataFrame:
    """The same for some files of a tree; those that are not there are left out."""
    if not paths:
        return spark.createDataFrame([], _FOUND)
    escaped = [f"{root}/{p}".replace("\\", "\\\\") for p in paths]
    for mark in "{}[]*?":
        escaped = [p.replace(mark, "\\" + mark) for p in escaped]
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(escaped)
    base = root.removeprefix("file://").removeprefix("file:")
    whole = F.regexp_replace("path", "^file:/*", "/")
    return found.select(
        F.lit(repo_id).alias("repo_id"), F.substr(whole, F.lit(len(base) + 2)).alias("file_path"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").cast("double").alias("last_modified"),
        F.col("length").alias("size_bytes"), F.pandas_udf(_text, "string")("content").alias("content"),
    )
