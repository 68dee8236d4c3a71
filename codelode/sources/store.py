"""Tables of an index as Parquet folders behind a manifest, which is switched in one step.

Rows are written into new folders, one per repository for tables that grow; a table without repositories is one
folder. What is current stands in a manifest, a small JSON file that names the folder of each repository. A write
ends by renaming a finished manifest to the next number, so a reader sees all of a write or nothing of it, and a
write that is broken off leaves the table as it was. A scan of some repositories opens their folders only. Folders
that neither of the last two manifests names are removed after the next write.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.operators import changes

#: The tables of an index: columns, keys, and the column of the repository by which a table is parted.
TABLES = {
    "repositories": ("repo_id string, name string, source_type string, url_or_path string, branch string, commit_hash string, total_files long, total_chunks long, total_symbols long, status string, last_synced_at double, error_message string", ["repo_id"], None),
    "file_hashes": ("repo_id string, file_path string, sha256 string, last_modified double, size_bytes long", ["repo_id", "file_path"], "repo_id"),
    "repo_groups": ("group_name string, created_at double", ["group_name"], None),
    "repo_group_members": ("group_name string, repo_id string", ["group_name", "repo_id"], None),
    "repo_dependencies": ("repo_id string, depends_on_repo_id string, created_at double", ["repo_id", "depends_on_repo_id"], None),
    "chunks_v2": ("chunk_id string, repo_id string, file_path string, language string, start_line int, end_line int, raw_content string, enriched_content string, symbol_name string, chunk_type string, parent_symbol string, imports_json string, docstring string, sig array<double>, body array<double>", ["chunk_id"], "repo_id"),
    "postings": ("token string, chunk_id string, repo_id string, tf_symbol int, tf_signature int, tf_docstring int, tf_body int", ["token", "chunk_id"], "repo_id"),
    "field_lengths": ("chunk_id string, repo_id string, file_path string, len_symbol int, len_signature int, len_docstring int, len_body int", ["chunk_id"], "repo_id"),
    "symbols": ("symbol_id string, repo_id string, name string, kind string, file_path string, line_number int, signature string, docstring string, parent_symbol string", ["symbol_id"], "repo_id"),
    "call_edges": ("edge_id string, source_repo string, source_file string, source_symbol string, target_repo string, target_file string, target_symbol string, edge_type string, line_number int", ["edge_id"], "source_repo"),
    "provenance": ("repo_id string, provider string, model string, dimension int, embedded_at double", ["repo_id"], None),
}
#: The entry of a manifest for a table that is not parted.
WHOLE = ""


class Store:
    """The tables below one folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)

    # ------------------------------------------------------------ manifests

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _manifest(self, name: str, number: int) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.root}/{name}/_manifests/{number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def parts(self, name: str) -> dict[str, str]:
        """The folder of each repository of a table."""
        numbers = self._numbers(name)
        return self._manifest(name, numbers[-1]) if numbers else {}

    def _switch(self, name: str, parts: dict[str, str]) -> None:
        """Makes the parts current: all at once, or not at all if another write came between."""
        numbers, folder = self._numbers(name), f"{self.root}/{name}/_manifests"
        number = numbers[-1] + 1 if numbers else 1
        new = self._path(f"{folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        stream.close()
        there = self._path(f"{folder}/{number:08d}.json")
        if self._fs.exists(there) or not self._fs.rename(new, there):
            self._fs.delete(new, False)
            raise RuntimeError(f"{name} was changed by another write at the same time")
        self._sweep(name, parts, self._manifest(name, numbers[-1]) if numbers else {}, number)

    def _sweep(self, name: str, *kept: dict[str, str] | int) -> None:
        number = kept[-1]
        used = {folder.split("/")[0] for parts in kept[:-1] for folder in parts.values()}
        for status in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            if status.isDirectory() and status.getPath().getName().startswith("v-") and status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
        for old in self._numbers(name):
            if old < number - 1:
                self._fs.delete(self._path(f"{self.root}/{name}/_manifests/{old:08d}.json"), False)

    # ------------------------------------------------------------ reading and writing

    def read(self, name: str, repo_ids: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table, of some repositories only if they are named; no others are opened."""
        schema, _, by = TABLES[name]
        parts = self.parts(name)
        folders = [folder for repo, folder in parts.items() if by is None or repo_ids is None or repo in set(repo_ids)]
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)
        return rows if repo_ids is None or by is not None else rows.where(F.col("repo_id").isin(list(repo_ids)))

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows into a new folder; the folder of each repository that has any."""
        schema, _, by = TABLES[name]
        wanted, version = [f.name for f in T.StructType.fromDDL(schema).fields], f"v-{uuid.uuid4().hex[:12]}"
        frame, target = rows.select(*wanted), f"{self.root}/{name}/{version}"
        if by is None:
            frame.write.parquet(target)
            return {WHOLE: version}
        frame.withColumn("__part", F.md5(by)).repartition("__part", F.pmod(F.xxhash64(*TABLES[name][1]), F.lit(16))).write.partitionBy("__part").parquet(target)
        there = {s.getPath().getName().removeprefix("__part=") for s in self._fs.listStatus(self._path(target)) if s.isDirectory()}
        owners = self.spark.read.parquet(target).select(by).distinct() if there else None  # one row per repository
        found = [r[0] for r in owners.collect()] if owners is not None else []
        return {repo: f"{version}/__part={hashlib.md5(repo.encode()).hexdigest()}" for repo in found}

    def replace(self, name: str, rows: DataFrame, repo_ids: Iterable[str] | None = None) -> None:
        """Puts rows in the place of a table, or in that of some of its repositories, which all rows must be of."""
        new = self._write(name, rows)
        kept = {} if repo_ids is None or TABLES[name][2] is None else {r: f for r, f in self.parts(name).items() if r not in set(repo_ids)}
        self._switch(name, kept | new)

    def upsert(self, name: str, rows: DataFrame) -> None:
        self._merge(name, rows, changes.upsert)

    def insert(self, name: str, rows: DataFrame) -> None:
        self._merge(name, rows, changes.insert_missing)

    def _merge(self, name: str, rows: DataFrame, how) -> None:
        schema, keys, by = TABLES[name]
        rows = rows.select(*[f.name for f in T.StructType.fromDDL(schema).fields])
        # repositories whose rows change: only their folders are read and written again
        touched = None if by is None else [r[0] for r in rows.select(by).where(F.col(by).isNotNull()).distinct().collect()]
        stored = self.read(name, touched) if by is not None else self.read(name)
        self.replace(name, how(stored, rows if by is None else rows.where(F.col(by).isNotNull()), keys), touched)

    def remove(self, name: str, gone: DataFrame, keys: Sequence[str]) -> None:
        self.replace(name, changes.remove(self.read(name), gone, keys))

    def drop(self, name: str, repo_id: str) -> None:
        """Takes a repository out of a parted table; nothing is written but the manifest."""
        parts = self.parts(name)
        if repo_id in parts:
            self._switch(name, {r: f for r, f in parts.items() if r != repo_id})

    def rows(self, name: str, *values: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(values), TABLES[name][0])


def to_json(frame: DataFrame) -> DataFrame:
    """(value): each row as JSON, as a service sends it."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def payload(frame: DataFrame, limit: int = 1000) -> str:
    """A JSON list of a small result; longer ones must be written, not sent."""
    rows = to_json(frame).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps([json.loads(r.value) for r in rows])
