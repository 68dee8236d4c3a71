"""The library as one object: catalog, sync, search and look-ups over the tables of a store."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import language, signature_text
from codelode.operators import changes, embedding, fusion, graph, lexical, relations
from codelode.operators.dense import dense_stored
from codelode.operators.relations import DependencyCycle, RelationError, Scope, UnknownGroup, UnknownRepository
from codelode.session import cut
from codelode.sources import chunker, files, lines
from codelode.sources.python_symbols import python_symbols
from codelode.sources.store import Store

#: Tables parted by repository, which go with it.
OWNED = ("file_hashes", "chunks_v2", "postings", "field_lengths", "symbols", "call_edges")


class StaleVectors(ValueError):
    """The stored vectors are not of the encoder that a query would be compared by."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time, encoder: embedding.Encoder | None = None) -> None:
        self.spark, self.store, self.clock, self.encoder = spark, Store(spark, root), clock, encoder or embedding.SubwordEncoder()

    # ------------------------------------------------------------ catalog

    def _known(self, *repo_ids: str) -> None:
        asked = set(repo_ids)
        found = {r.repo_id for r in self.store.read("repositories").where(F.col("repo_id").isin(*asked)).select("repo_id").collect()}
        if missing := sorted(asked - found):
            raise UnknownRepository(missing[0])

    def register(self, repo_id: str, path: str, name: str | None = None, branch: str | None = None) -> None:
        """Puts a repository in; registering it again resets its counters."""
        self.store.upsert("repositories", self.store.rows("repositories", (repo_id, name or repo_id, "local", path, branch, None, 0, 0, 0, "pending", None, None)))

    def add(self, repo_id: str, path: str, name: str | None = None, branch: str | None = None, sync: bool = True) -> Row:
        """Registers a repository and reads its tree; its row as it is then."""
        self.register(repo_id, path, name, branch)
        if sync:
            self.sync(repo_id)
        return self.repository(repo_id)

    def change(self, repo_id: str, path: str | None = None, branch: str | None = None, name: str | None = None, sync: bool = True) -> tuple[Row, dict[str, int] | None]:
        """Changes what is given of a repository, also called by a loose name, and reads its tree again; its row, and what sync found."""
        known = self.spark.createDataFrame([(repo_id,)], "input string")
        repo_id = relations.resolve_aliases(known, self.store.read("repositories")).first().repo_id
        given = {c: v for c, v in (("url_or_path", path), ("branch", branch), ("name", name)) if v is not None}
        self.update(repo_id, **given)
        found = self.sync(repo_id) if sync else None
        return self.repository(repo_id), found

    def repository(self, repo_id: str) -> Row | None:
        return self.store.read("repositories").where(F.col("repo_id") == repo_id).first()

    def update(self, repo_id: str, **columns: object) -> None:
        self._known(repo_id)
        row = self.store.read("repositories").where(F.col("repo_id") == repo_id)
        for column, value in columns.items():
            row = row.withColumn(column, F.lit(value).cast(row.schema[column].dataType))
        self.store.upsert("repositories", self.spark.createDataFrame(row.collect(), row.schema))

    def repositories(self) -> DataFrame:
        return self.store.read("repositories").orderBy("name", "repo_id")

    def delete(self, repo_id: str) -> bool:
        """Removes a repository with all that belongs to it."""
        there = self.store.read("repositories").where(F.col("repo_id") == repo_id).count() > 0
        gone = self.spark.createDataFrame([(repo_id,)], "repo_id string")
        for name in OWNED:
            self.store.drop(name, repo_id)
        for name in ("repositories", "repo_group_members", "provenance"):
            self.store.remove(name, gone, ["repo_id"])
        needs = self.store.read("repo_dependencies")
        self.store.replace("repo_dependencies", needs.where((F.col("repo_id") != repo_id) & (F.col("depends_on_repo_id") != repo_id)))
        return there

    # ------------------------------------------------------------ groups and dependencies

    def _group(self, name: str) -> None:
        if not self.store.read("repo_groups").where(F.col("group_name") == name).limit(1).count():
            raise UnknownGroup(name)

    def create_group(self, name: str, repo_ids: Sequence[str] = ()) -> None:
        """All or nothing: a blank or taken name or an unknown repository changes nothing."""
        if not name.strip():
            raise ValueError("a group needs a name")
        if self.store.read("repo_groups").where(F.col("group_name") == name).limit(1).count():
            raise RelationError(f"group {name} is there already")
        self._known(*repo_ids)
        self.store.insert("repo_groups", self.store.rows("repo_groups", (name, self.clock())))
        if repo_ids:
            self.add_to_group(name, repo_ids)

    def add_to_group(self, name: str, repo_ids: Sequence[str]) -> list[str]:
        self._group(name)
        self._known(*repo_ids)
        self.store.insert("repo_group_members", self.store.rows("repo_group_members", *[(name, r) for r in repo_ids]))
        return self.group_members(name)

    def remove_from_group(self, name: str, repo_id: str) -> bool:
        self._group(name)
        there = repo_id in self.group_members(name)
        self.store.remove("repo_group_members", self.store.rows("repo_group_members", (name, repo_id)), ["group_name", "repo_id"])
        return there

    def delete_group(self, name: str) -> bool:
        there = self.store.read("repo_groups").where(F.col("group_name") == name).count() > 0
        gone = self.spark.createDataFrame([(name,)], "group_name string")
        for table in ("repo_groups", "repo_group_members"):
            self.store.remove(table, gone, ["group_name"])
        return there

    def group_members(self, name: str) -> list[str]:
        return [r.repo_id for r in self.store.read("repo_group_members").where(F.col("group_name") == name).select("repo_id").orderBy("repo_id").collect()]

    def groups(self) -> DataFrame:
        return relations.group_listing(self.store.read("repo_groups"), self.store.read("repo_group_members")).orderBy("group_name")

    def add_dependency(self, repo_id: str, depends_on: str) -> None:
        """Adds an edge; a loop, an unknown repository or a cycle is an error, an edge that is there is none."""
        if repo_id == depends_on:
            raise RelationError("a repository cannot depend on itself")
        self._known(repo_id, depends_on)
        new = self.store.rows("repo_dependencies", (repo_id, depends_on, self.clock()))
        needs = self.store.read("repo_dependencies")
        if relations.rejected_dependencies(new, needs).limit(1).count():
            raise DependencyCycle(f"{depends_on} depends on {repo_id} already")
        self.store.insert("repo_dependencies", new)

    def remove_dependency(self, repo_id: str, depends_on: str) -> bool:
        edge = (F.col("repo_id") == repo_id) & (F.col("depends_on_repo_id") == depends_on)
        there = self.store.read("repo_dependencies").where(edge).count() > 0
        self.store.replace("repo_dependencies", self.store.read("repo_dependencies").where(~edge))
        return there

    def scope(self, repo_ids: list[str] | None = None, groups: list[str] | None = None, expand: str = "none", depth: int = 1) -> Scope:
        known = self.store.read("repo_groups").select("group_name", F.lit(None).cast("string").alias("repo_id"))
        members = self.store.read("repo_group_members").unionByName(known)
        if repo_ids:
            typed = self.spark.createDataFrame([(r,) for r in repo_ids], "input string")
            repo_ids = [r.repo_id for r in relations.resolve_aliases(typed, self.store.read("repositories")).collect()]
        return relations.resolve_scope(self.store.read("repositories"), self.store.read("repo_dependencies"), members, repo_ids, groups, expand, depth)

    # ------------------------------------------------------------ sync

    def sync(self, repo_id: str, force: bool = False, globs: Sequence[str] | None = None) -> dict[str, int]:
        """Reads the tree of a repository and puts in what changed; hashes are written last, so a failed run is repeated.

        A run that fails leaves the repository with the status ``error`` and its message.
        """
        self._known(repo_id)
        try:
            return self._sync(repo_id, force, globs)
        except Exception as error:
            self.update(repo_id, status="error", error_message=str(error)[:500])
            raise

    def _sync(self, repo_id: str, force: bool, globs: Sequence[str] | None) -> dict[str, int]:
        repo = self.repository(repo_id)
        other = self.stale().where(F.col("repo_id") == repo_id).count() > 0  # stored vectors are of another encoder
        current = files.scan(self.spark, repo.url_or_path, repo_id, globs).cache()
        previous = self.store.read("file_hashes", [repo_id])
        keys = ["repo_id", "file_path"]
        found = changes.classify(previous.limit(0) if force else previous, current, keys, "sha256").cache()
        counts = {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}
        gone = found.where("change <> 'added'").select(*keys) if not force else self.store.read("chunks_v2", [repo_id]).select(*keys).distinct()
        texts = current.join(found.where("change <> 'deleted'").select(*keys), keys, "left_semi").select(*keys, "content").cache()

        code = texts.withColumn("language", language(F.col("file_path")))
        script = lines.code_lines(code.where("language <> 'python'"), "content")
        named, called = python_symbols(code.where("language = 'python'").select(*keys, "content"))
        every = lines.code_lines(code, "content")
        blank = {c: F.lit(None).cast("string") for c in ("docstring", "parent_symbol")}
        symbols = named.unionByName(lines.definitions(script).withColumns(blank)).unionByName(lines.endpoints(every).withColumns(blank))
        symbols = changes.last_wins(symbols, ["symbol_id"], ["line_number", "signature"])
        edges = called.unionByName(lines.calls(script)).unionByName(lines.client_calls(every)).withColumns({c: F.lit(None).cast("string") for c in ("target_repo", "target_file")})
        edges = edges.dropDuplicates(["edge_id"])
        if counts or force:
            # chunks are cut and encoded once: vectors, postings and lengths are made of the same rows
            chunks = cut(chunker.chunk_files(texts))
            fielded = lexical.fields(chunks)
            new = {"chunks_v2": self._encoded(chunks), "postings": lexical.postings(fielded), "field_lengths": lexical.lengths(fielded).join(chunks.select("chunk_id", "file_path"), "chunk_id"), "symbols": symbols, "call_edges": edges}
            stale = self.store.read("chunks_v2", [repo_id]).join(gone, keys, "left_semi").select("repo_id", "chunk_id")
            for name, rows in new.items():
                stored = self.store.read(name, [repo_id])
                own = gone.select(F.col("repo_id").alias("source_repo"), F.col("file_path").alias("source_file")) if name == "call_edges" else stale if name == "postings" else gone
                new[name] = changes.upsert(changes.remove(stored, own, own.columns), rows.select(*stored.columns), [stored.columns[0]] if name != "postings" else ["chunk_id"])
            # postings first: those to be removed are found by the chunks that are stored
            for name in ("postings", "field_lengths", "chunks_v2", "symbols", "call_edges"):
                self.store.replace(name, new[name], [repo_id])
        if other:
            self.reembed(repo_id)
        elif counts or force:
            self._record(repo_id)
        self.store.replace("file_hashes", current.drop("content"), [repo_id])
        totals = {f"total_{k}": self.store.read(t, [repo_id]).count() for k, t in (("files", "file_hashes"), ("chunks", "chunks_v2"), ("symbols", "symbols"))}
        self.update(repo_id, status="ready", last_synced_at=self.clock(), error_message=None, **totals)
        for frame in (current, found, texts):
            frame.unpersist()
        return {c: counts.get(c, 0) for c in ("added", "modified", "deleted")}

    def _encoded(self, chunks: DataFrame) -> DataFrame:
        """Chunks with the vectors of their signature text and their content."""
        sig = self.encoder.encode(chunks.withColumn("__text", signature_text()), "chunk_id", "__text", "signature").withColumnRenamed("vector", "sig")
        body = self.encoder.encode(chunks, "chunk_id", "raw_content", "body").withColumnRenamed("vector", "body")
        return chunks.drop("sig", "body").join(sig, "chunk_id", "left").join(body, "chunk_id", "left")

    def _record(self, repo_id: str) -> None:
        """What encoder the vectors of a repository are of, and how long they are (null if there are none)."""
        own = self.store.read("chunks_v2", [repo_id]).where("sig IS NOT NULL").select(F.size("sig").alias("n")).first()
        self.store.upsert("provenance", self.store.rows("provenance", (repo_id, self.encoder.provider, self.encoder.model, own.n if own else None, self.clock())))

    def reembed(self, repo_id: str) -> int:
        """Makes the vectors of a repository anew from its stored chunks; texts, postings and symbols stay. The number of chunks."""
        chunks = self.store.read("chunks_v2", [repo_id])
        self.store.replace("chunks_v2", self._encoded(chunks), [repo_id])
        self._record(repo_id)
        return self.store.read("chunks_v2", [repo_id]).count()

    def reindex(self, progress: Callable[[str, int], None] | None = None) -> list[str]:
        """Makes the vectors of all repositories of another encoder anew, one by one: a run that is broken off goes on with the rest."""
        done = []
        for repo_id in sorted(r.repo_id for r in self.stale().collect()):
            n = self.reembed(repo_id)
            done.append(repo_id)
            if progress:
                progress(repo_id, n)
        return done

    # ------------------------------------------------------------ search and look-ups

    def search(self, query: str, repo_ids: list[str] | None = None, groups: list[str] | None = None, expand: str = "none", depth: int = 1, top_k: int = 8, reindex: bool = True) -> DataFrame:
        """The best chunks for a query, with callers and callees; a blank query or an empty scope has none.

        Only the query is encoded. Vectors of another encoder are made anew first, or are an error.
        """
        if self.stale().limit(1).count():
            if not reindex:
                raise StaleVectors("the vectors are of another encoder")
            self.reindex()
        top_k = top_k if isinstance(top_k, int) and top_k > 0 else 8
        scope = self.scope(repo_ids, groups, expand, depth)
        # repositories of the scope, whose folders alone are opened
        within = None if scope.rows is None else [r.repo_id for r in scope.rows.select("repo_id").distinct().collect()]
        chunks, edges = self.store.read("chunks_v2", within), self.store.read("call_edges")
        asked = self.spark.createDataFrame([(0, query)], "id int, text string")
        vectors = [self.encoder.encode(asked, "id", "text", f).select("id", F.col("vector").alias(f"query_{n}")) for n, f in (("sig", "signature"), ("body", "body"))]
        by_vector = dense_stored(chunks.select("chunk_id", "sig", "body"), vectors[0].join(vectors[1], "id"))
        by_words = lexical.bm25f_stored(self.store.read("postings", within), self.store.read("field_lengths", within), query)
        found = fusion.rerank(chunks if query.strip() else chunks.limit(0), by_vector, by_words, edges, query, top_k, scope)
        return fusion.enrich(found, edges)

    def chunk(self, chunk_id: str) -> Row | None:
        return self.store.read("chunks_v2").where(F.col("chunk_id") == chunk_id).first()

    def files(self, repo_id: str) -> DataFrame:
        """The indexed files of a repository."""
        return self.store.read("file_hashes", [repo_id]).orderBy("file_path")

    def dependencies(self, repo_id: str) -> list[str]:
        return [r[0] for r in self.store.read("repo_dependencies").where(F.col("repo_id") == repo_id).select("depends_on_repo_id").orderBy("depends_on_repo_id").collect()]

    def dependents(self, repo_id: str) -> list[str]:
        return [r[0] for r in self.store.read("repo_dependencies").where(F.col("depends_on_repo_id") == repo_id).select("repo_id").orderBy("repo_id").collect()]

    def relations(self) -> DataFrame:
        """(repo_id, groups, depends_on, needed_by) of each repository."""
        return relations.summary(self.store.read("repositories"), self.store.read("repo_dependencies"), self.store.read("repo_group_members"))

    def symbol_info(self, name: str, repo_id: str | None = None) -> dict[str, DataFrame]:
        """Definitions and callers of a name, and its callees if the repository is given."""
        symbols, edges = self.store.read("symbols"), self.store.read("call_edges")
        empty = edges.limit(0)
        return {"definitions": graph.definitions(symbols, name, repo_id), "callers": graph.callers(edges, name), "callees": graph.callees(edges, name, repo_id) if repo_id else empty}

    def cross_repo_links(self) -> DataFrame:
        return graph.api_links(self.store.read("call_edges"), self.store.read("symbols"))

    def stale(self, encoder: embedding.Encoder | None = None) -> DataFrame:
        """(repo_id) of the repositories whose vectors are not of the encoder."""
        encoder = encoder or self.encoder
        indexed = self.spark.createDataFrame([(r,) for r in self.store.parts("chunks_v2")], "repo_id string")
        return changes.stale(indexed, self.store.read("provenance"), encoder.provider, encoder.model)

    def file_content(self, repo_id: str, path: str) -> str | None:
        """The text of an indexed file; other paths, also those that lead out of the tree, have none."""
        listed = self.store.read("file_hashes", [repo_id]).where(F.col("file_path") == path)
        if ".." in path.split("/") or not listed.limit(1).count():
            return None
        found = files.read_files(self.spark, self.repository(repo_id).url_or_path.rstrip("/"), repo_id, [path]).select("content").first()
        return found.content if found else None
