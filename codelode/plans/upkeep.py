"""Queries of scanning, change detection, upkeep of the tables, and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import changes
from codelode.plans.graph import _SIMPLE_SYMBOLS, symbols
from codelode.plans.registry import CORE
from codelode.plans.search import CHUNKS, chunks
from codelode.session import table
from codelode.sources import lines as code
from codelode.sources import paths

_GLOBS = ["*.md", "cmd/batch_*", "docs/", "*_generated.py", "# a remark", "tests/*.ts"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_hashes", "repo_id", "file_path", "sha256", "last_modified", "size_bytes").distinct()


_FILES = "files AS (SELECT DISTINCT repo_id, file_path, sha256, last_modified, size_bytes FROM file_hashes)"


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_IGNORED_SQL = f"""WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS parts FROM file_hashes), k AS (SELECT *, parts[1] = '.github' AS kept FROM p)
SELECT file_path, (kept AND (len(parts) < 2 OR parts[2] NOT IN ({_quoted(paths.KEPT_BELOW)})))
  OR len(list_filter(CASE WHEN kept THEN parts[2:] ELSE parts END, lambda x: x IN ({_quoted(paths.IGNORED_NAMES)}) OR (starts_with(x, '.') AND x NOT IN ('.', '..')))) > 0
  OR lower(regexp_extract(file_path, '[^/](\\.[^./]+)$', 1)) IN ({_quoted(paths.IGNORED_SUFFIXES)}) {{more}} AS ignored FROM k"""


@CORE.add("ignore_filter", _IGNORED_SQL.format(more=""))
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_hashes", "file_path").distinct().select("file_path", paths.ignored(F.col("file_path")).alias("ignored"))


@CORE.add("ignore_patterns", _IGNORED_SQL.format(more="OR regexp_matches(file_path, '\\.md$|^cmd/batch_|(^|/)docs$|_generated\\.py$|^tests/.*\\.ts$')"))
def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_hashes", "file_path").distinct().select("file_path", paths.ignored(F.col("file_path"), _GLOBS).alias("ignored"))


_STATES = f"""{_FILES}, keyed AS (SELECT *, substr(sha256(repo_id || '/' || file_path), 1, 1) AS digit FROM files),
newest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1),
oldest AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY last_modified NULLS FIRST, sha256 NULLS FIRST, size_bytes NULLS FIRST) = 1),
diff AS (SELECT repo_id, file_path, CASE WHEN p.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'deleted' WHEN p.sha256 IS DISTINCT FROM c.sha256 THEN 'modified' END AS change
  FROM (SELECT * FROM oldest WHERE digit <> '0') p FULL JOIN (SELECT * FROM newest WHERE digit <> '1') c USING (repo_id, file_path)),
changed AS (SELECT * FROM diff WHERE change IS NOT NULL)"""


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from the oldest to the newest scan of each file; a sixteenth came since, another one is gone."""
    files = _files(spark, sf_dir).withColumn("digit", F.substring(F.sha2(F.concat_ws("/", "repo_id", "file_path"), 256), 1, 1))
    order = F.struct(F.col("last_modified").isNotNull(), "last_modified", F.col("sha256").isNotNull(), "sha256", F.col("size_bytes").isNotNull(), "size_bytes")
    both = files.groupBy("repo_id", "file_path", "digit").agg(F.max_by("sha256", order).alias("new"), F.min_by("sha256", order).alias("old"))
    previous = both.where("digit <> '0'").select("repo_id", "file_path", F.col("old").alias("sha256"))
    current = both.where("digit <> '1'").select("repo_id", "file_path", F.col("new").alias("sha256"))
    return changes.classify(previous, current, ["repo_id", "file_path"], "sha256")


@CORE.add("change_detection", f"WITH {_STATES} SELECT * FROM changed")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changed(spark, sf_dir)


@CORE.add("incremental_delete", f"WITH {CHUNKS}, {_STATES} SELECT repo_id, count(*) AS chunks FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM changed d WHERE d.repo_id = c.repo_id AND d.file_path = c.file_path AND d.change <> 'added') GROUP BY repo_id")
def incremental_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that stay when those of changed and deleted files are removed, by repository."""
    gone = _changed(spark, sf_dir).where("change <> 'added'")
    return changes.remove(chunks(spark, sf_dir, "chunk_id", "repo_id", "file_path"), gone, ["repo_id", "file_path"]).groupBy("repo_id").agg(F.count("*").alias("chunks"))


@CORE.add("upsert_last_wins", f"WITH {_FILES}, k AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1) SELECT * FROM k")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.last_wins(_files(spark, sf_dir), ["repo_id", "file_path"], ["last_modified", "sha256", "size_bytes"])


@CORE.add(
    "stale_repos",
    """WITH indexed AS (SELECT DISTINCT repo_id FROM chunks_v2), provenance AS (SELECT repo_id, 'local' AS provider, CASE WHEN branch = 'main' THEN 'm2' ELSE 'm1' END AS model FROM repositories WHERE status <> 'error')
SELECT repo_id FROM indexed WHERE repo_id NOT IN (SELECT repo_id FROM provenance WHERE provider = 'local' AND model = 'm2')""",
)
def stale_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    provenance = table(spark, sf_dir, "repositories", "repo_id", "branch", "status").where("status <> 'error'").select("repo_id", F.lit("local").alias("provider"), F.when(F.col("branch") == "main", "m2").otherwise("m1").alias("model"), F.lit(64).alias("dimension"))
    return changes.stale(table(spark, sf_dir, "chunks_v2", "repo_id"), provenance, "local", "m2")


_ROLLUP = f"""WITH {CHUNKS}, {_SIMPLE_SYMBOLS}, f AS (SELECT repo_id, count(DISTINCT file_path) AS files FROM file_hashes GROUP BY ALL), c AS (SELECT repo_id, count(*) AS chunks FROM chunks GROUP BY ALL), s AS (SELECT repo_id, count(*) AS symbols FROM latest WHERE removed_at IS NULL GROUP BY ALL),
rolled AS (SELECT r.repo_id, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(symbols, 0) AS symbols, coalesce(files, 0) <> coalesce(total_files, 0) OR coalesce(chunks, 0) <> coalesce(total_chunks, 0) OR coalesce(symbols, 0) <> coalesce(total_symbols, 0) AS outdated
  FROM repositories r LEFT JOIN f USING (repo_id) LEFT JOIN c USING (repo_id) LEFT JOIN s USING (repo_id))"""


@CORE.add("repo_rollup", f"{_ROLLUP} SELECT * FROM rolled")
def repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, chunks and symbols of each repository as they are, and whether its stored counters differ."""
    stored = table(spark, sf_dir, "repositories", "repo_id", "total_files", "total_chunks", "total_symbols")
    files = table(spark, sf_dir, "file_hashes", "repo_id", "file_path").groupBy("repo_id").agg(F.count_distinct("file_path").alias("files"))
    parts = chunks(spark, sf_dir, "chunk_id", "repo_id").groupBy("repo_id").agg(F.count("*").alias("chunks"))
    named = symbols(spark, sf_dir, "repo_id", "removed_at").where("removed_at IS NULL").groupBy("repo_id").agg(F.count("*").alias("symbols"))
    joined = stored.join(files, "repo_id", "left").join(parts, "repo_id", "left").join(named, "repo_id", "left")
    counted = joined.select("repo_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "chunks", "symbols")], *[F.coalesce(f"total_{c}", F.lit(0)).alias(f"total_{c}") for c in ("files", "chunks", "symbols")])
    outdated = (F.col("files") != F.col("total_files")) | (F.col("chunks") != F.col("total_chunks")) | (F.col("symbols") != F.col("total_symbols"))
    return counted.select("repo_id", "files", "chunks", "symbols", outdated.alias("outdated"))


@CORE.add("dashboard_totals", f"{_ROLLUP} SELECT count(*) AS repos, CAST(sum(files) AS BIGINT) AS files, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(symbols) AS BIGINT) AS symbols, count(*) FILTER (outdated) AS outdated FROM rolled")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_rollup(spark, sf_dir).agg(F.count("*").alias("repos"), *[F.sum(c).alias(c) for c in ("files", "chunks", "symbols")], F.count_if("outdated").alias("outdated"))


@CORE.add("oversized_files", f"WITH {_FILES}, k AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY repo_id, file_path ORDER BY last_modified DESC NULLS LAST, sha256 DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1) SELECT repo_id, count(*) AS files, count(*) FILTER (size_bytes > 8000) AS large, count(*) FILTER (coalesce(size_bytes, 0) = 0) AS unsized, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM k GROUP BY repo_id")
def oversized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = upsert_last_wins(spark, sf_dir)
    return newest.groupBy("repo_id").agg(F.count("*").alias("files"), F.count_if(F.col("size_bytes") > 8000).alias("large"), F.count_if(F.coalesce("size_bytes", F.lit(0)) == 0).alias("unsized"), F.sum("size_bytes").alias("bytes"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.code_lines(chunks(spark, sf_dir, "chunk_id", "repo_id", "file_path", "language", "start_line", "raw_content"), first=F.col("start_line"))


_LINES = f"{CHUNKS}, ln AS (SELECT repo_id, file_path, language, start_line + unnest(range(len(parts))) AS line_number, unnest(parts) AS line FROM (SELECT repo_id, file_path, language, start_line, string_split(replace(replace(raw_content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM chunks WHERE raw_content IS NOT NULL))"


def _definition_case(column: str) -> str:
    cases = []
    for expression, kind in code.DEFINITIONS:
        value = f"regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '{expression}', 1)" if column == "name" else f"'{kind}'"
        cases.append(f"WHEN regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '{expression}') THEN {value}")
    return "CASE " + " ".join(cases) + " END"


@CORE.add("line_definitions", f"WITH {_LINES}, d AS (SELECT repo_id, file_path, {_definition_case('name')} AS name, {_definition_case('kind')} AS kind, line_number, left(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 100) AS signature FROM ln) SELECT repo_id || ':' || file_path || ':' || name AS symbol_id, * FROM d WHERE name IS NOT NULL")
def line_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.definitions(_lines(spark, sf_dir))


@CORE.add("line_calls", f"WITH {_LINES}, c AS (SELECT repo_id, unnest(list_distinct(regexp_extract_all(line, '{code.CALL}', 1))) AS target FROM ln) SELECT repo_id, target AS target_symbol, count(*) AS calls FROM c WHERE target NOT IN ({_quoted(code.NO_CALLS)}) GROUP BY ALL")
def line_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.calls(_lines(spark, sf_dir)).groupBy(F.col("source_repo").alias("repo_id"), "target_symbol").agg(F.count("*").alias("calls"))


@CORE.add("import_lines", f"""WITH {_LINES}, t AS (SELECT repo_id, file_path, language, line_number, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM ln), k AS (SELECT * FROM t WHERE
  (language = 'python' AND line_number <= 60 AND (starts_with(line, 'import ') OR starts_with(line, 'from '))) OR
  (language IN ('typescript', 'javascript') AND line_number <= 60 AND (starts_with(line, 'import ') OR regexp_matches(line, 'import\\s+(?:(?:\\{{[^}}]+\\}})|(?:[\\w\\s,*]+))\\s+from\\s+[''"]([^''"]+)[''"]'))) OR
  (language = 'go' AND line_number <= 40 AND (starts_with(line, 'import ') OR starts_with(line, '"'))) OR (language IN ('rust', 'c', 'cpp') AND line_number <= 40 AND (starts_with(line, 'use ') OR starts_with(line, '#include'))))
SELECT repo_id, file_path, array_to_string(list(line ORDER BY line_number, line)[1:6], chr(10)) AS imports FROM k GROUP BY ALL""")
def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.import_lines(_lines(spark, sf_dir)).select("repo_id", "file_path", F.array_join("imports", "\n").alias("imports"))


_DECLARED = "declared AS (SELECT DISTINCT repo_id, file_path, line_number, signature AS line FROM symbols WHERE signature IS NOT NULL)"
_METHODS = "(get|post|put|delete|patch)\\(\\s*[\"']([^\"']+)[\"']".replace("'", "''")


@CORE.add("endpoints", f"""WITH {_DECLARED}, m AS (SELECT repo_id, file_path, line_number, unnest(regexp_extract_all(line, '@(?:app|router|api)\\.{_METHODS}', 1)) AS method, unnest(regexp_extract_all(line, '@(?:app|router|api)\\.{_METHODS}', 2)) AS path, '@' AS mark FROM declared
  UNION ALL SELECT repo_id, file_path, line_number, unnest(regexp_extract_all(line, '(?:app|router)\\.{_METHODS}', 1)), unnest(regexp_extract_all(line, '(?:app|router)\\.{_METHODS}', 2)), 'app.' FROM declared)
SELECT repo_id || ':endpoint:' || upper(method) || ' ' || path AS symbol_id, repo_id, file_path, upper(method) || ' ' || path AS name, 'api_endpoint' AS kind, line_number, mark || method || '(' || chr(39) || path || chr(39) || ')' AS signature FROM m""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints that signatures of symbols declare; contents of chunks hold none in these tables."""
    declared = table(spark, sf_dir, "symbols", "repo_id", "file_path", "line_number", "signature").where("signature IS NOT NULL").distinct()
    return code.endpoints(declared.withColumnRenamed("signature", "line"))


@CORE.add("client_calls", """WITH t AS (SELECT DISTINCT source_repo, source_file, line_number, regexp_replace(target_symbol, '^[A-Z]+ ', '') AS target FROM call_edges WHERE edge_type = 'CROSS_REPO_API' AND target_symbol IS NOT NULL)
SELECT concat_ws(':', source_repo, source_file, line_number, 'API_CALL', target) AS edge_id, source_repo, source_file, 'line_' || line_number AS source_symbol, target AS target_symbol, 'CROSS_REPO_API' AS edge_type, line_number FROM t WHERE contains(target, '/')""")
def client_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of calls between repositories, written as lines that call them and read from those again."""
    route = F.regexp_replace("target_symbol", "^[A-Z]+ ", "")
    calls = table(spark, sf_dir, "call_edges", "source_repo", "source_file", "line_number", "edge_type", "target_symbol").where("edge_type = 'CROSS_REPO_API' AND target_symbol IS NOT NULL")
    written = calls.select(F.col("source_repo").alias("repo_id"), F.col("source_file").alias("file_path"), "line_number", F.concat(F.lit("    const rows = await http.post( '"), route, F.lit("?from=here', body);")).alias("line")).distinct()
    return code.client_calls(written)


@CORE.add("upsert", f"""WITH {_STATES}, stored AS (SELECT repo_id, file_path, sha256, last_modified, size_bytes FROM oldest WHERE digit <> '0'), new AS (SELECT repo_id, file_path, sha256, last_modified, size_bytes FROM newest WHERE digit IN ('0', '2', '3'))
SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repo_id = s.repo_id AND n.file_path = s.file_path) UNION ALL SELECT * FROM new""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest scan of all files but a sixteenth, into which the newest one of three sixteenths is put."""
    files = _files(spark, sf_dir).withColumn("digit", F.substring(F.sha2(F.concat_ws("/", "repo_id", "file_path"), 256), 1, 1))
    newest = changes.last_wins(files, ["repo_id", "file_path"], ["last_modified", "sha256", "size_bytes"])
    oldest = files.groupBy("repo_id", "file_path", "digit").agg(F.min(F.struct("last_modified", "sha256", "size_bytes")).alias("x")).select("repo_id", "file_path", "digit", "x.*")
    return changes.upsert(oldest.where("digit <> '0'").drop("digit"), newest.where("digit IN ('0', '2', '3')").drop("digit"), ["repo_id", "file_path"])


@CORE.add(
    "stale_adopted",
    """WITH indexed AS (SELECT DISTINCT repo_id FROM chunks_v2), provenance AS (SELECT repo_id, CASE WHEN branch = 'main' THEN 'm2' ELSE 'm1' END AS model FROM repositories WHERE status <> 'error')
SELECT repo_id FROM indexed WHERE repo_id IN (SELECT repo_id FROM provenance WHERE model <> 'm2')""",
)
def stale_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stale_repos, but repositories without a record are taken over, as the model's dimension is the one given."""
    provenance = table(spark, sf_dir, "repositories", "repo_id", "branch", "status").where("status <> 'error'").select("repo_id", F.lit("local").alias("provider"), F.when(F.col("branch") == "main", "m2").otherwise("m1").alias("model"), F.lit(64).alias("dimension"))
    return changes.stale(table(spark, sf_dir, "chunks_v2", "repo_id"), provenance, "local", "m2", 64)


@CORE.add("sliding_windows", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, ls, unnest(range(0, greatest(len(ls), 1), 8)) AS s FROM l)
SELECT doc_id, s + 1 AS start_line, least(s + 12, len(ls)) AS end_line, md5(array_to_string(ls[s + 1:s + 12], chr(10))) AS digest FROM w WHERE s = 0 OR s < len(ls) - 4""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve lines every eight lines over the documents; the last one ends with the text."""
    parts = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    starts = parts.select("doc_id", "ls", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ls") - 1, F.lit(0)), F.lit(8))).alias("s")).where((F.col("s") == 0) | (F.col("s") < F.size("ls") - 4))
    return starts.select("doc_id", (F.col("s") + 1).alias("start_line"), F.least(F.col("s") + 12, F.size("ls")).alias("end_line"), F.md5(F.array_join(F.slice("ls", F.col("s") + 1, F.lit(12)), "\n")).alias("digest"))
