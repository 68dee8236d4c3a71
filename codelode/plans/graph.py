"""Queries of the symbol graph and of repository relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators import graph, relations
from codelode.plans.registry import CORE
from codelode.plans.search import EDGES, centrality_sql, like
from codelode.session import table

_EDGE_COLUMNS = ("edge_id", "source_repo", "source_file", "source_symbol", "target_repo", "target_file", "target_symbol", "edge_type", "line_number", "indexed_at")
_SIMPLE_SYMBOLS = "latest AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY indexed_at DESC, repo_id DESC, name DESC, kind DESC, file_path DESC, line_number DESC) = 1)"


def symbols(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The latest row of each symbol, with only the columns that are needed."""
    wanted = columns or ("repo_id", "name", "kind", "file_path", "line_number")
    return graph.latest_symbols(table(spark, sf_dir, "symbols", "symbol_id", "indexed_at", *wanted))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_edges(table(spark, sf_dir, "call_edges", *_EDGE_COLUMNS))


@CORE.add("symbol_definitions", f"WITH {_SIMPLE_SYMBOLS} SELECT name, count(*) AS definitions, count(DISTINCT repo_id) AS repos, count(*) FILTER (kind = 'method') AS methods, min(symbol_id) AS first_id FROM latest GROUP BY name")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).groupBy("name").agg(F.count("*").alias("definitions"), F.count_distinct("repo_id").alias("repos"), F.count_if(F.col("kind") == "method").alias("methods"), F.min("symbol_id").alias("first_id"))


@CORE.add("callers_top3", f"WITH {EDGES} SELECT target_symbol, row_number() OVER (PARTITION BY target_symbol ORDER BY edge_id) AS rank, edge_id, source_repo, source_file, source_symbol, edge_type, line_number FROM edges QUALIFY rank <= 3")
def callers_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_callers(edges(spark, sf_dir))


@CORE.add("callees_top3", f"WITH {EDGES} SELECT source_repo, source_symbol, row_number() OVER (PARTITION BY source_repo, source_symbol ORDER BY edge_id) AS rank, edge_id, target_symbol, target_repo, target_file, edge_type, line_number FROM edges QUALIFY rank <= 3")
def callees_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_callees(edges(spark, sf_dir))


_ASKED_NAME, _ASKED_REPO = "emit_metric", "atlas-core"


@CORE.add("definitions_in_repo", f"WITH {_SIMPLE_SYMBOLS}, n AS (SELECT max(name) AS name FROM latest WHERE repo_id = '{_ASKED_REPO}' AND kind = 'function') SELECT symbol_id, repo_id, l.name, kind, file_path, line_number FROM latest l JOIN n ON l.name = n.name WHERE repo_id = '{_ASKED_REPO}'")
def definitions_in_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a repository defines the last name of its functions."""
    own = symbols(spark, sf_dir)
    name = own.where((F.col("repo_id") == _ASKED_REPO) & (F.col("kind") == "function")).agg(F.max("name")).first()[0]
    return graph.definitions(own, name, _ASKED_REPO).select("symbol_id", "repo_id", "name", "kind", "file_path", "line_number")


@CORE.add("callers_of_hot_symbol", f"WITH {EDGES} SELECT edge_id, source_repo, source_file, source_symbol, line_number FROM edges WHERE target_symbol = '{_ASKED_NAME}'")
def callers_of_hot_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(edges(spark, sf_dir), _ASKED_NAME).select("edge_id", "source_repo", "source_file", "source_symbol", "line_number")


@CORE.add("callees_in_repo", f"WITH {EDGES}, n AS (SELECT source_symbol AS name FROM edges WHERE source_repo = '{_ASKED_REPO}' AND source_symbol IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, name LIMIT 1) SELECT edge_id, target_symbol, target_repo, target_file, line_number FROM edges JOIN n ON source_symbol = n.name WHERE source_repo = '{_ASKED_REPO}'")
def callees_in_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the symbol that calls most in a repository calls."""
    own = edges(spark, sf_dir)
    most = own.where((F.col("source_repo") == _ASKED_REPO) & F.col("source_symbol").isNotNull()).groupBy("source_symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_symbol").first()
    return graph.callees(own, most.source_symbol if most else "", _ASKED_REPO).select("edge_id", "target_symbol", "target_repo", "target_file", "line_number")


@CORE.add(
    "symbol_info",
    f"""WITH {EDGES}, {_SIMPLE_SYMBOLS},
d AS (SELECT repo_id, name, count(*) AS definitions FROM latest WHERE kind <> 'api_endpoint' GROUP BY ALL),
i AS (SELECT target_symbol AS name, count(*) AS callers, count(DISTINCT source_repo) AS caller_repos FROM edges GROUP BY ALL),
o AS (SELECT source_repo AS repo_id, source_symbol AS name, count(*) AS callees FROM edges GROUP BY ALL)
SELECT d.repo_id, d.name, definitions, coalesce(callers, 0) AS callers, coalesce(caller_repos, 0) AS caller_repos, coalesce(callees, 0) AS callees FROM d LEFT JOIN i USING (name) LEFT JOIN o ON o.repo_id = d.repo_id AND o.name = d.name""",
)
def symbol_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = symbols(spark, sf_dir).where("kind <> 'api_endpoint'").groupBy("repo_id", "name").agg(F.count("*").alias("definitions"))
    calls = edges(spark, sf_dir)
    into = calls.groupBy(F.col("target_symbol").alias("name")).agg(F.count("*").alias("callers"), F.count_distinct("source_repo").alias("caller_repos"))
    out = calls.groupBy(F.col("source_repo").alias("repo_id"), F.col("source_symbol").alias("name")).agg(F.count("*").alias("callees"))
    joined = own.join(into, "name", "left").join(out, ["repo_id", "name"], "left")
    return joined.select("repo_id", "name", "definitions", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("callers", "caller_repos", "callees")])


@CORE.add("symbol_centrality", f"WITH {_SIMPLE_SYMBOLS}, {centrality_sql('SELECT name, repo_id AS owner FROM latest')} SELECT name, owner, round(centrality, 6) AS centrality FROM boosts")
def symbol_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = symbols(spark, sf_dir).select("name", F.col("repo_id").alias("owner"))
    return graph.centrality(edges(spark, sf_dir), owners).withColumn("centrality", F.round("centrality", 6))


@CORE.add(
    "cross_repo_links",
    f"""WITH {EDGES}, {_SIMPLE_SYMBOLS} SELECT e.source_repo AS client_repo, e.source_file AS client_file, e.source_symbol AS client_symbol, e.target_symbol AS api_route, e.line_number AS client_line, e.edge_id,
  s.repo_id AS server_repo, s.file_path AS server_file, s.name AS server_symbol, s.line_number AS server_line, s.symbol_id
FROM edges e JOIN latest s ON s.kind = 'api_endpoint' AND e.edge_type = 'CROSS_REPO_API' AND e.source_repo <> s.repo_id AND ({like('s.name', 'e.target_symbol')} OR {like('e.target_symbol', 's.name')})""",
)
def cross_repo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.api_links(edges(spark, sf_dir), symbols(spark, sf_dir))


def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repositories", "repo_id", "name", "url_or_path")


def _dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_dependencies", "repo_id", "depends_on_repo_id", "created_at")


def _reach(steps: str, depth: int) -> str:
    return f"""WITH RECURSIVE steps AS ({steps}), walk(start, repo_id, hops) AS (SELECT repo_id, repo_id, 0 FROM repositories UNION SELECT w.start, s.b, w.hops + 1 FROM walk w JOIN steps s ON s.a = w.repo_id WHERE w.hops < {depth})
SELECT start, repo_id, min(hops) AS hops FROM walk GROUP BY ALL HAVING min(hops) > 0"""


_UP = "SELECT DISTINCT repo_id AS a, depends_on_repo_id AS b FROM repo_dependencies WHERE repo_id <> depends_on_repo_id"
_DOWN = "SELECT DISTINCT depends_on_repo_id AS a, repo_id AS b FROM repo_dependencies WHERE repo_id <> depends_on_repo_id"


def _scopes(direction: str, depth: int, sql: str) -> None:
    @CORE.add(f"scope_{direction}", _reach(sql, depth))
    def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
        starts = _repositories(spark, sf_dir).select(F.col("repo_id").alias("start"), "repo_id")
        return relations.reachable(starts, _dependencies(spark, sf_dir), direction, depth)


_scopes("upstream", 3, _UP)
_scopes("downstream", 3, _DOWN)
_scopes("both", 2, f"{_UP} UNION {_DOWN}")


@CORE.add("dependency_closure", f"WITH RECURSIVE steps AS ({_UP}), walk(start, repo_id) AS (SELECT a, b FROM steps UNION SELECT w.start, s.b FROM walk w JOIN steps s ON s.a = w.repo_id) SELECT * FROM walk")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.closure(_dependencies(spark, sf_dir))


@CORE.add(
    "cycle_check",
    f"""WITH RECURSIVE steps AS ({_UP}), walk(start, repo_id) AS (SELECT a, b FROM steps UNION SELECT w.start, s.b FROM walk w JOIN steps s ON s.a = w.repo_id),
tried AS (SELECT DISTINCT depends_on_repo_id AS repo_id, repo_id AS depends_on_repo_id FROM repo_dependencies UNION SELECT repo_id, repo_id FROM repositories UNION SELECT repo_id, depends_on_repo_id FROM repo_dependencies)
SELECT t.repo_id, t.depends_on_repo_id, CASE WHEN t.repo_id = t.depends_on_repo_id THEN 'self' ELSE 'cycle' END AS reason FROM tried t LEFT JOIN walk w ON w.start = t.depends_on_repo_id AND w.repo_id = t.repo_id
WHERE t.repo_id = t.depends_on_repo_id OR w.start IS NOT NULL""",
)
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dependency turned round, each repository with itself, and those that are there already."""
    there = _dependencies(spark, sf_dir).select("repo_id", "depends_on_repo_id")
    turned = there.select(F.col("depends_on_repo_id").alias("repo_id"), F.col("repo_id").alias("depends_on_repo_id"))
    own = _repositories(spark, sf_dir).select("repo_id", F.col("repo_id").alias("depends_on_repo_id"))
    return relations.rejected_dependencies(turned.unionByName(own).unionByName(there).distinct(), there)


@CORE.add(
    "relation_summary",
    """WITH members AS (SELECT DISTINCT regexp_extract(repo_id, '^([^-]+)', 1) AS group_name, repo_id FROM repositories WHERE source_type <> 'git'), listed AS (SELECT r.repo_id, list_sort(list(DISTINCT m.group_name) FILTER (m.group_name IS NOT NULL)) AS g, list_sort(list(DISTINCT u.depends_on_repo_id) FILTER (u.depends_on_repo_id IS NOT NULL)) AS u, list_sort(list(DISTINCT d.repo_id) FILTER (d.repo_id IS NOT NULL)) AS d
FROM repositories r LEFT JOIN members m ON m.repo_id = r.repo_id LEFT JOIN repo_dependencies u ON u.repo_id = r.repo_id LEFT JOIN repo_dependencies d ON d.depends_on_repo_id = r.repo_id GROUP BY r.repo_id)
SELECT repo_id, coalesce(array_to_string(g, ','), '') AS groups, coalesce(array_to_string(u, ','), '') AS depends_on, coalesce(array_to_string(d, ','), '') AS needed_by FROM listed""",
)
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "repositories", "repo_id", "source_type")
    members = known.where("source_type <> 'git'").select(F.regexp_extract("repo_id", "^([^-]+)", 1).alias("group_name"), "repo_id")
    found = relations.summary(known, _dependencies(spark, sf_dir), members)
    return found.select("repo_id", *[F.array_join(c, ",").alias(c) for c in ("groups", "depends_on", "needed_by")])


@CORE.add(
    "resolve_aliases",
    """WITH given AS (SELECT DISTINCT input, regexp_replace(trim(input), '/+$', '') AS wanted FROM (SELECT upper(name) AS input FROM repositories UNION SELECT url_or_path || '/' FROM repositories UNION SELECT substr(repo_id, 1, 6) FROM repositories UNION SELECT ' ' || repo_id || ' ' FROM repositories UNION SELECT 'no-such-' || commit_hash FROM repositories) WHERE input IS NOT NULL),
pairs AS (SELECT input, repo_id, row_number() OVER (PARTITION BY input ORDER BY name, repo_id) AS n FROM given, (SELECT repo_id, name, coalesce(url_or_path, '') AS url FROM repositories)
  WHERE repo_id = wanted OR lower(name) = lower(wanted) OR contains(url, wanted) OR (url <> '' AND contains(wanted, url)) OR ends_with(wanted, repo_id) OR contains(lower(repo_id), lower(wanted)) OR contains(lower(wanted), lower(repo_id)))
SELECT g.input, coalesce(p.repo_id, g.wanted) AS repo_id FROM given g LEFT JOIN pairs p ON p.input = g.input AND p.n = 1""",
)
def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "repositories", "repo_id", "name", "url_or_path", "commit_hash")
    forms = [F.upper("name"), F.concat("url_or_path", F.lit("/")), F.substring("repo_id", 1, 6), F.concat(F.lit(" "), "repo_id", F.lit(" ")), F.concat(F.lit("no-such-"), "commit_hash")]
    return relations.resolve_aliases(known.select(F.explode(F.array(*forms)).alias("input")), known)


@CORE.add(
    "group_members",
    """WITH members AS (SELECT regexp_extract(repo_id, '^([^-]+)', 1) AS group_name, repo_id FROM repositories UNION SELECT regexp_extract(repo_id, '([^-]+)$', 1), repo_id FROM repositories)
SELECT g.group_name, coalesce(array_to_string(list_sort(list(DISTINCT m.repo_id) FILTER (m.repo_id IS NOT NULL)), ','), '') AS repo_ids, count(DISTINCT m.repo_id) AS size
FROM (SELECT group_name FROM members UNION SELECT source_type || '-empty' FROM repositories) g LEFT JOIN members m USING (group_name) GROUP BY g.group_name""",
)
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "repositories", "repo_id", "source_type")
    members = known.select(F.explode(F.array(F.regexp_extract("repo_id", "^([^-]+)", 1), F.regexp_extract("repo_id", "([^-]+)$", 1))).alias("group_name"), "repo_id").distinct()
    groups = members.select("group_name").unionByName(known.select(F.concat("source_type", F.lit("-empty")).alias("group_name")))
    return relations.group_listing(groups, members).select("group_name", F.array_join("repo_ids", ",").alias("repo_ids"), "size")
