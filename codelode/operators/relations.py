"""Repository relations: search scopes over dependencies and groups, aliases, and checks on changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import broadcast_if_small, cut

HOP_DECAY = 0.85


class RelationError(ValueError):
    """A change to groups or dependencies that is not allowed."""


class UnknownGroup(RelationError):
    pass


class UnknownRepository(RelationError):
    pass


class DependencyCycle(RelationError):
    pass


@dataclass(frozen=True)
class Scope:
    """The repositories of a search: rows is (repo_id, relation, direction, hops), or None for all of them."""

    rows: DataFrame | None

    @property
    def unscoped(self) -> bool:
        return self.rows is None

    def filter(self, frame: DataFrame, column: str = "repo_id") -> DataFrame:
        return frame if self.rows is None else frame.join(broadcast_if_small(self.rows.select(F.col("repo_id").alias(column))), column, "left_semi")


def steps(dependencies: DataFrame, direction: str) -> DataFrame:
    """(at, to): one step upstream (to what a repository needs), downstream (to what needs it), or both ways."""
    up = dependencies.select(F.col("repo_id").alias("at"), F.col("depends_on_repo_id").alias("to"))
    down = up.select(F.col("to").alias("at"), F.col("at").alias("to"))
    edges = {"upstream": up, "downstream": down, "both": up.unionByName(down)}[direction]
    return edges.where("at IS NOT NULL AND to IS NOT NULL AND at <> to").distinct()


def reachable(starts: DataFrame, dependencies: DataFrame, direction: str, depth: int | None = None) -> DataFrame:
    """(start, repo_id, hops): what can be reached from each set of starting points (start, repo_id), at the fewest hops.

    The starting points themselves are left out. One join per hop over only what was new at the hop before; without
    a depth it goes on until nothing is new.
    """
    edges = steps(dependencies, direction)
    seen = starts.select("start", "repo_id").distinct().withColumn("hops", F.lit(0))
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        new = frontier.join(edges, F.col("repo_id") == F.col("at")).select("start", F.col("to").alias("repo_id")).distinct()
        frontier = new.join(seen.select("start", "repo_id"), ["start", "repo_id"], "left_anti").withColumn("hops", F.lit(hop))
        if depth is None or hop < depth:
            frontier = cut(frontier)
            if not frontier.limit(1).count():
                break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def closure(dependencies: DataFrame) -> DataFrame:
    """(start, repo_id): all that each repository depends on, also by way of others; ends also on cycles.

    The length of the paths doubles in each round.
    """
    known = cut(steps(dependencies, "upstream").select(F.col("at").alias("start"), F.col("to").alias("repo_id")))
    size = known.count()
    while True:
        longer = known.join(known.select(F.col("start").alias("repo_id"), F.col("repo_id").alias("further")), "repo_id").select("start", F.col("further").alias("repo_id"))
        known = cut(known.unionByName(longer).distinct())
        grown = known.count()
        if grown == size:
            return known
        size = grown


def rejected_dependencies(candidates: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo_id, depends_on_repo_id, reason) of candidates that are a loop or would close a cycle.

    Only from what the candidates would depend on the graph is walked, step by step, until nothing new is met.
    """
    tried = candidates.select("repo_id", "depends_on_repo_id").distinct()
    starts = tried.where("repo_id <> depends_on_repo_id").select(F.col("depends_on_repo_id").alias("start"), F.col("depends_on_repo_id").alias("repo_id"))
    reached = reachable(starts, dependencies, "upstream").select(F.col("start").alias("depends_on_repo_id"), "repo_id", F.lit(True).alias("back"))
    reason = F.when(F.col("repo_id") == F.col("depends_on_repo_id"), "self").when(F.col("back"), "cycle")
    return candidates.join(reached, ["repo_id", "depends_on_repo_id"], "left").withColumn("reason", reason).where("reason IS NOT NULL").select("repo_id", "depends_on_repo_id", "reason")


def resolve_scope(repositories: DataFrame, dependencies: DataFrame, members: DataFrame, repo_ids: list[str] | None = None, groups: list[str] | None = None, expand: str = "none", depth: int = 1) -> Scope:
    """The scope of a request. No repositories and no groups is everything; an empty list is nothing.

    Unknown repositories are left out, an unknown group is an error, another word for expand is none.
    """
    if repo_ids is None and not groups:
        return Scope(None)
    spark = repositories.sparkSession
    named = spark.createDataFrame([(r,) for r in repo_ids or []], "repo_id string")
    if groups:
        known = {r.group_name for r in members.select("group_name").where(F.col("group_name").isin(groups)).distinct().collect()}
        if missing := [g for g in groups if g not in known]:
            raise UnknownGroup(missing[0])
        named = named.unionByName(members.where(F.col("group_name").isin(groups)).select("repo_id"))
    primary = named.join(repositories.select("repo_id"), "repo_id", "left_semi").distinct()
    rows = primary.select("repo_id", F.lit("primary").alias("relation"), F.lit(None).cast("string").alias("direction"), F.lit(0).alias("hops"))
    if expand in ("upstream", "downstream", "both") and depth > 0:
        found = reachable(primary.withColumn("start", F.lit("all")), dependencies, expand, depth)
        found = found.join(repositories.select("repo_id"), "repo_id", "left_semi")
        rows = rows.unionByName(found.select("repo_id", F.lit("expanded").alias("relation"), F.lit(expand).alias("direction"), "hops"))
    # a row per repository, taken by each step of a search; without the cut each would resolve it, and the driver broadcast it, anew
    return Scope(cut(rows))


def resolve_aliases(inputs: DataFrame, repositories: DataFrame) -> DataFrame:
    """(input, repo_id): for each loose name of a repository the first repository, by name, that fits in any way.

    An input that fits none is returned as it is. Inputs are what a user typed: their number is checked.
    """
    given = inputs.select("input", F.regexp_replace(F.trim("input"), "/+$", "").alias("wanted")).where("input IS NOT NULL").distinct()
    known = repositories.select("repo_id", "name", "url_or_path").dropDuplicates(["repo_id"])
    wanted, url = F.col("wanted"), F.coalesce("url_or_path", F.lit(""))
    low, repo = F.lower("wanted"), F.lower("repo_id")
    fits = (
        (F.col("repo_id") == wanted) | (F.lower("name") == low) | F.contains(url, wanted) | ((url != "") & F.contains(wanted, url)) | F.endswith(wanted, F.col("repo_id"))
        | F.contains(repo, low) | F.contains(low, repo)
    )
    pairs = known.join(broadcast_if_small(given), fits)
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("input").orderBy("name", "repo_id"))).where("n = 1").select("input", F.col("repo_id").alias("found"))
    return given.join(first, "input", "left").select("input", F.coalesce("found", "wanted").alias("repo_id"))


def group_listing(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_name, repo_ids, size): each group with its members in order, also without any."""
    own = members.where("repo_id IS NOT NULL").groupBy("group_name").agg(F.array_sort(F.collect_set("repo_id")).alias("repo_ids"))
    return groups.select("group_name").distinct().join(own, "group_name", "left").select("group_name", F.coalesce("repo_ids", F.array().cast("array<string>")).alias("repo_ids")).withColumn("size", F.size("repo_ids"))


def summary(repositories: DataFrame, dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """(repo_id, groups, depends_on, needed_by): for each repository the names of all three, in order."""

    def listed(frame: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return frame.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("repo_id")).agg(F.array_sort(F.collect_set(value)).alias(name))

    out = repositories.select("repo_id").distinct()
    for part in (listed(members, "repo_id", "group_name", "groups"), listed(dependencies, "repo_id", "depends_on_repo_id", "depends_on"), listed(dependencies.select(F.col("repo_id").alias("__by"), "depends_on_repo_id"), "depends_on_repo_id", "__by", "needed_by")):
        out = out.join(part, "repo_id", "left")
    none = F.array().cast("array<string>")
    return out.select("repo_id", *[F.coalesce(c, none).alias(c) for c in ("groups", "depends_on", "needed_by")])
