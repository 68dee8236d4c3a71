"""The symbol graph: definitions, callers, callees, centrality, and links between repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import contains_like, fold
from codelode.session import BROADCAST_BYTES, cut, small

CENTRALITY_STEP, CENTRALITY_CAP, FOREIGN_FACTOR = 0.02, 0.08, 1.8
GRAM = 4


def latest_symbols(symbols: DataFrame) -> DataFrame:
    """The row of each symbol_id with the latest indexed_at."""
    rest = [c for c in symbols.columns if c not in ("symbol_id", "indexed_at")]
    return symbols.groupBy("symbol_id").agg(F.max(F.struct("indexed_at", *rest)).alias("row")).select("symbol_id", "row.*")


def first_edges(edges: DataFrame) -> DataFrame:
    """The row of each edge_id with the earliest indexed_at."""
    rest = [c for c in edges.columns if c not in ("edge_id", "indexed_at")]
    return edges.groupBy("edge_id").agg(F.min(F.struct("indexed_at", *rest)).alias("row")).select("edge_id", "row.*")


def definitions(symbols: DataFrame, name: str, repo_id: str | None = None) -> DataFrame:
    found = symbols.where(F.col("name") == name)
    return found if repo_id is None else found.where(F.col("repo_id") == repo_id)


def callers(edges: DataFrame, target: str, repo_id: str | None = None) -> DataFrame:
    found = edges.where(F.col("target_symbol") == target)
    return found if repo_id is None else found.where(F.col("source_repo") == repo_id)


def callees(edges: DataFrame, source: str, repo_id: str) -> DataFrame:
    return edges.where((F.col("source_repo") == repo_id) & (F.col("source_symbol") == source))


def first_callers(edges: DataFrame, n: int = 3) -> DataFrame:
    """(target_symbol, rank, edge_id, ...): the first n edges into each symbol; Spark cuts hot ones before the shuffle."""
    order = Window.partitionBy("target_symbol").orderBy("edge_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("target_symbol", "rank", "edge_id", "source_repo", "source_file", "source_symbol", "edge_type", "line_number")


def first_callees(edges: DataFrame, n: int = 3) -> DataFrame:
    """(source_repo, source_symbol, rank, edge_id, ...): the first n edges out of each symbol."""
    order = Window.partitionBy("source_repo", "source_symbol").orderBy("edge_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("source_repo", "source_symbol", "rank", "edge_id", "target_symbol", "target_repo", "target_file", "edge_type", "line_number")


def _grams(text: Column, n: int) -> Column:
    """The different stretches of n letters of a text; of a shorter text none."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs of a text and a name that it contains (see contains_like), without comparing all with all.

    A name is looked up by GRAM of its letters (all of them if it has a shorter run only) that stand together between
    wild characters, as any text that contains it has them too: by those that the fewest texts have. Names
    of nothing but wild characters fit every text that is long enough; they are looked up by the empty gram.

    Spark takes grams to be as small as the texts they are made of, of which each has dozens, and would broadcast them
    from the driver. So they never are; only counted names are.
    """
    low = texts.withColumn("__low", fold(F.col(text)))
    runs = F.split(fold(F.col(name)), "[%_]")
    keyed = names.withColumns({"__parts": runs, "__most": F.array_max(F.transform(runs, F.length))})
    grams = low.withColumn("__gram", F.explode(F.concat(F.array(F.lit("")), *[_grams(F.col("__low"), n) for n in range(1, GRAM + 1)])))
    counts = grams.groupBy("__gram").agg(F.count("*").alias("__n")).hint("merge")
    own = F.flatten(F.transform("__parts", lambda r: F.when(F.col("__most") >= GRAM, _grams(r, GRAM)).when(F.length(r) == F.col("__most"), F.array(r)).otherwise(F.array().cast("array<string>"))))
    # a gram that no text has is in no count: its name is in no text
    wanted = keyed.select(F.col(name).alias("__name"), F.explode(F.array_distinct(own)).alias("__gram")).distinct()
    found = wanted.join(counts, "__gram", "left").groupBy("__name").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__gram")).alias("x")).where("x.n > 0")
    rarest = keyed.join(found.select(F.col("__name").alias(name), F.col("x.__gram").alias("__gram")), name).drop("__most")
    # a row of it holds its name twice
    rarest = F.broadcast(rarest) if small(names, size=BROADCAST_BYTES // 4) else rarest.hint("merge")
    # LIKE builds a pattern for each pair, so only pairs come to it that have all runs, and only names with wild characters
    likely = grams.join(rarest, "__gram").where(F.forall("__parts", lambda r: F.contains(F.col("__low"), r)))
    return likely.where(F.when(F.size("__parts") > 1, contains_like(F.col(text), F.col(name))).otherwise(True)).drop("__gram", "__parts", "__low")


def centrality(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(name, owner, centrality): how much the symbols of a name are called, for owners (name, owner) of interest.

    Edges count whose target contains the name. Calls are added up per target and repository first.
    """
    calls = edges.where("target_symbol IS NOT NULL").groupBy("target_symbol", "source_repo").agg(F.count("*").alias("n"))
    names = cut(owners.select("name").where("name <> ''").distinct())
    targets = calls.select("target_symbol").distinct()
    pairs = containing(targets, "target_symbol", names, "name")
    per_repo = pairs.join(calls.hint("merge"), "target_symbol").groupBy("name", "source_repo").agg(F.sum("n").alias("n"))
    usage = per_repo.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.min("source_repo").alias("one"))
    foreign = (F.col("repos") > 1) | (F.col("owner").isNotNull() & (F.col("one") != F.col("owner")))
    score = F.ln(F.lit(1.0) + F.col("n")) * CENTRALITY_STEP * F.when(foreign, FOREIGN_FACTOR).otherwise(1.0)
    return owners.distinct().join(usage, "name", "left").select("name", "owner", F.least(F.lit(CENTRALITY_CAP), F.coalesce(score, F.lit(0.0))).alias("centrality"))


def api_links(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of one repository to the endpoint of another: the path of either contains that of the other."""
    client = edges.where(F.col("edge_type") == "CROSS_REPO_API").select(F.col("source_repo").alias("client_repo"), F.col("source_file").alias("client_file"), F.col("source_symbol").alias("client_symbol"), F.col("target_symbol").alias("api_route"), F.col("line_number").alias("client_line"), "edge_id")
    server = symbols.where(F.col("kind") == "api_endpoint").select(F.col("repo_id").alias("server_repo"), F.col("file_path").alias("server_file"), F.col("name").alias("server_symbol"), F.col("line_number").alias("server_line"), "symbol_id")
    routes, names = client.select("api_route").where("api_route IS NOT NULL").distinct(), server.select("server_symbol").where("server_symbol IS NOT NULL").distinct()
    pairs = containing(names, "server_symbol", routes, "api_route").unionByName(containing(routes, "api_route", names, "server_symbol")).distinct()
    return client.join(pairs, "api_route").join(server, "server_symbol").where(F.col("client_repo") != F.col("server_repo"))
