"""The most similar vectors of every vector, by navigable small-world graphs per shard.

Vectors are cut into cells around centroids that are fitted on a bounded sample. Each cell is a shard (a
cell that came out far too large is several, by a hash), and a task builds one graph per shard, in flat
neighbour arrays. A vector is searched in its own shard, where the search starts at its own node, and in
the shards of cells whose centroid is nearly as near as its own (``margin``), ``MOST_CELLS`` at most, the
nearest first. What either of two vectors found of the other counts for both. The results of all shards are
merged. Queries are streamed past a graph batch by batch, so a shard with very many queries needs no more
memory than others.

A shard has about ``SHARD_ROWS`` vectors, so the work grows about as their number. Beyond ``MAX_CELLS`` times
as many a cell has several shards, and the searches in them grow; no vector is left out.

Equal vectors are one class: the class takes part once, under its smallest id, and its copies are put in
again at the end, by at most k pairs for each. So a vector that a third of all rows have costs no more
than others. ``members`` tells the class of every id.

Defined results: text that is no JSON array of exactly 64 finite numbers, or holds only zeros, is no
vector; null and empty text neither. Repeated rows of an id count once, the smallest vector of different
ones deciding. Ties of similarity are ordered by id. Vectors are compared in single precision. Without
vectors there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.hnsw import Graph
from codelode.session import cut, spread

DIMENSIONS = 64
K = 5
SHARD_ROWS = 4096
MAX_CELLS = 8192
#: Vectors per cell in the sample on which centroids are fitted; so it has at most MAX_CELLS * FIT_ROWS vectors (67 MB).
FIT_ROWS = 32
#: How much less similar than its own another centroid may be for its cell to be searched too, and in how many at most.
MARGIN = 0.3
MOST_CELLS = 16
#: The same margin for partners of a similarity of 0.945 or more. Of two such vectors in different cells, one is as near
#: to the other's centroid but for half of what their difference is worth along the line between both centroids, and
#: that is more than this in about one of 300 pairs that a boundary parts.
CLOSE_MARGIN = 0.08
#: Candidates for the links of a node.
BREADTH = 48
#: Breadths of a search: at the vector's own node, and in other shards. In a group of hundreds of vectors that are all
#: alike, a narrow search stops before it has met the nearest of them.
BREADTHS = (24, 48)
LINKS = 16
#: Share of all rows from which a vector is a hot one, whose class is broadcast; there can be at most one through it.
HEAVY_SHARE = 0.001


def parse(text: str | None) -> bytes | None:
    """The vector of length one that the text holds, as single-precision numbers, or null."""
    if not text:
        return None
    try:
        values = json.loads(text)
        if type(values) is not list or len(values) != DIMENSIONS or not set(map(type, values)) <= {int, float}:
            return None
        most = max(map(abs, map(float, values)))
        if not most or not math.isfinite(most) or not all(map(math.isfinite, values)):
            return None
        v = np.array(values, dtype=np.float64) / most
        return (v / np.sqrt(v @ v)).astype(np.float32).tobytes()
    except (ValueError, OverflowError, RecursionError):
        return None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for vec, column in (("sig", batch.sig_embedding_json), ("body", batch.body_embedding_json)):
            found = [(i, v) for i, v in zip(batch.chunk_id, map(parse, column)) if v is not None]
            if found:
                yield pd.DataFrame({"vec": vec, "id": [i for i, _ in found], "v": [v for _, v in found]})


def vectors(chunks: DataFrame) -> DataFrame:
    """(vec, id, v, key): the vectors of the chunks, once per id; key tells equal vectors."""
    raw = spread(chunks.where("chunk_id IS NOT NULL").select("chunk_id", "sig_embedding_json", "body_embedding_json")).mapInPandas(_parse, "vec string, id string, v binary")
    return cut(raw.groupBy("vec", "id").agg(F.min("v").alias("v")).withColumn("key", F.unhex(F.sha2("v", 256))))


def _blocks(vectors: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of the vectors with all centroids, so many vectors at a time that they take 32 MB."""
    step = max(1, (1 << 23) // max(1, len(centroids)))
    for low in range(0, len(vectors), step):
        yield slice(low, low + step), vectors[low : low + step] @ centroids.T


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), dtype=np.int64)
    for rows, sims in _blocks(vectors, centroids):
        out[rows] = sims.argmax(axis=1)
    return out


def _kmeans(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length one; many are fitted in two steps, coarse cells first and then those inside each."""
    draws = np.random.default_rng(0)
    sample = np.unique(sample, axis=0)
    if cells > 256:
        coarse = _kmeans(sample, round(math.sqrt(cells)), rounds)
        home = _nearest(sample, coarse)
        parts = [sample[home == i] for i in range(len(coarse))]
        return np.concatenate([_kmeans(part, max(1, round(cells * len(part) / len(sample))), rounds) for part in parts if len(part)])
    centroids = sample[draws.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        np.add.at(sums, _nearest(sample, centroids), sample)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 1e-6, sums / np.maximum(lengths, 1e-6), centroids)
    return np.ascontiguousarray(centroids, dtype=np.float32)


Cells = dict[str, tuple[np.ndarray, np.ndarray]]  # per kind of vector: centroids, and shards of each cell


def fit_cells(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> Cells:
    """The centroids of the cells, from a sample by a hash of the id, and how many shards each cell needs."""
    out: Cells = {}
    counts = {r.vec: (r.n, r.all) for r in rows.groupBy("vec").agg(F.approx_count_distinct("key", 0.02).alias("n"), F.count("*").alias("all")).collect()}
    for vec, (n, every) in sorted(counts.items()):
        cells = max(1, min(MAX_CELLS, round(n / shard_rows)))
        share = min(1.0, cells * FIT_ROWS / every)
        chosen = rows.where((F.col("vec") == vec) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))).select("v").toPandas()
        sample = np.frombuffer(b"".join(chosen.v), dtype=np.float32).reshape(-1, DIMENSIONS)
        if not len(sample):
            sample = np.eye(1, DIMENSIONS, dtype=np.float32)
        centroids = _kmeans(sample, cells)
        distinct = np.unique(sample, axis=0)
        filled = np.bincount(_nearest(distinct, centroids), minlength=len(centroids)) * n / len(distinct)
        out[vec] = centroids, np.maximum(1, np.ceil(filled / (2 * shard_rows))).astype(np.int64)
    return out


def _assign(cells: Cells, margin: float, most: int):
    """Rows of a class for its own shard (role 0) and for all others in which it is searched (role 1)."""
    bases, base = {}, 0
    for vec, (_, shards) in cells.items():
        bases[vec] = base + np.concatenate(([0], np.cumsum(shards)[:-1]))
        base += int(shards.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for vec, whole in batch.groupby("vec"):
                centroids, shards = cells[vec]
                v = np.frombuffer(b"".join(whole.v), dtype=np.float32).reshape(-1, DIMENSIONS)
                for rows, sims in _blocks(v, centroids):
                    own = whole.iloc[rows]
                    home_cell = sims.argmax(axis=1)
                    near = sims >= sims.max(axis=1, keepdims=True) - margin
                    if sims.shape[1] > most:
                        near &= sims >= np.partition(sims, sims.shape[1] - most, axis=1)[:, [sims.shape[1] - most]]
                    row, cell = np.nonzero(near)
                    home = bases[vec][home_cell] + own.no.to_numpy() % shards[home_cell]
                    times = shards[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    shard = bases[vec][cell] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))
                    yield pd.DataFrame({"shard": shard.astype(np.int32), "role": (shard != home[row]).astype(np.int8), "no": own.no.to_numpy()[row], "v": own.v.to_numpy()[row]})

    return run


def _answer(k: int, breadth: int, breadths: tuple[int, int], links: int, least: float):
    """Builds the graph of each shard of a partition and streams the queries of the shard past it."""

    def matrix(parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), dtype=np.float32).reshape(-1, DIMENSIONS)

    def rows(asked: np.ndarray, names: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        row, place = np.nonzero((found[0] >= 0) & (found[1] >= least))
        return pd.DataFrame({"no": asked[row], "other_no": names[found[0][row, place]], "similarity": found[1][row, place]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, names, parts, graph = None, [], [], None

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal graph, names
            if graph is None and names:
                graph, names = Graph(matrix(parts), links, breadth, seed=shard), np.array(names, dtype=np.int64)
                yield rows(names, names, graph.search(graph.vectors, k, breadths[0], np.arange(len(names)), least))

        for batch in batches:
            # the rows of a partition are in order of shard and role
            for (number, role), own in batch.groupby(["shard", "role"], sort=True):
                if number != shard:
                    yield from finish()
                    shard, names, parts, graph = int(number), [], [], None
                if role == 0:
                    names.extend(own.no)
                    parts.extend(own.v)
                    continue
                yield from finish()
                if graph is not None:
                    yield rows(own.no.to_numpy(), names, graph.search(matrix(list(own.v)), k, breadths[1], least=least))
        yield from finish()

    return run


def classes(rows: DataFrame) -> DataFrame:
    """(vec, key, id, v, copies): each distinct vector once, under its smallest id."""
    return rows.groupBy("vec", "key").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("copies"))


def members(rows: DataFrame) -> DataFrame:
    """(vec, id, class_id, copies): the class of each id, and how many ids are in it; a hot class is spread by id."""
    return _with_classes(rows, classes(rows).select("vec", "key", F.col("id").alias("class_id"), "copies"), HEAVY_SHARE).select("vec", "id", "class_id", "copies")


def _with_classes(rows: DataFrame, known: DataFrame, heavy_share: float) -> DataFrame:
    """rows joined by vec and key with one row per class (with copies); hot classes, of which there cannot be many, are broadcast."""
    hot, keys = F.col("copies") > rows.count() * heavy_share, ["vec", "key"]
    heavy = known.where(hot)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(known.where(~hot), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def neighbours(
    rows: DataFrame, k: int = K, margin: float = MARGIN, breadth: int = BREADTH, breadths: tuple[int, int] = BREADTHS, links: int = LINKS, least: float = -1.0, shard_rows: int = SHARD_ROWS, most: int = MOST_CELLS
) -> DataFrame:
    """(vec, id, other, similarity, rank): the k most similar other classes of each class, by their smallest ids.

    breadth is that of building a graph, breadths those of searching it for its own nodes and for others.
    """
    cells = fit_cells(rows, shard_rows)
    shards = sum(int(s.sum()) for _, s in cells.values())
    # numbers stand for ids until the end; they are fixed by the checkpoint
    base = cut(classes(rows).select("vec", "id", "v", F.monotonically_increasing_id().alias("no")))
    placed = base.select("vec", "no", "v").mapInPandas(_assign(cells, margin, most), "shard int, role byte, no long, v binary")
    # with a number, so that small shards are not put together: each is seconds of work
    spread = placed.repartition(max(1, 3 * shards), "shard").sortWithinPartitions("shard", "role")
    found = spread.mapInPandas(_answer(k, breadth, breadths, links, least), "no long, other_no long, similarity float")
    # what one side found counts for both; a pair that both found is twice among the first 2k
    both = found.select(F.explode(F.array(F.struct("no", "other_no", "similarity"), F.struct(F.col("other_no").alias("no"), F.col("no").alias("other_no"), "similarity"))).alias("x")).select("x.*")
    first = both.withColumn("place", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("similarity"), "other_no"))).where(F.col("place") <= 2 * k + 2)
    once = first.groupBy("no", "other_no").agg(F.max("similarity").cast("double").alias("similarity"))
    names = base.select("vec", "id", "no")
    named = once.join(names.select(F.col("no").alias("other_no"), F.col("id").alias("other")), "other_no").join(names, "no")
    order = Window.partitionBy("vec", "id").orderBy(F.desc("similarity"), "other")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec", "id", "other", "similarity", "rank")


def close_pairs(rows: DataFrame, least: float, k: int = K, margin: float = CLOSE_MARGIN, shard_rows: int = SHARD_ROWS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(vec, a, b): pairs of ids of at least the similarity, one being among the k most similar of the other; a < b.

    Copies come first: one of many copies has the k smallest ids of the others as its most similar.
    """
    near = cut(neighbours(rows, k, margin, least=least, shard_rows=shard_rows))
    copies = rows.select("vec", "key", "id").withColumn("n", F.row_number().over(Window.partitionBy("vec", "key").orderBy("id"))).where(F.col("n") <= k + 1)
    counts = rows.groupBy("vec", "key").agg(F.count("*").alias("copies"))
    heads = cut(copies.groupBy("vec", "key").agg(F.array_sort(F.collect_list("id")).alias("heads")).join(counts, ["vec", "key"]))  # k + 1 ids at most
    own = _with_classes(rows.select("vec", "key", "id"), heads.where(F.size("heads") > 1), heavy_share)
    among = own.select("vec", "id", F.explode(F.slice(F.array_remove("heads", F.col("id")), 1, k)).alias("other"))
    ids = heads.select("vec", F.element_at("heads", 1).alias("id"), "heads")
    linked = (
        near.join(ids, ["vec", "id"])
        .join(ids.select("vec", F.col("id").alias("other"), F.col("heads").alias("theirs")), ["vec", "other"])
        .where(F.size("heads") <= k)
    )
    # what copies leave of the k places goes to the classes in their order
    before = F.coalesce(F.sum(F.size("theirs")).over(Window.partitionBy("vec", "id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = linked.withColumn("left", F.lit(k) - (F.size("heads") - 1) - before).where("left > 0")
    across = places.select("vec", F.explode("heads").alias("id"), "theirs", "left").select("vec", "id", F.explode(F.slice("theirs", F.lit(1), F.col("left").cast("int"))).alias("other"))
    every = among.unionByName(across)
    return every.select("vec", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def most_similar(base: DataFrame, k: int = K, every: int = 50, bucket_rows: int = 20_000) -> DataFrame:
    """(vec, id, other, similarity): the k truly most similar of one in so many ids of (vec, id, v), by brute force.

    The queries, a stated set, are held against all rows: each bucket of about so many rows gets all of them.
    """
    buckets = max(1, base.count() // bucket_rows)
    queries = base.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vec", "id", "v")
    spread = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    data = base.select("vec", "id", "v", F.pmod(F.xxhash64("id", "vec"), F.lit(buckets)).cast("int").alias("bucket"))

    def brute(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        v = np.frombuffer(b"".join(own.v), dtype=np.float32).reshape(-1, DIMENSIONS)
        names = own.id.to_numpy()
        for low in range(0, len(asked), 512):
            part = asked.iloc[low : low + 512]
            sims = np.frombuffer(b"".join(part.v), dtype=np.float32).reshape(-1, DIMENSIONS) @ v.T
            sims[part.id.to_numpy()[:, None] == names[None, :]] = -np.inf
            best = np.argsort(-sims, axis=1)[:, :k]
            for i, row in enumerate(best):
                out.extend((part.vec.iloc[i], part.id.iloc[i], names[j], float(sims[i, j])) for j in row if sims[i, j] > -np.inf)
        return pd.DataFrame(out, columns=["vec", "id", "other", "similarity"])

    exact = spread.groupBy("vec", "bucket").cogroup(data.groupBy("vec", "bucket")).applyInPandas(brute, "vec string, id string, other string, similarity double")
    return exact.withColumn("rank", F.row_number().over(Window.partitionBy("vec", "id").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k).drop("rank")


def recall(rows: DataFrame, found: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    """(vec, queries, recall): how many of the k truly most similar classes were found, for one in so many ids."""
    top = most_similar(classes(rows), k, every)
    hits = top.join(found.select("vec", "id", "other", F.lit(1).alias("hit")), ["vec", "id", "other"], "left")
    return hits.groupBy("vec").agg(F.countDistinct("id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


def pair_recall(rows: DataFrame, pairs: DataFrame, least: float, k: int = K, every: int = 50) -> DataFrame:
    """(vec, kind, queries, recall): how many of the pairs with the k truly most similar ids were found, copies apart."""
    asked = most_similar(rows.select("vec", "id", "v"), k, every).where(F.col("similarity") >= least)
    keys = rows.select("vec", "id", "key")
    kinds = asked.join(keys, ["vec", "id"]).join(keys.select("vec", F.col("id").alias("other"), F.col("key").alias("theirs")), ["vec", "other"])
    # of many copies all are equally near, so any k of them will do
    usual = kinds.where("key <> theirs").select("vec", "id", F.lit("others").alias("kind"), F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    hits = usual.join(pairs.withColumn("hit", F.lit(1)), ["vec", "a", "b"], "left").groupBy("vec", "kind", "id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    wanted = kinds.where("key = theirs").groupBy("vec", "id", "key").agg(F.count("*").alias("n"))
    sides = pairs.select("vec", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("x")).select("vec", "x.*")
    got = sides.join(wanted.select("vec", "id", "key"), ["vec", "id"]).join(keys.select("vec", F.col("id").alias("other"), F.col("key").alias("theirs")), ["vec", "other"]).where("key = theirs").groupBy("vec", "id").agg(F.count("*").alias("hits"))
    copies = wanted.join(got, ["vec", "id"], "left").select("vec", F.lit("copies").alias("kind"), "id", "n", F.least("n", F.coalesce("hits", F.lit(0))).alias("hits"))
    return hits.unionByName(copies).groupBy("vec", "kind").agg(F.count("*").alias("queries"), (F.sum("hits") / F.sum("n")).alias("recall"))
