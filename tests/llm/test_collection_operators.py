"""Neighbours, files not written by hand, mixtures: brute force, and edge cases in Spark."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import handwritten, mixing, similar
from codelode.llm.hnsw import Graph

# ---------------------------------------------------------------- neighbours


def unit(rng, n):
    v = rng.normal(size=(n, 64)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def truth(vectors, queries, k, own=None):
    sims = queries @ vectors.T
    if own is not None:
        sims[np.arange(len(queries)), own] = -np.inf
    return np.argsort(-sims, axis=1)[:, :k]


@pytest.mark.parametrize("n", [1, 2, 5, 60, 700, 2500])
def test_graph_recall(n):
    rng = np.random.default_rng(n)
    vectors = unit(rng, n)
    graph = Graph(vectors)
    k = min(5, n - 1)
    if k:
        ids, sims = graph.search(vectors, k, 48, np.arange(n))
        expected = truth(vectors, vectors, k, np.arange(n))
        assert np.mean([len(set(a) & set(b)) / k for a, b in zip(ids, expected)]) >= (0.85 if n > 1000 else 0.97)
        assert (np.diff(sims, axis=1) <= 0).all() and (ids != np.arange(n)[:, None]).all()
    other = unit(rng, 50)
    ids, _ = graph.search(other, min(5, n), 48)
    expected = truth(vectors, other, min(5, n))
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(ids, expected)]) >= 0.8


def test_graph_of_equal_vectors():
    graph = Graph(np.repeat(unit(np.random.default_rng(0), 1), 400, axis=0))
    ids, sims = graph.search(graph.vectors, 3, 16, np.arange(400))
    assert (ids >= 0).all() and np.allclose(sims, 1, atol=1e-5)
    assert Graph(np.zeros((0, 64), dtype=np.float32)).search(np.zeros((2, 64), dtype=np.float32), 3, 8)[0].tolist() == [[-1] * 3] * 2


@pytest.mark.parametrize("text", [None, "", "[]", "null", "[" + ",".join(["0.0"] * 64) + "]", "[" + ",".join(["1"] * 63) + "]", "[" + ",".join(["1"] * 65) + "]", "[" + ",".join(["1"] * 63 + ["NaN"]) + "]", "[" + ",".join(["1"] * 63 + ["1e999"]) + "]",
                                  "[" + ",".join(["1"] * 63 + ['"2"']) + "]", "[" + ",".join(["1"] * 63 + ["true"]) + "]", "[" + ",".join(["1"] * 63 + ["null"]) + "]", "[" + ",".join(["1"] * 63), "{}", "[" * 5000])
def test_no_vector(text):
    assert similar.parse(text) is None


def test_parse_scales():
    for values in ([1] * 64, [1e-200] * 64, [1e300] * 64, [3.5e1] * 64):
        assert np.allclose(np.frombuffer(similar.parse(json.dumps(values)), dtype=np.float32), 0.125)


def chunk_frame(spark, vectors, extra=()):
    rows = [(f"c{i:05d}", json.dumps([round(float(x), 5) for x in v]), None) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *extra], "chunk_id string, sig_embedding_json string, body_embedding_json string")


def test_close_pairs_match_brute_force(spark, clashing):
    rng = np.random.default_rng(3)
    base = unit(rng, 900)
    near = base[:60] + rng.normal(size=(60, 64)).astype(np.float32) * 0.02
    same = np.repeat(base[100:103], [2, 5, 40], axis=0)  # a few copies, and a hot vector
    vectors = np.concatenate((base, near, same))
    frame = clashing(chunk_frame(spark, vectors, [("x1", "[]", ""), ("x2", None, "[1"), (None, "[" + ",".join(["1"] * 64) + "]", None), ("c00000", chunk_json(vectors[0]), None)]))
    rows = similar.vectors(frame)
    assert rows.count() == len(vectors)
    pairs = similar.close_pairs(rows, 0.945)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert {(r.a, r.b) for r in similar.close_pairs(rows, 0.945, heavy_share=1.0).collect()} == found  # no class is broadcast
    measured = {r.kind: r.recall for r in similar.pair_recall(rows, pairs, 0.945, every=1).collect()}
    assert measured == {"others": 1.0, "copies": 1.0}
    assert {r.kind: r.recall for r in similar.pair_recall(rows, pairs.limit(0), 0.945, every=1).collect()} == {"others": 0.0, "copies": 0.0}
    told = {r.id: (r.class_id, r.copies) for r in similar.members(rows).collect()}
    assert len(told) == len(vectors) and told["c01000"] == ("c00102", 41) and told["c00005"] == ("c00005", 1)
    stored = np.array([np.frombuffer(similar.parse(chunk_json(v)), dtype=np.float32) for v in vectors])
    sims = np.round((stored @ stored.T).astype(np.float64), 6)
    np.fill_diagonal(sims, -1)
    expected = set()
    for i in range(len(vectors)):
        order = sorted(np.flatnonzero(sims[i] >= 0.945), key=lambda j: (-sims[i, j], j))[:5]
        expected |= {(f"c{min(i, j):05d}", f"c{max(i, j):05d}") for j in order}
    assert found == expected


def chunk_json(v):
    return json.dumps([round(float(x), 5) for x in v])


def test_shards_and_recall(spark):
    rng = np.random.default_rng(5)
    centres = unit(rng, 12)
    vectors = centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 64)).astype(np.float32) * 0.12
    rows = similar.vectors(chunk_frame(spark, vectors))
    found = similar.neighbours(rows, shard_rows=500)
    assert similar.recall(rows, found, every=10).first().recall >= 0.95
    assert found.groupBy("id").count().where("count > 5").count() == 0


def test_recall_of_many_cells(spark):
    """Real vectors in about 500 cells."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/chunks_v2.parquet").select("chunk_id", "sig_embedding_json", F.lit(None).cast("string").alias("body_embedding_json"))
    rows = similar.vectors(chunks)
    shard_rows = rows.count() // 500
    assert similar.recall(rows, similar.neighbours(rows, shard_rows=shard_rows)).first().recall >= 0.95
    pairs = similar.close_pairs(rows, 0.945, shard_rows=shard_rows)
    assert all(r.recall >= 0.99 for r in similar.pair_recall(rows, pairs, 0.945, every=5).collect())


def test_centroids_in_two_steps_and_blocks():
    rng = np.random.default_rng(8)
    sample = unit(rng, 6000)
    centroids = similar._kmeans(sample, 400)
    assert 380 <= len(centroids) <= 420 and np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4)
    assert (similar._nearest(sample, centroids) == (sample @ centroids.T).argmax(axis=1)).all()
    assert len(similar._kmeans(np.repeat(sample[:3], 50, axis=0), 10)) == 3


def test_blocks_shrink_with_the_shard(monkeypatch):
    from codelode.llm import hnsw

    vectors = unit(np.random.default_rng(9), 600)
    wide = Graph(vectors).search(vectors, 5, 24, np.arange(600))
    monkeypatch.setattr(hnsw, "CELLS", 600 * 7)
    narrow = Graph(vectors).search(vectors, 5, 24, np.arange(600))
    assert (wide[0] == narrow[0]).mean() > 0.999


def test_close_search_in_groups_of_similar_vectors():
    rng = np.random.default_rng(6)
    vectors = np.repeat(unit(rng, 6), [10, 30, 100, 300, 600, 1000], axis=0) + rng.normal(size=(2040, 64)) * 0.025
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    ids, _ = Graph(vectors).search(vectors, 5, similar.BREADTHS[0], np.arange(len(vectors)))
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, truth(vectors, vectors, 5, np.arange(len(vectors))))]) >= 0.99


def test_no_vectors(spark):
    rows = similar.vectors(chunk_frame(spark, [], [("a", None, None)]))
    assert similar.neighbours(rows).count() == similar.close_pairs(rows, 0.9).count() == 0


# ---------------------------------------------------------------- files not written by hand

FILES = [
    ("vendor/a/x.py", None), ("node_modules/b/y.js", None), ("src/third_party_billing/x.py", "def f():\n    return 1"), ("lib/thing-1.2.3/x.ts", None), ("release-3.1.0/src/x.go", "func f() {}"),
    ("src/generated/a/x.ts", None), ("src/generators/x.ts", "function f() {}"), ("x_pb2.py", None), ("generated_ids.py", "def f():\n    return 1"), ("a.min.js", None), ("web/package-lock.json", '{"lockfileVersion": 3}'), ("notes/lock.json", '{"a": 1}'),
    ("a.go", "// Code generated by stubs v1.2.3. DO NOT EDIT.\npackage a"), ("b.py", 'HEADER = "# Code generated by stubs. DO NOT EDIT."\ndef f():\n    return HEADER'), ("c.py", "# Not generated any more. Edit as you like.\nimport x"),
    ("d.js", "/*! thing v1.2.3 | (c) the thing developers | MIT-style licence */\nconst a = 1;"), ("e.js", "// Loosely inspired by thing, but none of its code is used here.\nconst a = 1;"),
    ("f.js", "!function(){" + "a=b?c.d:void 0,".replace(" ", "") * 60 + "}()"), ("g.js", 'const SQL = "select ' + "a.b_c, " * 80 + '";\nfunction f() { return SQL; }'),
    ("h.py", "DATA = [\n" + "    12345, 54321, 11111,\n" * 40 + "]"), ("i.py", "BLOB = \"" + "Ab9//+" * 100 + '"'), ("j.py", "LIMITS = [1, 2, 3]\n\n\ndef f(a):\n    return a\n"), ("k.json", json.dumps({"a": list(range(300))})), ("l.md", "This page is about code generated by tools. Do not edit it."),
]
EXPECTED = {"vendor/a/x.py", "node_modules/b/y.js", "lib/thing-1.2.3/x.ts", "src/generated/a/x.ts", "x_pb2.py", "a.min.js", "web/package-lock.json", "a.go", "d.js", "f.js", "h.py", "i.py"}
LANGUAGE = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "json": "json", "md": "markdown"}


def test_judge(spark, clashing):
    chunk = "chunk_id string, repo_id string, file_path string, raw_content string, language string, chunk_type string, start_line int"
    chunks = [(f"c{i}", "r", p, t, LANGUAGE[p.rpartition(".")[2]], "function" if "def f" in (t or "") or "function f" in (t or "") or "func f" in (t or "") else "doc" if p.endswith(".md") else "block", 1) for i, (p, t) in enumerate(FILES) if t is not None]
    chunks += [chunks[0], ("n1", "r", "j.py", None, None, None, None), (None, None, None, "x", "python", "block", 1)]
    files = [("r", p, len(t) if t else None, 1.0) for p, t in FILES] + [("r", "a.go", None, None), ("r", "a.go", 10, 0.5), (None, "x", 1, 1.0), ("r", None, 1, 1.0)]
    f = clashing(spark.createDataFrame(files, "repo_id string, file_path string, size_bytes long, last_modified double"))
    c = clashing(spark.createDataFrame(chunks, chunk))
    d = spark.createDataFrame([("a", "b")], "repo_id string, depends_on_repo_id string")
    out = handwritten.judge(f, c, d).collect()
    assert {r.file_path for r in out} == EXPECTED and len(out) == len(EXPECTED)
    assert handwritten.judge(f.limit(0), c, d).count() == 0
    assert {r.file_path for r in handwritten.judge(f, c.limit(0), d.limit(0)).collect()} == {"vendor/a/x.py", "node_modules/b/y.js", "lib/thing-1.2.3/x.ts", "src/generated/a/x.ts", "x_pb2.py", "a.min.js", "web/package-lock.json"}


@pytest.mark.parametrize("line, tool, others", [
    ("// AUTO-GENERATED FILE - do not modify by hand", True, False), ('"""AUTO-GENERATED FILE - do not modify by hand"""', True, False), ("# Code generated by stubs v2. Must not be edited by hand.", True, False), ("// Generated by stubs; changes made by hand are lost", True, False),
    ("# Generated by stubs v2, which no longer reads the old schema.", True, False), ("// Not written by hand: generated by stubs. DO NOT EDIT", True, False), ("// Vendored from thing, which is no longer maintained.", False, True), ("// Tests generated by stubs. Do not edit.", True, False),
    ("# No longer generated by stubs.", False, False), ("// This file was generated once, now it is written by hand.", False, False), ("# Not automatically generated any more.", False, False), ("// Removes auto-generated files before the import starts.", False, False), ("/// Auto-generated method stub", False, False),
    ("# This used to be generated by stubs; edit as you like.", False, False), ("// Loosely inspired by thing v1.2, but none of its code is used.", False, False), ("# Not vendored from thing any more.", False, False),
])
def test_only_what_is_negated_is_no_mark(line, tool, others):
    assert handwritten.features(line + "\nx = 1\n", "python", "block", 1)[-6:-4] == (tool, others)


@pytest.mark.parametrize("text, language, kind, line, tool", [
    ("// licence\n" * 30 + "// Code generated by stubs. DO NOT EDIT.\nfunc f() {}", "go", "function", 1, True), ("/*\n" + "  licence\n" * 30 + "  Code generated by stubs.\n*/\nfunc f() {}", "go", "function", 1, True),
    ("/*! Code generated by stubs */" + "a=b;" * 200, "javascript", "block", 1, True), ("// " + "long licence " * 60 + "@generated", "javascript", "block", 1, True), ("#a{b:c}" * 100 + "/* @generated */", "css", "block", 1, False),
    ("/*! thing */" + "a='do not edit';" * 100, "javascript", "block", 1, False), ("func f() {}\n" * 30 + "// @generated\n", "go", "function", 1, False), ("//" + "a" * 200_000, "javascript", "block", 1, False),
])
def test_marks_in_the_whole_leading_comment(text, language, kind, line, tool):
    assert handwritten.features(text, language, kind, line)[-6] == tool


def test_sizes_of_wide_characters(spark):
    texts = {"a.py": 'NAMES = [\n' + '    "日本語の文字列",\n' * 40 + "]\n", "b.py": 'NAMES = [\n' + '    "日本語の文字列",\n' * 10 + "]\n", "c.js": "!function(){" + "a=b?c.d:void 0,".replace(" ", "") * 60 + 'e="' + "строка" * 150 + '"}()'}
    size = {p: len(t.encode()) for p, t in texts.items()} | {"b.py": 5000}  # most chunks of b are missing
    files = spark.createDataFrame([("r", p, n, 1.0) for p, n in size.items()], "repo_id string, file_path string, size_bytes long, last_modified double")
    chunks = spark.createDataFrame([(p, "r", p, t, LANGUAGE[p.rpartition(".")[2]], "block", 1) for p, t in texts.items()], "chunk_id string, repo_id string, file_path string, raw_content string, language string, chunk_type string, start_line int")
    out = handwritten.judge(files, chunks, spark.createDataFrame([], "repo_id string, depends_on_repo_id string")).collect()
    assert {(r.file_path, r.reason) for r in out} == {("a.py", "data"), ("c.js", "minified")}


def source(seed, n=120):
    rng = np.random.default_rng(seed)
    return "\n".join(f"    value_{rng.integers(1e6)} = call_{rng.integers(1e6)}(item_{rng.integers(1e6)}, {rng.integers(100)})" for _ in range(n))


def _copies(spark, rows, needs=(), **options):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(f"{r}{p}", r, p, t, "python") for r, p, t in rows], "chunk_id string, repo_id string, file_path string, raw_content string, language string")
    links = spark.createDataFrame(list(needs), "repo_id string, depends_on_repo_id string")
    found = handwritten.copied_files(frame.unionByName(frame.limit(3)), links, **options)
    named = frame.select("repo_id", "file_path", handwritten.file_key().alias("file")).join(found, "file")
    return {(r.repo_id, r.file_path) for r in named.select("repo_id", "file_path", F.lit(1)).collect()}


@pytest.mark.parametrize("heavy_share", [0.0005, 1.0])
def test_copies_in_unrelated_repositories(spark, heavy_share):
    copy = source(1)
    rows = [(f"r{i}", "lib/helper.py", copy.replace("    ", "  ") + f"\n# local note {i}") for i in range(5)]
    rows += [(f"r{i}", "own.py", source(100 + i)) for i in range(5)] + [("r0", "part.py", copy[: len(copy) // 3] + source(77, 200))]
    rows += [(f"s{i}", "shared.py", source(2)) for i in range(5)]  # from s0, on which all others depend
    rows += [(f"s{i}", "lib/other.py" if i else "vendor/other.py", source(3)) for i in range(5)]  # s0 has it from outside too
    rows += [("r9", "bundle.py", "\n".join(source(i) for i in (1, 200, 201, 202, 203)))]  # holds the copy, but is mostly its own
    rows += [(f"t{i}", "edited.py", source(4, 60) + source(300 + i, 5)) for i in range(3)] + [(f"u{i}", "twice.py", source(5)) for i in range(2)]
    expected = {(f"r{i}", "lib/helper.py") for i in range(5)} | {(f"s{i}", "lib/other.py" if i else "vendor/other.py") for i in range(5)} | {(f"t{i}", "edited.py") for i in range(3)}
    assert _copies(spark, rows, [(f"s{i}", "s0") for i in range(1, 5)], heavy_share=heavy_share) == expected


def test_a_copy_is_found_among_any_number_of_partners(spark):
    """Each twelfth of the copies lies in a bundle of its own too, whose hash is smaller than those of the copies."""
    import hashlib

    hashed = lambda path: sorted((f"r{i}" for i in range(60)), key=lambda r: hashlib.md5(f"{r}\n{path}".encode()).digest())
    copies = hashed("lib/helper.py")[-3:]
    parts = [source(500 + i, 20) for i in range(12)]
    rows = [(r, "lib/helper.py", "\n".join(parts) + f"\nx{i} = {i}\n") for i, r in enumerate(copies)]
    rows += [(r, "bundle.py", part + "\n" + source(600 + i, 200)) for i, (r, part) in enumerate(zip(hashed("bundle.py"), parts))]
    assert _copies(spark, rows) == {(r, "lib/helper.py") for r in copies}


def test_small_copies_are_compared_as_a_whole(spark):
    small = "def f(alpha, beta):\n    assert beta in alpha, alpha\n    gamma = alpha[beta] + 1\n    return [gamma, alpha, beta, f(gamma, 2)]\n"
    rows = [(f"r{i}", "a.py", small.replace("1", str(i))) for i in range(3)] + [("r4", "b.py", small + "x = 1\n")] + [(f"r{i}", "c.py", "x = 1\n") for i in range(9)]
    assert _copies(spark, rows) == {(f"r{i}", "a.py") for i in range(3)}


def test_judge_names_a_copy_without_any_mark(spark):
    paths = [(f"r{i}", f"src/part{i}/tool.py") for i in range(4)]
    files = spark.createDataFrame([(r, p, 100, 1.0) for r, p in [*paths, ("r0", "own.py")]], "repo_id string, file_path string, size_bytes long, last_modified double")
    rows = [(f"c{i}{j}", r, p, source(6)[j * 700 : (j + 1) * 700], "python", "function", 1 + 40 * j) for i, (r, p) in enumerate(paths) for j in range(4)] + [("o", "r0", "own.py", source(7), "python", "function", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, repo_id string, file_path string, raw_content string, language string, chunk_type string, start_line int")
    out = handwritten.judge(files, chunks, spark.createDataFrame([], "repo_id string, depends_on_repo_id string")).collect()
    assert {(r.repo_id, r.file_path) for r in out} == set(paths) and {(r.reason, r.evidence) for r in out} == {("third-party", "fingerprints")}


def test_winnow_matches_brute_force():
    texts = [source(3, 40), "", "a b", source(4, 5), "x = 1  # only a comment\n"]
    which, prints = handwritten.winnow(texts)
    for i, text in enumerate(texts):
        alone = set(handwritten.winnow([text])[1].tolist())
        assert alone == set(prints[which == i].tolist())
    # any run of KGRAM + WINDOW - 1 equal tokens is found in both texts
    common = source(9, 30)
    a, b = (set(handwritten.winnow([source(i, 20) + "\n" + common + "\n" + source(i + 50, 20)])[1].tolist()) for i in (10, 20))
    assert len(a & b) >= 10
    assert not set(handwritten.winnow([source(11)])[1].tolist()) & set(handwritten.winnow([source(12)])[1].tolist())


# ---------------------------------------------------------------- mixtures


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 500, 400).astype(float).tolist()
    p = [0.3] * 400
    left = mixing.flight(p, sizes, rng)
    assert len(left) <= 2 and all(x in (0.0, 1.0) for i, x in enumerate(p) if i not in left)
    assert abs(sum(p) - 120) < 1e-6 and abs(np.dot(p, sizes) - 0.3 * sum(sizes)) < 1e-4


def test_landing_is_the_best_subset():
    rng = np.random.default_rng(1)
    sizes, p = [3.0, 50.0, 7.0, 11.0], [0.5, 0.5, 0.25, 0.75]
    goal = np.dot(p, sizes)
    mixing.landing(p, sizes, [0, 1, 2, 3], rng)
    best = min(abs(sum(s for i, s in enumerate(sizes) if m >> i & 1) - goal) for m in range(16))
    assert abs(np.dot(p, sizes) - goal) <= best + 1e-9


def test_mixture_reaches_targets(spark, clashing):
    rng = np.random.default_rng(2)
    words = [" ".join(["word"] * int(n)) for n in rng.integers(5, 200, 600)]
    rows = [(i, "big" if i % 3 else "small" if i % 2 else "tiny", t) for i, t in enumerate(words)]
    rows += [(1000, "big", None), (1001, "big", ""), (None, "big", "lost"), (1002, None, "no source " * 20), rows[1]]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    goals = [("m", "big", 0.5, 3, 0.5), ("m", "small", 0.3, 2, 0.5), ("m", "tiny", 0.2, 1, 0.5), ("m", "none", 0.1, 2, 0.5), ("n", "tiny", 1.0, 2, 4.0), ("n", None, 1.0, 2, 1.0), ("z", "big", None, None, None)]
    targets = clashing(spark.createDataFrame(goals, "mix_id string, source string, target_share double, max_repeats int, budget_ratio double"))
    sizes = mixing.token_sizes(docs).cache()
    plan = mixing.plans(sizes, targets)
    for block in (mixing.BLOCK, 50):  # one block per source, and several rounds
        chosen = mixing.mix(sizes, plan, block)
        got = {(r.mix_id, r.source): r for r in mixing.report(chosen, plan).collect()}
        for source in ("big", "small"):
            r = got["m", source]
            assert abs(r.actual_tokens - r.target_tokens) <= 5
        lacking = got["n", "tiny"]
        assert lacking.actual_tokens == 2 * lacking.available and lacking.most_repeats == 2 and lacking.lacking_tokens > 0
        assert got["m", "none"].actual_tokens == 0 and got["z", "big"].actual_tokens == 0
        per_doc = chosen.groupBy("mix_id", "doc_id").count().agg({"count": "max"}).first()[0]
        assert per_doc == 1 and chosen.where("doc_id IN (1000, 1001, 1002) OR doc_id IS NULL").count() == 0
    again = mixing.mix(sizes, plan, 50).exceptAll(mixing.mix(sizes, plan, 50)).count()
    assert again == 0
    empty = mixing.token_sizes(docs.limit(0))
    assert mixing.mix(empty, mixing.plans(empty, targets)).count() == 0 and mixing.plans(sizes, targets.limit(0)).count() == 0


def test_small_sources_keep_their_reserve_beside_a_large_one(spark):
    rng = np.random.default_rng(4)
    sizes = [(i, "small", 1500 if i % 20 == 0 else int(n)) for i, n in enumerate(rng.integers(20, 200, 400))]
    sizes += [(1000 + i, "large", 1500 if i % 20 == 0 else int(n)) for i, n in enumerate(rng.integers(20, 200, mixing.BLOCK + 500))]
    sizes = spark.createDataFrame([*sizes, (1, "small", 5), (9000, "few", 100), (9001, "few", 90)], "doc_id long, source string, tokens long").dropDuplicates(["doc_id"]).cache()
    goals = [(f"m{i}", source, share, 1, 0.3) for i in range(8) for source, share in (("small", 0.11), ("large", 0.8), ("few", 0.0001))]
    plan = mixing.plans(sizes, spark.createDataFrame(goals, "mix_id string, source string, target_share double, max_repeats int, budget_ratio double"))
    chosen = mixing.mix(sizes, plan)
    got = [r for r in mixing.report(chosen, plan).collect() if r.source != "few"]
    assert len(got) == 16 and max(abs(r.actual_tokens - r.target_tokens) for r in got) <= 50
    assert chosen.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0
