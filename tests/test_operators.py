"""Ranking, graph, relations, changes and references against results worked out by hand."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from codelode.functions.text import token_count, token_frequency, tokens
from codelode.operators import changes, dense, embedding, fusion, graph, integrity, lexical, relations
from codelode.plans.catalog import QUERIES

CHUNK = "chunk_id string, repo_id string, file_path string, start_line int, raw_content string, symbol_name string, docstring string, sig_embedding_json string, body_embedding_json string"
EDGE = "edge_id string, source_repo string, source_file string, source_symbol string, target_repo string, target_file string, target_symbol string, edge_type string, line_number int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("symbol_match", "a", "x.py", 1, "def billing_engine(): return 1", "billing_engine", None, "[1.0, 0.0]", "[1.0, 0.0]"),
        ("body_match", "b", "y.py", 1, "def other_one(): # billing billing used here now", "other_one", None, "[0.6, 0.8]", "[0.0, 1.0]"),
        ("no_match", "b", "z.py", 1, "def third(): pass", "third", "", "[]", None),
    ]
    return spark.createDataFrame(rows, CHUNK)


def brute_bm25f(docs, asked):
    fields = {"symbol": (4.0, 0.5, 2.0), "signature": (2.5, 0.6, 10.0), "docstring": (2.0, 0.75, 15.0), "body": (1.0, 0.85, 50.0)}
    n = max(1, len(docs))
    avg = {f: max(1.0, sum(len(d[f]) for d in docs.values()) / len(docs) or default) for f, (_, _, default) in fields.items()}
    out = {}
    for t in asked:
        seen = [i for i, d in docs.items() if any(t in d[f] for f in fields)]
        idf = math.log(1 + (n - len(seen) + 0.5) / (len(seen) + 0.5))
        for i in seen:
            tfe = sum(w * docs[i][f].count(t) / (1 - b + b * len(docs[i][f]) / avg[f]) for f, (w, b, _) in fields.items())
            out[i] = out.get(i, 0) + idf * tfe / (1.2 + tfe)
    return out


def test_tokens_are_counted_without_making_them(spark):
    texts = ["", "_", "__", "a", "_a_", "a1", "a1b22_", "get_user2 get USER get", "foo_bar foo _foo_ foo1 1foo xfoo", "12 a12 12b _12_ 012", "a__b a_b", "é_a aé b1é", "x-y.z"]
    wanted = ["a", "foo", "12", "foo_bar", "get", "a1", "_", "b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    out = rows.select("t", tokens(F.col("t")).alias("made"), token_count(low).alias("n"), *[token_frequency(low, w).alias(f"f{i}") for i, w in enumerate(wanted)]).collect()
    for r in out:
        assert r.n == len(r.made) and [r[f"f{i}"] for i in range(len(wanted))] == [r.made.count(w) for w in wanted], r


def test_bm25f_matches_brute_force(chunks):
    fielded = lexical.fields(chunks).select("chunk_id", "repo_id", *[tokens(F.col(f)).alias(f) for f in lexical.FIELDS]).collect()
    docs = {r.chunk_id: {f: getattr(r, f) for f in lexical.FIELDS} for r in fielded}
    for repos, asked in ((None, "billing"), (["b"], "billing engine third"), (None, "Billing_Engine return")):
        own = docs if repos is None else {r.chunk_id: docs[r.chunk_id] for r in fielded if r.repo_id in repos}
        expected = brute_bm25f(own, lexical.query_tokens(asked))
        got = {r.chunk_id: r.score for r in lexical.bm25f(chunks, asked, repos).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
        whole = lexical.fields(lexical.in_scope(chunks, repos))
        stored = {r.chunk_id: r.score for r in lexical.bm25f_stored(lexical.postings(whole), lexical.lengths(whole), asked).collect()}
        twice = {r.chunk_id: r.score for r in lexical.bm25f(chunks.unionByName(chunks), asked, repos).collect()}
        assert stored.keys() == twice.keys() == got.keys() and all(abs(got[k] - stored[k]) < 1e-12 and abs(got[k] - twice[k]) < 1e-12 for k in got)
    assert lexical.bm25f(chunks, "  ").count() == lexical.bm25f(chunks, "billing", []).count() == 0


def test_bm25f_golden(spark):
    """Two chunks with field lengths 3/5/0/5 and 3/11/0/11, worked out by hand."""
    lengths = spark.createDataFrame([("a", "r", 3, 5, 0, 5), ("b", "r", 3, 11, 0, 11)], "chunk_id string, repo_id string, len_symbol int, len_signature int, len_docstring int, len_body int")
    stats = lexical.statistics(lengths).first()
    assert (stats.n_chunks, stats.avg_symbol, stats.avg_signature, stats.avg_docstring, stats.avg_body) == (2, 3.0, 8.0, 15.0, 8.0)
    assert tuple(lexical.statistics(lengths.limit(0)).first()) == (1, 2.0, 10.0, 15.0, 50.0)


def test_dense(chunks):
    query = dense.vectors_of(chunks, "symbol_match")
    got = {r.chunk_id: round(r.similarity, 6) for r in dense.dense(chunks, query).collect()}
    assert got == {"symbol_match": 1.0, "body_match": 0.36}


def test_fusion_scores(spark):
    ranks = spark.createDataFrame([("p", 1), ("e", 2)], "chunk_id string, dense_rank int")
    got = {r.chunk_id: r.score for r in fusion.fuse(ranks, ranks.withColumnRenamed("dense_rank", "sparse_rank").union(spark.createDataFrame([("s", 3)], "c string, d int"))).collect()}
    assert round(got["p"], 6) == 0.030328 and round(got["e"] * 0.85, 6) == 0.025363 and abs(got["s"] - 0.85 / 63) < 1e-12


def test_hybrid(spark, chunks):
    edges = spark.createDataFrame([("e1", "b", "f", "other_one", None, None, "billing_engine", "CALLS", 3), ("e2", "a", "f", "billing_engine", None, None, "helper", "CALLS", 4)], EDGE)
    rows = fusion.hybrid(chunks, edges, "billing", dense.vectors_of(chunks, "symbol_match"), 2)
    got = rows.collect()
    assert [r.chunk_id for r in got] == ["symbol_match", "body_match"] and got[0].dense_rank == got[0].sparse_rank == 1
    assert abs(got[0].score - round(1.85 / 61 + 0.02 + math.log(2) * 0.02 * 1.8, 6)) < 2e-6
    full = {r.chunk_id: r for r in fusion.enrich(rows, edges).collect()}
    assert full["symbol_match"].related_callers[0].source_symbol == "other_one" and full["symbol_match"].related_callees[0].target_symbol == "helper"
    assert full["body_match"].related_callers is None


def test_centrality(spark):
    rows = [("1", "x", "f", "s", None, None, "use_it", "CALLS", 1), ("2", "y", "f", "s", None, None, "x.Use_It.y", "CALLS", 1), ("3", "own", "f", "s", None, None, "once", "CALLS", 1), ("4", "x", "f", "s", None, None, None, "CALLS", 1)]
    owners = spark.createDataFrame([("use_it", "own"), ("once", "own"), ("once", None), ("never", "own"), ("a", "own"), ("", "own"), (None, "own")], "name string, owner string")
    got = {(r.name, r.owner): round(r.centrality, 6) for r in graph.centrality(spark.createDataFrame(rows, EDGE), owners).collect()}
    assert got[("use_it", "own")] == 0.03955 and got[("once", "own")] == got[("once", None)] == 0.013863
    assert got[("never", "own")] == got[("a", "own")] == got[("", "own")] == got[(None, "own")] == 0


@pytest.mark.parametrize("query", ["enriched_callees", "hybrid_enriched", "hybrid_search", "enriched_callers", "hybrid_hop_decay", "symbol_centrality"])
def test_calls_and_grams_are_not_broadcast(spark, monkeypatch, capsys, query):
    """Spark takes them to be as small as the file of edges, and the driver would have to hold them."""
    made = graph.centrality
    plans = []

    def explained(*args):
        found = made(*args)
        found.explain("formatted")
        plans.append(capsys.readouterr().out)
        return found

    monkeypatch.setattr(graph, "centrality", explained)
    monkeypatch.setattr(fusion, "centrality", explained)
    QUERIES[query](spark, "/root/testdata/sf0.001")
    sent = [x for plan in plans for x in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert sent and not any(column in x for x in sent for column in ("target_symbol#", "__low#", "__n#"))


@pytest.mark.parametrize("query", ["hybrid_enriched", "hybrid_search", "enriched_callers", "hybrid_hop_decay"])
def test_hits_and_lengths_are_not_broadcast(spark, monkeypatch, capsys, query):
    """They have a row for each chunk; Spark goes by their compressed size, and the driver would have to hold them."""
    made = lexical.ranked
    plans = []

    def explained(*args):
        found = made(*args)
        found.explain("formatted")
        plans.append(capsys.readouterr().out)
        return found

    monkeypatch.setattr(lexical, "ranked", explained)
    QUERIES[query](spark, "/root/testdata/sf0.001")
    sent = [x for plan in plans for x in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan)]
    assert sent and not any("chunk_id#" in x for x in sent)


def test_containing_matches_brute_force(spark):
    texts = ["save_batch", "saveXbatch", "SAVE_BATCH_now", "a", "b%c", "abc", "x\\y", "longer_name_here"]
    names = ["save_batch", "a", "%", "b%c", "\\", "name", "_", "batch_", "zzz", "er_na"]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in names], "n string")
    got = {(r.t, r.n) for r in graph.containing(t, "t", n, "n").collect()}
    import re

    def like(text, part):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in part.lower())
        return re.search(pattern, text.lower(), re.S)

    assert got == {(a, b) for a in texts for b in names if like(a, b)}


def test_api_links(spark):
    edges = [("e1", "web", "c.ts", "line_16", None, None, "/api/v1/auth/login", "CROSS_REPO_API", 16), ("e2", "auth", "c.ts", "line_1", None, None, "/api/v1/auth/login", "CROSS_REPO_API", 1), ("e3", "web", "c.ts", "line_2", None, None, "login", "CALLS", 2), ("e4", "web", "c.ts", "line_3", None, None, None, "CROSS_REPO_API", 3)]
    symbols = [("auth:endpoint:POST /api/v1/auth/login", "auth", "POST /api/v1/auth/login", "api_endpoint", "routes.py", 11), ("x", "auth", "login", "function", "r.py", 1)]
    got = graph.api_links(spark.createDataFrame(edges, EDGE), spark.createDataFrame(symbols, "symbol_id string, repo_id string, name string, kind string, file_path string, line_number int")).collect()
    assert [(r.client_repo, r.client_line, r.server_repo, r.server_line, r.edge_id) for r in got] == [("web", 16, "auth", 11, "e1")]


def test_first_rows_win_by_time(spark):
    rows = [("s", dt.datetime(2025, 1, 1), "old"), ("s", dt.datetime(2025, 2, 1), "new"), ("s", None, "none"), ("t", None, "only")]
    frame = spark.createDataFrame(rows, "symbol_id string, indexed_at timestamp_ntz, name string")
    assert {(r.symbol_id, r.name) for r in graph.latest_symbols(frame).collect()} == {("s", "new"), ("t", "only")}
    assert graph.latest_symbols(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- relations

REPOS = ["service-a", "service-b", "shared-lib", "core-utils", "isolated"]
NEEDS = [("service-a", "shared-lib"), ("shared-lib", "core-utils"), ("service-b", "shared-lib")]
SCOPES = [
    (dict(groups=["platform"]), {"service-a", "service-b"}, set()),
    (dict(groups=["empty-group"]), set(), set()),
    (dict(repo_ids=["service-a"], expand="upstream", depth=1), {"service-a"}, {("shared-lib", 1)}),
    (dict(repo_ids=["service-a"], expand="upstream", depth=2), {"service-a"}, {("shared-lib", 1), ("core-utils", 2)}),
    (dict(repo_ids=["shared-lib"], expand="downstream", depth=1), {"shared-lib"}, {("service-a", 1), ("service-b", 1)}),
    (dict(repo_ids=["shared-lib"], expand="both", depth=1), {"shared-lib"}, {("core-utils", 1), ("service-a", 1), ("service-b", 1)}),
    (dict(repo_ids=["service-a"], expand="upstream", depth=0), {"service-a"}, set()),
    (dict(repo_ids=["service-a"], expand="sideways", depth=2), {"service-a"}, set()),
    (dict(repo_ids=["shared-lib", "nobody"], groups=["platform"], expand="upstream", depth=2), {"shared-lib", "service-a", "service-b"}, {("core-utils", 1)}),
    (dict(repo_ids=[]), set(), set()),
]


@pytest.fixture(scope="module")
def catalog(spark):
    repos = spark.createDataFrame([(r, r.title(), f"/srv/{r}.git") for r in REPOS], "repo_id string, name string, url_or_path string")
    needs = spark.createDataFrame(NEEDS, "repo_id string, depends_on_repo_id string")
    members = spark.createDataFrame([("platform", "service-a"), ("platform", "service-b"), ("empty-group", None)], "group_name string, repo_id string")
    return repos, needs, members


@pytest.mark.parametrize("asked,primary,expanded", SCOPES)
def test_scopes(catalog, asked, primary, expanded):
    rows = relations.resolve_scope(*catalog, **asked).rows.collect()
    assert {r.repo_id for r in rows if r.relation == "primary"} == primary
    assert {(r.repo_id, r.hops) for r in rows if r.relation == "expanded"} == expanded
    assert all(r.direction == asked["expand"] for r in rows if r.relation == "expanded")


def test_scope_is_resolved_once(catalog, capsys):
    """A search takes it at every step; unresolved, each of them would join, and broadcast from the driver, anew."""
    relations.resolve_scope(*catalog, repo_ids=["service-a"], expand="both").rows.explain()
    plan = capsys.readouterr().out
    assert "Scan" in plan and "Join" not in plan and "Exchange" not in plan


def test_scope_without_limits(catalog):
    assert relations.resolve_scope(*catalog, expand="both").unscoped
    with pytest.raises(relations.UnknownGroup):
        relations.resolve_scope(*catalog, groups=["nobody"])


def test_cycles(spark, catalog):
    tried = [("core-utils", "service-a"), ("core-utils", "shared-lib"), ("isolated", "service-a"), ("isolated", "isolated")]
    got = {(r.repo_id, r.depends_on_repo_id, r.reason) for r in relations.rejected_dependencies(spark.createDataFrame(tried, "repo_id string, depends_on_repo_id string"), catalog[1]).collect()}
    assert got == {("core-utils", "service-a", "cycle"), ("core-utils", "shared-lib", "cycle"), ("isolated", "isolated", "self")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), (None, "a")], "repo_id string, depends_on_repo_id string")
    assert relations.closure(ring).count() == 9


def test_aliases(spark, catalog):
    given = {"service-a": "service-a", "SERVICE-B": "service-b", "/srv/shared-lib.git/": "shared-lib", "core": "core-utils", " isolated ": "isolated", "nobody": "nobody", "https://host/x/service-a": "service-a"}
    got = relations.resolve_aliases(spark.createDataFrame([(x,) for x in given], "input string"), catalog[0]).collect()
    assert {r.input: r.repo_id for r in got} == given


# ---------------------------------------------------------------- changes


def test_changes(spark):
    old = spark.createDataFrame([("r", "a", "1"), ("r", "b", "1"), ("r", "c", None)], "repo_id string, file_path string, sha256 string")
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None), ("r", "d", "1")], old.schema)
    keys = ["repo_id", "file_path"]
    assert {(r.file_path, r.change) for r in changes.classify(old, new, keys, "sha256").collect()} == {("b", "modified"), ("d", "added")}
    assert {r.change for r in changes.classify(old, new.limit(0), keys, "sha256").collect()} == {"deleted"}
    assert {(r.file_path, r.sha256) for r in changes.upsert(old, new.where("file_path IN ('b', 'd')"), keys).collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "1")}
    assert changes.insert_missing(old, new.union(new), keys).count() == 4
    assert {r.file_path for r in changes.remove(old, new.where("file_path = 'b'"), keys).collect()} == {"a", "c"}
    assert [r.sha256 for r in changes.last_wins(new.union(old).where("file_path = 'b'"), keys, ["sha256"]).collect()] == ["2"]


def test_stale(spark):
    seen = spark.createDataFrame([("repo-a",), ("repo-b",), ("repo-c",)], "repo_id string")
    records = spark.createDataFrame([("repo-a", "ollama", "4b", 2560), ("repo-b", "ollama", "0.6b", 1024)], "repo_id string, provider string, model string, dimension int")
    assert {r.repo_id for r in changes.stale(seen, records, "ollama", "0.6b").collect()} == {"repo-a", "repo-c"}
    assert {r.repo_id for r in changes.stale(seen, records, "ollama", "0.6b", 1024).collect()} == {"repo-a"}


# ---------------------------------------------------------------- references

T0, T1, T2 = dt.datetime(2025, 1, 5), dt.datetime(2025, 2, 5), dt.datetime(2025, 3, 5)


def test_orphans(spark, clashing):
    edges = [
        ("ok", "r", "f.py", "here", "CALLS", T1), ("blank", " ", "f.py", "here", "CALLS", T1), ("null", None, "f.py", "here", "CALLS", T1), ("norepo", "nobody", "f.py", "here", "CALLS", T1),
        ("nosym", "r", "f.py", "nowhere", "CALLS", T1), ("nosym", "r", "f.py", "nowhere", "CALLS", T1), ("gone", "r", "f.py", "gone", "CALLS", T2), ("late", "r", "f.py", "late", "CALLS", T0), ("resent", "r", "f.py", "late", "CALLS", T2), ("resent", "r", "f.py", "late", "CALLS", T0),
        ("full", " r", None, " r:f.py:here ", "CALLS", T1), ("api", "r", None, "GET /x", "CROSS_REPO_API", T1), ("nofile", "r", None, "here", "CALLS", T1), ("notime", "r", "f.py", "late", "CALLS", None), ("nosymbol", "r", "f.py", None, "CALLS", T1),
        (None, "r", "f.py", "nowhere", "CALLS", T1), (None, "r", "f.py", "nowhere", "CALLS", T1), (None, "r", "f.py", "elsewhere", "CALLS", T1),
    ]
    symbols = [("r:f.py:here", None, T0), ("r:f.py:here", None, T0), ("r:f.py:gone", None, T0), ("r:f.py:gone", T1, T1), ("r:f.py:late", None, T1), ("r:endpoint:GET /x", T0, T0), ("r:endpoint:GET /x", None, T1), (None, None, T0)]
    e = clashing(spark.createDataFrame(edges, "edge_id string, target_repo string, target_file string, target_symbol string, edge_type string, indexed_at timestamp_ntz"))
    s = clashing(spark.createDataFrame(symbols, "symbol_id string, removed_at timestamp_ntz, indexed_at timestamp_ntz"))
    r = clashing(spark.createDataFrame([("r",), ("r",), (None,)], "repo_id string"))
    expected = {("norepo", "repositories", "missing"), ("nosym", "symbols", "missing"), ("gone", "symbols", "deleted"), ("late", "symbols", "late"), ("resent", "symbols", "late"), ("nofile", "symbols", "missing"), ("nosymbol", "symbols", "missing")}
    for share in (integrity.HEAVY_SHARE, 0.15, 1.0):  # all keys heavy, some, none
        got = integrity.orphans(e, s, r, share).collect()
        assert {(x.edge_id, x.ref_table, x.state) for x in got if x.edge_id} == expected
        assert sum(x.edge_id is None for x in got) == 2 and len(got) == len(expected) + 2
        counts = {(x.ref_table, x.state, x.month): x.orphans for x in integrity.orphan_counts(e, s, r, share).collect()}
        from collections import Counter

        assert counts == Counter((x.ref_table, x.state, x.month) for x in got)
    assert integrity.orphans(e.limit(0), s, r).count() == 0
    assert {x.state for x in integrity.orphans(e, s.limit(0), r).collect()} == {"missing"}
    assert {x.ref_table for x in integrity.orphans(e, s, r.limit(0)).collect()} == {"repositories"}


def test_orphans_of_a_hot_key(spark):
    edges = spark.range(3000).select(F.col("id").cast("string").alias("edge_id"), F.lit("r").alias("target_repo"), F.lit("f").alias("target_file"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), "id")).alias("target_symbol"), F.lit("CALLS").alias("edge_type"), F.lit(T1).cast("timestamp_ntz").alias("indexed_at"))
    symbols = spark.createDataFrame([("r:f:hot", None, T0)], "symbol_id string, removed_at timestamp_ntz, indexed_at timestamp_ntz")
    repos = spark.createDataFrame([("r",)], "repo_id string")
    assert integrity.heavy_keys(integrity.references(edges)).count() == 1
    assert integrity.orphans(edges, symbols, repos).count() == 2000


# ---------------------------------------------------------------- encoder


def brute_encoding(text, field, size=384):
    import hashlib
    import re

    sums = [0.0] * size
    for i, word in enumerate(re.findall(r"[A-Za-z0-9_]+|[^\s\w]", text)):
        low, w = word.lower(), embedding.FIELD_WEIGHTS.get(field, 1.5) * max(0.5, 1 - i / 400)
        w *= 2.2 if low in embedding.KEYWORDS else 2.0 if word.isupper() and len(word) > 1 else 2.5 if any(c.isupper() for c in word[1:]) else 1
        runs = re.findall("[a-z]+|[0-9]+", low)
        parts = [(low, w)] + [(r, 1.3 * w) for r in runs if len(runs) > 1] + [(f"c3_{low[j : j + 3]}", 0.7 * w) for j in range(len(low) - 2)] + [(f"c4_{low[j : j + 4]}", 0.5 * w) for j in range(len(low) - 3)]
        for token, weight in parts:
            for t, share in ((token, 0.75), (f"rot_{token}", 0.25)):
                sums[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size] += weight * share
    logs = [1 + math.log(x) if x > 0 else 0.0 for x in sums]
    norm = math.sqrt(sum(x * x for x in logs)) or 1
    return [x / norm for x in logs]


def test_encoder_matches_brute_force(spark):
    texts = {"a": "def getUser2(HTTP_CODE, x): return x + 1", "b": "né_2 x+ü — y " * 60, "c": "", "d": None, "e": "  \n"}
    frame = spark.createDataFrame(list(texts.items()), "k string, t string")
    for field in ("signature", "other"):
        got = {r.k: r.vector for r in embedding.encode(frame, "k", "t", field).collect()}
        assert got.keys() == {"a", "b"}
        for k in got:
            assert all(abs(x - y) < 1e-9 for x, y in zip(got[k], brute_encoding(texts[k], field)))
