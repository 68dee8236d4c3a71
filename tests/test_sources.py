"""Scan, chunker, symbol extraction, store, service and streaming, end to end on small trees."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codelode.operators.embedding import FunctionEncoder, SubwordEncoder
from codelode.operators.relations import DependencyCycle, RelationError, UnknownGroup, UnknownRepository
from codelode.service import Engine, StaleVectors
from codelode.sources import blocks, chunker, files, lines
from codelode.sources.python_symbols import parse, python_symbols
from codelode.sources.store import Store, payload
from codelode.streaming import sync

SERVER = '''"""Routes of the shop."""
import flask

app = flask.Flask(__name__)


class Basket:
    """What a customer wants."""

    def add(self, item):
        self.check(item)


@app.post("/api/v2/basket")
def put_basket(body):
    return Basket().add(body)
'''
CLIENT = """import { http } from './http';

export interface Item {
  id: string;
}

export async function sendBasket(item: Item) {
  return http.post("/api/v2/basket?x=1", item);
}
"""


@pytest.fixture
def trees(tmp_path):
    for path, text in {"server/app/routes.py": SERVER, "server/README.md": "# Shop\n\nSells things.\n", "server/.env": "SECRET=1", "server/node_modules/x.js": "x()", "client/src/send.ts": CLIENT, "client/logo.png": "x"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    return tmp_path


def test_scan(spark, trees):
    (trees / "server/bad.py").write_bytes(b"x = 1\r\n# \xff\xfe\r\n")
    (trees / "server/huge.py").write_bytes(b"x" * 1_500_001)
    got = {r.file_path: r for r in files.scan(spark, str(trees / "server"), "shop").collect()}
    assert set(got) == {"app/routes.py", "README.md", "bad.py"}
    assert got["bad.py"].content == "x = 1\n# \n" and got["bad.py"].sha256 == hashlib.sha256(b"x = 1\r\n# \xff\xfe\r\n").hexdigest()


def chunks_of(spark, *rows):
    frame = spark.createDataFrame([("r", p, t) for p, t in rows], "repo_id string, file_path string, content string")
    return chunker.chunk_files(frame).orderBy("file_path", "start_line", "end_line").collect()


def test_chunks(spark):
    got = chunks_of(spark, ("send.ts", CLIENT), ("blank.py", " \n \n"), ("empty.py", ""), ("none.py", None))
    assert [(r.start_line, r.end_line, r.symbol_name, r.chunk_type) for r in got] == [(1, 2, None, "block"), (2, 6, "Item", "interface"), (6, 10, "sendBasket", "function")]
    assert got[1].raw_content == "export interface Item {\n  id: string;\n}" and got[1].chunk_id == hashlib.sha256(b"r:send.ts:2:6").hexdigest()[:16]
    assert got[0].imports_json == "[\"import { http } from './http';\"]"
    assert got[2].enriched_content.startswith("// [Context] Repository: r | File: send.ts | Language: typescript\n// Symbol: sendBasket (function)\n// Top Imports:")


def test_python_methods_and_docs(spark):
    body = "".join(f"    def step_{i}(self):\n        return {i} * {i}\n\n" for i in range(30))
    got = chunks_of(spark, ("a.py", f"import os\n\nclass Runner:\n    '''Runs steps.'''\n{body}\ndef after():\n    pass\n"))
    kinds = {(r.symbol_name, r.chunk_type, r.parent_symbol) for r in got}
    assert ("Runner", "class", None) in kinds and ("after", "method", "Runner") in kinds  # a function after any class counts as its method
    assert any(k == "method" and p == "Runner" and n.startswith("step_") for n, k, p in kinds) and all(len(r.raw_content) <= 800 for r in got)
    assert [r.docstring for r in got if r.symbol_name == "Runner"] == ["Runs steps."]


def test_other_languages(spark):
    got = chunks_of(spark, ("a.go", "package a\n\ntype T struct {\n}\n\nfunc (t *T) Go() {\n}\n"), ("b.rs", "use x;\npub fn go() {\n}\n"), ("c.md", "Intro\n\n## Part two\n\nText\n"), ("d.sql", "-- x\nSELECT 1;\nselect 2;\n"), ("e.txt", "one\n\ntwo\n"))
    by_file = {}
    for r in got:
        by_file.setdefault(r.file_path, []).append((r.symbol_name, r.chunk_type))
    assert by_file == {"a.go": [(None, "block"), ("T", "struct"), ("Go", "function")], "b.rs": [(None, "block"), ("go", "function")], "c.md": [(None, "block"), ("Part two", "doc")], "d.sql": [(None, "block")] * 3, "e.txt": [(None, "block")] * 2}


def test_recursive_spans():
    text = "alpha beta. " * 200
    spans = chunker.recursive_spans(text, ["\n\n", "\n", " ", ""], 100, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert b - a <= 100 and a < c <= b and b - c <= 20
    assert chunker.recursive_spans("short", [" ", ""]) == [(0, 5)]
    assert chunker.recursive_spans("x" * 900, [""], 800, 100) == [(0, 800), (700, 900)]
    assert chunker.recursive_spans("x" * 900, ["\n", " "], 800, 100) == [(0, 900)]


def test_python_tree():
    rows = parse("r", "f.py", SERVER)
    symbols = {r[1]: (r[5], r[6], r[8], r[9]) for r in rows if r[0] == "symbol"}
    assert symbols == {"r:f.py:Basket": ("class", 7, "What a customer wants.", None), "r:f.py:Basket.add": ("method", 10, None, "Basket"), "r:f.py:put_basket": ("function", 15, None, None)}
    assert {(r[7], r[4], r[6]) for r in rows if r[0] == "call"} == {("add", "check", 11), ("put_basket", "Basket", 16), ("put_basket", "add", 16), ("put_basket", "post", 14)}


def test_python_that_cannot_be_parsed(spark):
    frame = spark.createDataFrame([("r", "bad.py", "class Odd\n  x = go(1)\n"), ("r", "ok.py", "def f():\n    g()\n"), ("r", "null.py", "\x00"), ("r", "none.py", None)], "repo_id string, file_path string, content string")
    symbols, calls = python_symbols(frame)
    assert {(r.name, r.kind) for r in symbols.collect()} == {("Odd", "class"), ("f", "function")}
    assert {(r.source_symbol, r.target_symbol) for r in calls.collect()} == {("line_2", "go"), ("f", "g")}


GO = "package auth\n\n// What is kept.\ntype UserAccount struct {\n" + "\ta string\n" * 4 + "}\n\ntype TokenResponse struct {\n" + "\tb string\n" * 4 + "}\n\nfunc ValidateRole(a string) bool {\n\treturn true\n}\n"


def test_chunks_of_go(spark):
    """A file laid out in lines as a known one has the same chunks, with the same ids, as these follow from lines only."""
    text = GO.replace("\n\n// What is kept.\ntype", "\n\n\ntype").replace("\ta string\n" * 4, "\ta string\n" * 4)
    out = chunker.chunk_files(spark.createDataFrame([("shared-schemas", "models.go", text)], "repo_id string, file_path string, content string")).collect()
    found = sorted((r.start_line, r.end_line, r.symbol_name, r.chunk_type) for r in out)
    assert [(n, k) for _, _, n, k in found] == [(None, "block"), ("UserAccount", "struct"), ("TokenResponse", "struct"), ("ValidateRole", "function")]
    assert all(r.chunk_id == hashlib.sha256(f"shared-schemas:models.go:{r.start_line}:{r.end_line}".encode()).hexdigest()[:16] for r in out)
    assert hashlib.sha256(b"shared-schemas:models.go:1:3").hexdigest()[:16] == "1ccf10b96926d178"
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))  # a chunk ends in the line where the next one begins


def blocks_of(spark, *named):
    frame = spark.createDataFrame([("r", p, t) for p, t in named], "repo_id string, file_path string, content string")
    return sorted(blocks.chunk_blocks(frame).collect(), key=lambda r: (r.file_path, r.start_line, r.end_line))


def test_blocks_by_language(spark):
    script = "import { a } from './a';\n\nexport interface Row {\n  id: string;\n}\n\nexport async function load(x) {\n  if (x) {\n    const y = 1;\n  }\n}\nconst last = 1;\n"
    rust = "use x;\n\npub(crate) struct Row {\n    a: u8,\n}\n\nimpl Row {\n    pub fn get(&self) -> u8 {\n        self.a\n    }\n}\n"
    python = 'import os\nfrom a import b, c\n\nclass Box:\n    """Keeps."""\n' + "    x = 1\n" * 12 + '    def put(self):\n        """Puts."""\n        def inner():\n            pass\n\nasync def run():\n    pass\n'
    text = "intro\n\n# One\nbody\n\n#### Four #\nmore\n##### Five\n"
    got = {}
    for r in blocks_of(spark, ("a.ts", script), ("b.rs", rust), ("c.py", python), ("d.md", text), ("e.go", "package p\n\nfunc (s *S) Go() {\n}\n\ntype T interface {\n}\n"), ("f.py", "def broken(:\n"), ("g.json", "{}\n" * 130), ("h.ts", ""), ("i.md", "plain\n"), ("j.ts", "type A = B\n" + "x\n" * 60)):
        got.setdefault(r.file_path, []).append((r.start_line, r.end_line, r.symbol_name, r.chunk_type, r.parent_symbol))
    assert got["a.ts"] == [(3, 5, "Row", "interface", None), (7, 11, "load", "function", None), (12, 12, "last", "function", None)]
    assert got["b.rs"] == [(3, 5, "Row", "struct", None), (7, 11, "Row", "struct", None)]
    assert got["c.py"] == [(4, 14, "Box", "class", None), (18, 21, "put", "method", "Box"), (23, 24, "run", "function", None)]
    assert got["d.md"] == [(3, 5, "One", "doc", None), (6, 8, "Four", "doc", None)]
    assert got["e.go"] == [(3, 4, "Go", "function", "p"), (6, 7, "T", "interface", "p")]
    assert got["f.py"] == [(1, 1, None, "block", None)] and got["g.json"] == [(1, 60, None, "block", None), (41, 100, None, "block", None), (81, 130, None, "block", None)]
    assert "h.ts" not in got and got["i.md"] == [(1, 1, None, "block", None)] and got["j.ts"] == [(1, 40, "A", "struct", None)]


def test_blocks_reach_and_headers(spark):
    long = "func Long() {\n" + "\tx()\n" * 300
    inner = blocks_of(spark, ("a.go", long), ("b.py", 'from a import b\nclass K:\n    def f(self):\n        """Does\n        it."""\n'), ("c.ts", "import x from 'y';\nfunction f() {\n}\n"))
    assert (inner[0].start_line, inner[0].end_line) == (1, 152)
    by = {(r.file_path, r.symbol_name): r for r in inner}
    assert by["b.py", "f"].enriched_content.split("\n")[:4] == ["// [Context] Repository: r | File: b.py | Language: python", "// Scope: K -> f (method)", "// Top Imports: from a import b", "// Doc: Does it."]
    assert by["b.py", "f"].imports_json == '["from a import b"]' and by["c.ts", "f"].imports_json == '["import x from \'y\';"]'
    assert by["c.ts", "f"].chunk_id == hashlib.sha256(b"r:c.ts:2:3").hexdigest()[:16]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    assert store.read("repo_groups").count() == 0
    store.upsert("repo_groups", store.rows("repo_groups", ("a", 1.0), ("b", 1.0)))
    store.upsert("repo_groups", store.rows("repo_groups", ("a", 2.0)))
    store.insert("repo_groups", store.rows("repo_groups", ("b", 9.0), ("c", 3.0)))
    assert {tuple(r) for r in store.read("repo_groups").collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}
    store.remove("repo_groups", store.rows("repo_groups", ("b", None)), ["group_name"])
    assert payload(store.read("repo_groups").orderBy("group_name")) == '[{"group_name": "a", "created_at": 2.0}, {"group_name": "c", "created_at": 3.0}]'
    with pytest.raises(ValueError):
        payload(spark.range(5), 4)


def test_a_broken_write_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "index"))
    row = lambda repo, i: store.rows("file_hashes", (repo, f"f{i}.py", "h", 1.0, i))
    store.upsert("file_hashes", row("a", 1).unionByName(row("b", 2)))
    before = store.parts("file_hashes")
    with monkeypatch.context() as broken:
        broken.setattr(Store, "_switch", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.upsert("file_hashes", row("a", 3))
    assert store.parts("file_hashes") == before and store.read("file_hashes").count() == 2
    (tmp_path / "index/file_hashes/_manifests/.half").write_text("{")  # what a write leaves that ends before its rename
    old = store.read("file_hashes")
    store.upsert("file_hashes", row("a", 3))
    after = store.parts("file_hashes")
    assert after["b"] == before["b"] and after["a"] != before["a"]  # another repository is not written again
    assert old.count() == 2 and store.read("file_hashes").count() == 3  # a reader keeps what it began with
    assert {r.file_path for r in store.read("file_hashes", ["a"]).collect()} == {"f1.py", "f3.py"}
    assert all("__part=" in f for f in store.read("file_hashes", ["a"]).inputFiles()) and not any(after["b"] in f for f in store.read("file_hashes", ["a"]).inputFiles())
    store.drop("file_hashes", "a")
    assert {r.repo_id for r in store.read("file_hashes").collect()} == {"b"}
    with monkeypatch.context() as late:  # another write was faster
        late.setattr(Store, "_numbers", lambda self, name: [1])
        (tmp_path / "index/file_hashes/_manifests/00000002.json").write_text("{}")
        with pytest.raises(RuntimeError):
            store._switch("file_hashes", {})


def test_scan_reads_the_ignore_file_and_opens_no_ignored_folder(spark, tmp_path):
    root = tmp_path / "tree"
    kept = ["src/main.py", "docs/README.md", ".github/skills/a/SKILL.md", ".github/workflows/ci.yml", "x/cmd/batch_1.py", "a b/[c]{d}*.py", "build_notes.md"]
    gone = ["node_modules/deep/x.js", ".github/ISSUE.md", ".github/other/x.md", ".github/skills/.hidden/x.md", ".venv/x.py", "src/.cache/x.py", "cmd/batch_1.py", "out/x.log", "docs/old", "src/gen_a.py", "lib/vendor/x.go"]
    for path in kept + gone:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x = 1\n")
    (root / ".gitignore").write_text("# remarks\n\ncmd/batch_*\n*.log\nold/\ngen_?.py\n/src/main.py\n")
    (root / "node_modules").chmod(0)  # not even listed
    assert {r.file_path for r in files.scan(spark, str(root), "r").collect()} == set(kept)
    (root / "node_modules").chmod(0o755)
    assert "out/x.log" in {r.file_path for r in files.scan(spark, str(root), "r", []).collect()}
    assert files.read_files(spark, str(root), "r", ["a b/[c]{d}*.py"]).count() == 1 and files.read_files(spark, str(root), "r", []).count() == 0


def test_lines_with_tabs(spark):
    text = 'package x\n\nimport (\n\t"fmt"\n\t"os"\n)\n\tfunc Go(a int) error {\n\t\tcall(a)\n}\n\xa0type T struct {\n'
    rows = lines.code_lines(spark.createDataFrame([("r", "a.go", "go", text)], "repo_id string, file_path string, language string, content string"), "content")
    assert {(r.name, r.kind, r.signature) for r in lines.definitions(rows).collect()} == {("Go", "function", "func Go(a int) error {"), ("T", "struct", "type T struct {")}
    assert lines.import_lines(rows).first().imports == ["import (", '"fmt"', '"os"']


def test_encoders_and_reindex(spark, trees, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), clock=lambda: 1.0)
    assert engine.add("shop", str(trees / "server")).status == "ready" and engine.add("web", str(trees / "client"), sync=False).status == "pending"
    engine.sync("web")
    before = {r.chunk_id: r for r in engine.store.read("chunks_v2").collect()}
    assert all(len(r.sig) == len(r.body) == 384 for r in before.values()) and engine.store.read("postings").where("token = 'basket'").count() > 0
    postings = engine.store.parts("postings")

    def sized(texts, field):
        return [[float(len(t)), 1.0 if field == "body" else 2.0] for t in texts]

    other = Engine(spark, str(tmp_path / "index"), clock=lambda: 2.0, encoder=FunctionEncoder("test", "sizes", sized, batch=2))
    assert {r.repo_id for r in other.stale().collect()} == {"shop", "web"}
    with pytest.raises(StaleVectors):
        other.search("basket", reindex=False)
    broken = Engine(spark, str(tmp_path / "index"), encoder=FunctionEncoder("test", "sizes", sized))
    seen = []

    def stop(repo_id, n):
        seen.append((repo_id, n))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        broken.reindex(stop)
    assert seen[0][0] == "shop" and other.reindex() == ["web"] and other.reindex() == []  # goes on with the rest
    after = {r.chunk_id: r for r in other.store.read("chunks_v2").collect()}
    assert after.keys() == before.keys() and all(after[c].raw_content == before[c].raw_content and list(after[c].body) == [float(len(after[c].raw_content)), 1.0] for c in after)
    assert other.store.parts("postings") == postings and {r.dimension for r in other.store.read("provenance").collect()} == {2}
    assert other.search("basket").count() > 0
    assert engine.sync("web") == {"added": 0, "modified": 0, "deleted": 0} and [r.repo_id for r in engine.stale().collect()] == ["shop"]  # a sync brings its repository up to date


def test_changes_errors_and_look_ups(spark, trees, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), clock=lambda: 1.0)
    engine.add("shop", str(trees / "server"))
    row, found = engine.change("SHOP", branch="main", name="The shop")
    assert (row.repo_id, row.branch, row.name) == ("shop", "main", "The shop") and found == {"added": 0, "modified": 0, "deleted": 0}
    assert engine.change("shop", name="Shop", sync=False)[1] is None
    chunk = engine.store.read("chunks_v2").first()
    assert engine.chunk(chunk.chunk_id).raw_content == chunk.raw_content and engine.chunk("none") is None and engine.repository("none") is None
    assert [r.file_path for r in engine.files("shop").collect()] == ["README.md", "app/routes.py"]
    engine.register("gone", str(tmp_path / "nowhere"))
    with pytest.raises(Exception, match="nowhere"):
        engine.sync("gone")
    assert engine.repository("gone").status == "error" and "nowhere" in engine.repository("gone").error_message
    engine.add_dependency("gone", "shop")
    engine.create_group("all", ["shop", "gone"])
    assert engine.dependencies("gone") == ["shop"] and engine.dependents("shop") == ["gone"]
    assert {r.repo_id: (r.groups, r.depends_on, r.needed_by) for r in engine.relations().collect()} == {"shop": (["all"], [], ["gone"]), "gone": (["all"], ["shop"], [])}


def test_engine(spark, trees, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), clock=lambda: 1.0)
    engine.register("shop", str(trees / "server"))
    engine.register("web", str(trees / "client"))
    assert engine.sync("shop") == {"added": 2, "modified": 0, "deleted": 0} and engine.sync("web")["added"] == 1
    assert engine.sync("shop") == {"added": 0, "modified": 0, "deleted": 0}
    rows = {r.repo_id: r for r in engine.repositories().collect()}
    assert rows["shop"].status == "ready" and rows["shop"].total_files == 2 and rows["shop"].total_symbols == 4
    links = engine.cross_repo_links().collect()
    assert [(r.client_repo, r.api_route, r.server_repo, r.server_line) for r in links] == [("web", "/api/v2/basket", "shop", 14)]

    found = engine.search("put_basket", top_k=3).collect()
    # calls count more than ranks: the class is called under its own name and within those of others
    assert [r.symbol_name for r in found[:2]] == ["Basket", "put_basket"] and found[1].related_callees[0].target_symbol in ("Basket", "add", "post")
    assert engine.search("  ", repo_ids=[]).count() == 0
    assert {r.repo_id for r in engine.search("basket", repo_ids=["WEB"]).collect()} == {"web"}
    info = engine.symbol_info("add", "shop")
    assert info["definitions"].count() == 1 and info["callers"].first().source_symbol == "put_basket" and engine.symbol_info("add")["callees"].count() == 0
    assert engine.file_content("web", "src/send.ts") == CLIENT and engine.file_content("web", "../server/.env") is None

    (trees / "server/README.md").unlink()
    (trees / "server/app/routes.py").write_text(SERVER.replace("put_basket", "store_basket"))
    assert engine.sync("shop") == {"added": 0, "modified": 1, "deleted": 1}
    assert engine.symbol_info("put_basket")["definitions"].count() == 0 and engine.symbol_info("store_basket")["definitions"].count() == 1
    assert engine.stale().count() == 0 and engine.stale(SubwordEncoder(64)).count() == 2
    assert engine.delete("web") and not engine.delete("web") and engine.store.read("call_edges").where("source_repo = 'web'").count() == 0


def test_groups_and_dependencies(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), clock=lambda: 1.0)
    for r in ("a", "b", "c"):
        engine.register(r, f"/none/{r}")
    engine.create_group("g", ["b", "a"])
    assert engine.group_members("g") == ["a", "b"] and engine.add_to_group("g", ["a", "c"]) == ["a", "b", "c"]
    assert engine.remove_from_group("g", "c") and not engine.remove_from_group("g", "c")
    for wrong, error in ((lambda: engine.create_group(" "), ValueError), (lambda: engine.create_group("g"), RelationError), (lambda: engine.create_group("h", ["x"]), UnknownRepository), (lambda: engine.add_to_group("x", ["a"]), UnknownGroup)):
        with pytest.raises(error):
            wrong()
    engine.create_group("empty")
    assert [(r.group_name, r.repo_ids) for r in engine.groups().collect()] == [("empty", []), ("g", ["a", "b"])]
    engine.add_dependency("a", "b")
    engine.add_dependency("b", "c")
    engine.add_dependency("a", "b")
    for pair, error in ((("c", "a"), DependencyCycle), (("a", "a"), RelationError), (("a", "x"), UnknownRepository)):
        with pytest.raises(error):
            engine.add_dependency(*pair)
    scope = {(r.repo_id, r.relation, r.hops) for r in engine.scope(["a"], expand="upstream", depth=2).rows.collect()}
    assert scope == {("a", "primary", 0), ("b", "expanded", 1), ("c", "expanded", 2)}
    assert engine.remove_dependency("b", "c") and not engine.remove_dependency("b", "c") and engine.delete_group("g") and not engine.delete_group("g")


def test_streaming(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("e1", "2025-01-01 00:00:10", "a"), ("e1", "2025-01-01 00:00:20", "a"), ("e2", "2025-01-01 00:07:00", "a"), ("e3", "2025-01-01 01:00:00", "b")]
    spark.createDataFrame(rows, "edge_id string, at string, repo string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema

    runs = iter(range(9))

    def run(transform, mode="append"):
        frame = transform(spark.readStream.schema(schema).parquet(source))
        query = frame.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{next(runs)}")).start()
        query.awaitTermination()
        return spark.sql("SELECT * FROM out").collect()

    assert len(run(lambda s: sync.first_rows(s, ["edge_id"], "at", "1 day"))) == 3

    store = Store(spark, str(tmp_path / "index"))
    changed = spark.readStream.schema(schema).parquet(source).select(F.col("repo").alias("group_name"), F.unix_timestamp("at").cast("double").alias("created_at"))
    for _ in range(2):
        sync.keep_in(store, "repo_groups", changed, ["group_name"], ["created_at"], str(tmp_path / "ck")).awaitTermination()
    assert {r.group_name for r in store.read("repo_groups").collect()} == {"a", "b"}
