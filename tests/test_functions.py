"""Tokens, texts, vectors, paths and lines against hand-made results."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import text, vectors
from codelode.operators import lexical
from codelode.sources import lines, paths


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def test_tokens(spark):
    given = {"get_user2": ["get_user2", "get", "user", "2"], "getUser": ["getuser"], "": [], None: [], "a-b C_d": ["a", "b", "c_d", "c", "d"], "é1": ["1"]}
    out = column(spark, list(given)).select("x", text.tokens(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in out} == given
    assert lexical.query_tokens("get_user2 get USER") == ["get_user2", "get", "user", "2"]


def test_signature_and_header(spark):
    schema = "repo_id string, file_path string, language string, raw_content string, symbol_name string, chunk_type string, parent_symbol string, imports_json string, docstring string"
    rows = [("r", "f.py", "python", "a\nb\nc\nd", "go", "method", "Cls", '["x", "y", "z", "w", "v"]', "one\ntwo"), ("r", "f.py", "python", "a", None, "block", None, None, None), ("r", "f.py", "python", "a", "", "class", "", "no json", "")]
    out = spark.createDataFrame(rows, schema).select(text.signature_text().alias("s"), text.context_header().alias("h")).collect()
    assert out[0].s == "symbol: go\nscope: Cls\nkind: method\ndoc: one\ntwo\nimports: x, y, z\na\nb\nc"
    assert out[0].h == "// [Context] Repository: r | File: f.py | Language: python\n// Scope: Cls -> go (method)\n// Top Imports: x, y, z, w\n// Doc: one two"
    assert out[1].s == "kind: block\na" and out[1].h.count("\n") == 0
    assert out[2].h.endswith("// Type: class")


def test_chunk_id_and_language(spark):
    row = spark.createDataFrame([("shared-schemas", "models.go", 1, 3)], "repo_id string, file_path string, start_line int, end_line int")
    assert row.select(text.chunk_id().alias("c")).first().c == "1ccf10b96926d178"
    given = {"a/b.PY": "python", "x.tsx": "typescript", "Makefile": "text", ".bashrc": "text", "a.b/c": "text", "d.unknown": "text"}
    out = column(spark, list(given)).select("x", text.language(F.col("x")).alias("l")).collect()
    assert {r.x: r.l for r in out} == given


@pytest.mark.parametrize("whole,part,fits", [("GetXUser", "get_user", True), ("get", "GET", True), ("É", "é", False), ("a\\b", "\\", True), ("ab", "a%b", True), ("abc", "b\\", False), ("x", "", True)])
def test_contains_like(spark, whole, part, fits):
    row = spark.createDataFrame([(whole, part)], "a string, b string")
    assert row.select(text.contains_like(F.col("a"), F.col("b")).alias("c")).first().c is fits


def test_similarity(spark):
    rows = [("[1,0]", "[0.5, 2]", 0.5), ("[2]", "[3]", 1.0), ("[-1]", "[1]", 0.0), ("[1]", "[1,2]", 0.0), ("[]", "[]", 0.0), (None, "[1]", 0.0), ('["1"]', "[1]", 0.0), ("[1e0]", "[ 1 ]", 1.0), ("[1", "[1]", 0.0)]
    frame = spark.createDataFrame(rows, "a string, b string, s double")
    out = frame.select("s", vectors.similarity(vectors.vector(F.col("a")), vectors.vector(F.col("b"))).alias("t")).collect()
    assert all(r.s == r.t for r in out)


KEPT = [".github/skills/a.md", ".github/workflows/x.yml", "src/main.py", "docs/README.md", "a/b.min.js"]
LEFT_OUT = [".github/agents/x.md", ".github/dependabot.yml", ".env", "a/.hidden/b", ".git/config", ".vscode/s.json", "x/node_modules/y.js", "a.png", "b.lock", "vendor/x.py", "a/.github/workflows/x.yml", ".github/workflows/.x", None]


def test_ignored(spark):
    out = column(spark, [*KEPT, *LEFT_OUT]).select("x", paths.ignored(F.col("x")).alias("i")).collect()
    assert [r.x for r in out if not r.i] == KEPT


def test_ignore_patterns(spark):
    globs = ["*.log", "/top", "docs/", "src/*.py", "# no", "!keep.log", ""]
    given = {"a.log": True, "x/y.log": True, "docs": True, "docs/a.md": False, "src/a.py": True, "src/b/a.py": True, "lib/src/a.py": False, "a.py": False, "keep.log": True}
    out = column(spark, list(given)).select("x", paths.ignored(F.col("x"), globs).alias("i")).collect()
    assert {r.x: r.i for r in out} == given


CODE = """import { a } from './a';
export async function load(x: string) {
  const r = await client.get("/api/v1/users?id=1");
  if (r) { return save(r); }
}
class Box {}
func (s *Store) Put(a int) error {
pub fn take(x: u8) {
const go = async (x) => {
type T struct {
@app.post("/api/v1/login")
"""


def test_lines(spark):
    frame = spark.createDataFrame([("r", "f.ts", "typescript", CODE)], "repo_id string, file_path string, language string, content string")
    every = lines.code_lines(frame, "content")
    assert {(r.name, r.kind, r.line_number) for r in lines.definitions(every).collect()} == {("load", "function", 2), ("Box", "class", 6), ("Put", "function", 7), ("take", "function", 8), ("go", "function", 9), ("T", "struct", 10)}
    calls = {(r.target_symbol, r.line_number, r.source_symbol) for r in lines.calls(every).collect()}
    assert {("load", 2, "line_2"), ("get", 3, "line_3"), ("save", 4, "line_4"), ("Put", 7, "line_7")} <= calls and not any(t == "if" for t, _, _ in calls)
    ends = {(r.symbol_id, r.signature) for r in lines.endpoints(every).collect()}
    assert ends == {("r:endpoint:POST /api/v1/login", "@post('/api/v1/login')"), ("r:endpoint:POST /api/v1/login", "app.post('/api/v1/login')")}
    api = lines.client_calls(every).collect()
    assert [(r.edge_id, r.target_symbol) for r in api] == [("r:f.ts:3:API_CALL:/api/v1/users", "/api/v1/users")]
    assert lines.import_lines(every).first().imports == ["import { a } from './a';"]
