"""The older way of cutting files: by syntax tree, by braces, by headings, and else by windows of lines.

Lines are rows, braces are added up by windows over them, and a block is looked for in the lines that it can
reach; only Python files are parsed in a small helper. Files are independent of each other.

Defined results: files without a line have no chunks. A file in which nothing is found, and Python that cannot be
parsed, is cut into windows. A block that never closes ends after ``REACH`` lines, and one without any brace after
``DEFAULT``. Columns other than repo_id, file_path and content are ignored.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import chunk_id, strip
from codelode.session import spread
from codelode.sources.lines import SCRIPT_IMPORT

WINDOW, STEP = 60, 40
REACH, DEFAULT, OVERVIEW = 150, 40, 10
#: Languages by suffix, and the lines (without white space at their ends) at which a block begins.
SUFFIXES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
}
SCRIPT = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z0-9_$]+)"
GO = r"^func\s+(?:\((?:[^)]+)\)\s+)?([A-Za-z0-9_]+)|^type\s+([A-Za-z0-9_]+)\s+(struct|interface)"
RUST = r"^(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+([A-Za-z0-9_]+)"
HEADING = r"^#{1,4}\s+(.+)$"
PACKAGE = r"(?m)^package\s+([A-Za-z0-9_]+)"
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

_FILE = ["repo_id", "file_path"]
_COLUMNS = ["repo_id", "file_path", "language", "start_line", "end_line", "raw_content", "symbol_name", "chunk_type", "parent_symbol", "imports", "docstring", "header"]


def _read(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, content, language, lines, total)"""
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    named = F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))), F.lit("text"))
    text = F.regexp_replace("content", f"(?:{_LINE_END})\\z", "")  # what ends the last line begins no other
    lines = F.split(text, _LINE_END, -1)
    return files.where("content <> ''").select(*_FILE, "content", named.alias("language"), lines.alias("lines")).withColumn("total", F.size("lines"))


def _header(symbol: Column, parent: Column, imports: Column) -> Column:
    first = F.concat(F.lit("// [Context] Repository: "), F.col("repo_id"), F.lit(" | File: "), F.col("file_path"), F.lit(" | Language: "), F.col("language"))
    kind = F.concat(F.lit(" ("), F.col("chunk_type"), F.lit(")"))
    what = F.when(parent != "", F.concat(F.lit("// Scope: "), parent, F.lit(" -> "), F.coalesce(symbol, F.lit("block")), kind)).when(symbol.isNotNull(), F.concat(F.lit("// Symbol: "), symbol, kind))
    some = F.filter(F.transform(F.slice(imports, 1, 4), strip), lambda x: x != "")
    doc = F.when(F.col("docstring") != "", F.concat(F.lit("// Doc: "), F.substring(F.replace(strip(F.col("docstring")), F.lit("\n"), F.lit(" ")), 1, 150)))
    return F.concat_ws("\n", first, what, F.when(F.size(some) > 0, F.concat(F.lit("// Top Imports: "), F.array_join(some, ", "))), doc)


def _text(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("lines", first, last - first + 1), "\n")


def windows(read: DataFrame, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """Windows of so many lines, one every step lines, until one reaches the end."""
    starts = read.select(*_FILE, "language", "lines", "total", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(step))).alias("s")).where((F.col("s") == 0) | (F.col("s") < F.col("total") - (size - step)))
    placed = starts.withColumns({"start_line": F.col("s") + 1, "end_line": F.least(F.col("s") + size, F.col("total"))})
    none = F.lit(None).cast("string")
    header = F.concat(F.lit("// [Context] Repository: "), F.col("repo_id"), F.lit(" | File: "), F.col("file_path"), F.lit(" | Lines: "), F.col("start_line"), F.lit("-"), F.col("end_line"))
    return placed.select(*_FILE, "language", "start_line", "end_line", _text(F.col("start_line"), F.col("end_line")).alias("raw_content"), none.alias("symbol_name"), F.lit("block").alias("chunk_type"), none.alias("parent_symbol"), F.array().cast("array<string>").alias("imports"), none.alias("docstring"), header.alias("header"))


def block_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo_id, file_path, start_line, end_line) of the block of each start, by the braces of the lines that follow.

    lines: (repo_id, file_path, n, line, total); starts: (repo_id, file_path, n). A start looks at so many lines only.
    """
    opened = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit("")))
    closed = F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit("")))
    upto = Window.partitionBy(*_FILE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.select(*_FILE, "n", "total", (opened > 0).alias("opens"), (opened - closed).alias("delta")).withColumn("depth", F.sum("delta").over(upto))
    before = starts.select(*_FILE, "n").join(counted, [*_FILE, "n"]).select(*_FILE, F.col("n").alias("start_line"), "total", (F.col("depth") - F.col("delta")).alias("outside"))
    reached = before.withColumn("n", F.explode(F.sequence(F.col("start_line"), F.least(F.col("start_line") + REACH + 1, F.col("total")))))
    seen = reached.join(counted.select(*_FILE, "n", "opens", "depth"), [*_FILE, "n"])
    from_start = Window.partitionBy(*_FILE, "start_line").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.max("opens").over(from_start) & (F.col("depth") <= F.col("outside")) | (F.col("n") - F.col("start_line") > REACH)
    found = seen.withColumn("ends", ends).groupBy(*_FILE, "start_line", "total").agg(F.min(F.when(F.col("ends"), F.col("n"))).alias("end_line"))
    return found.select(*_FILE, "start_line", F.coalesce("end_line", F.least(F.col("start_line") - 1 + DEFAULT, F.col("total"))).alias("end_line"))


def _outermost(blocks: DataFrame) -> DataFrame:
    """Of blocks in order those that begin after the end of the last one kept."""
    listed = F.array_sort(F.collect_list(F.struct("start_line", "end_line")))  # the starts of one file
    kept = F.aggregate(
        listed, F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<start_line:int,end_line:int>>").alias("kept")),
        lambda acc, x: F.when(x["start_line"] > acc["last"], F.struct(x["end_line"].alias("last"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc), lambda acc: acc["kept"],
    )
    return blocks.select(*_FILE, F.col("start_line").cast("int"), F.col("end_line").cast("int")).groupBy(*_FILE).agg(kept.alias("kept")).select(*_FILE, F.explode("kept").alias("x")).select(*_FILE, "x.*")


def braces(read: DataFrame) -> DataFrame:
    """Blocks of TypeScript, JavaScript, Go and Rust."""
    own = read.where(F.col("language").isin("typescript", "javascript", "go", "rust"))
    lines = own.select(*_FILE, "language", "total", F.posexplode("lines").alias("at", "line")).withColumn("n", F.col("at") + 1)
    line, language = F.col("line"), F.col("language")
    bare = strip(line)
    script, go = language.isin("typescript", "javascript"), language == "go"
    starts = lines.where(F.when(script, bare.rlike(SCRIPT)).when(go, bare.rlike(GO)).otherwise(bare.rlike(RUST)))
    blocks = _outermost(block_ends(lines, starts))
    first = F.element_at("lines", F.col("start_line"))
    head = strip(first)
    go_name, go_type = F.regexp_extract(head, GO, 1), F.regexp_extract(head, GO, 3)
    symbol = F.when(script, F.regexp_extract(head, SCRIPT, 1)).when(go, F.when(go_name != "", go_name).otherwise(F.regexp_extract(head, GO, 2))).otherwise(F.regexp_extract(head, RUST, 1))
    scripted = F.when(F.contains(first, F.lit("class ")), "class").when(F.contains(first, F.lit("interface ")), "interface").when(F.contains(first, F.lit("type ")) | F.contains(first, F.lit("enum ")), "struct").otherwise("function")
    kind = F.when(script, scripted).when(go, F.when(go_name != "", "function").otherwise(go_type)).otherwise(F.when(F.contains(head, F.lit("fn ")), "function").otherwise("struct"))
    package = F.regexp_extract("content", PACKAGE, 1)
    imports = F.when(script, F.transform(F.filter("lines", lambda x: x.rlike(SCRIPT_IMPORT)), strip)).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    rows = own.join(blocks, _FILE).select(
        *_FILE, "language", "start_line", "end_line", _text(F.col("start_line"), F.col("end_line")).alias("raw_content"), symbol.alias("symbol_name"), kind.alias("chunk_type"),
        F.when(go, package).alias("parent_symbol"), imports.alias("imports"), none.alias("docstring"),
    )
    scope = F.when((F.col("language") == "go") & (F.col("parent_symbol") != ""), F.concat(F.lit("package "), "parent_symbol"))
    return rows.withColumn("header", _header(F.col("symbol_name"), scope, F.col("imports")))


def headings(read: DataFrame) -> DataFrame:
    """Sections of Markdown, from each heading of the first four levels to the next one."""
    lines = read.where("language = 'markdown'").select(*_FILE, "language", "lines", "total", F.posexplode("lines").alias("at", "line"))
    heads = lines.where(strip(F.col("line")).rlike(HEADING)).withColumn("start_line", F.col("at") + 1)
    end = F.coalesce(F.lead("start_line").over(Window.partitionBy(*_FILE).orderBy("start_line")) - 1, F.col("total"))
    title = strip(F.regexp_replace("line", "^[# ]+|[# ]+$", ""))
    none = F.lit(None).cast("string")
    header = F.concat(F.lit("// [Doc Context] Repository: "), F.col("repo_id"), F.lit(" | Document: "), F.col("file_path"), F.lit(" | Section: "), title)
    return heads.withColumn("end_line", end).select(
        *_FILE, "language", "start_line", "end_line", strip(_text(F.col("start_line"), F.col("end_line"))).alias("raw_content"), title.alias("symbol_name"), F.lit("doc").alias("chunk_type"), none.alias("parent_symbol"),
        F.array().cast("array<string>").alias("imports"), none.alias("docstring"), header.alias("header"),
    )


def _definitions(content: str) -> list[tuple]:
    """(first line, last line, name, type, parent, imports, docstring) of functions, methods and classes, in order."""
    tree, found, imports = ast.parse(content), [], []
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports.extend(alias.name for alias in node.names)
        elif isinstance(node, ast.ImportFrom):
            imports.append(f"from {node.module or ''} import {', '.join(n.name for n in node.names)}")
    waiting = [(node, None) for node in reversed(tree.body)]
    while waiting:
        node, parent = waiting.pop()
        if isinstance(node, ast.ClassDef):
            found.append((node.lineno, min(node.lineno + OVERVIEW, node.end_lineno), node.name, "class", parent, imports, ast.get_docstring(node)))
            waiting.extend((child, node.name) for child in reversed(node.body))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.append((node.lineno, node.end_lineno, node.name, "method" if parent else "function", parent, imports, ast.get_docstring(node)))
    return found


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, text in zip(batch.repo_id, batch.file_path, batch.content):
            try:
                rows.extend((repo, path, *x) for x in _definitions(text))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue  # cut into windows
        if rows:
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "start_line", "end_line", "symbol_name", "chunk_type", "parent_symbol", "imports", "docstring"])


def definitions(read: DataFrame) -> DataFrame:
    """Functions, methods and overviews of classes of Python."""
    own = read.where("language = 'python'")
    found = spread(own.select(*_FILE, "content")).mapInPandas(_parse, "repo_id string, file_path string, start_line int, end_line int, symbol_name string, chunk_type string, parent_symbol string, imports array<string>, docstring string")
    rows = own.select(*_FILE, "language", "lines").join(found, _FILE).withColumn("raw_content", _text(F.col("start_line"), F.col("end_line")))
    return rows.withColumn("header", _header(F.col("symbol_name"), F.col("parent_symbol"), F.col("imports"))).select(*_COLUMNS)


def chunk_blocks(files: DataFrame) -> DataFrame:
    """The chunks of files (repo_id, file_path, content), with headers and ids."""
    read = _read(files)
    found = braces(read).select(*_COLUMNS).unionByName(headings(read)).unionByName(definitions(read))
    rest = windows(read.join(found.select(*_FILE).distinct(), _FILE, "left_anti"))
    rows = found.unionByName(rest).withColumns({"enriched_content": F.concat("header", F.lit("\n"), "raw_content"), "chunk_id": chunk_id(), "imports": F.slice("imports", 1, 5)})
    imports = F.when(F.col("language") == "go", F.array().cast("array<string>")).otherwise(F.col("imports"))
    return rows.select("chunk_id", *_FILE, "language", "start_line", "end_line", "raw_content", "enriched_content", "symbol_name", "chunk_type", "parent_symbol", F.to_json(imports).alias("imports_json"), "docstring")
