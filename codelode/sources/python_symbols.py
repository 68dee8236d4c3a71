"""Symbols and calls of Python files by the syntax tree; files that cannot be parsed are read by lines instead."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import cut, spread
from codelode.sources.lines import calls, code_lines, definitions

_ROWS = "what string, id string, repo_id string, file_path string, name string, kind string, line_number int, signature string, docstring string, parent_symbol string"


def parse(repo_id: str, file_path: str, text: str) -> list[tuple]:
    """Rows of what stands in a file: ``symbol`` for each class and function, ``call`` for each call in a function."""
    rows: list[tuple] = []
    open_nodes: list[tuple[ast.AST, str | None, str | None]] = [(ast.parse(text), None, None)]
    while open_nodes:
        node, in_class, in_function = open_nodes.pop()
        inner = in_class, in_function
        if isinstance(node, ast.ClassDef):
            rows.append(("symbol", f"{repo_id}:{file_path}:{node.name}", repo_id, file_path, node.name, "class", node.lineno, f"class {node.name}", ast.get_docstring(node), None))
            inner = node.name, in_function
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            spelt = f"{in_class}.{node.name}" if in_class else node.name
            sign = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}(...)"
            rows.append(("symbol", f"{repo_id}:{file_path}:{spelt}", repo_id, file_path, node.name, "method" if in_class else "function", node.lineno, sign, ast.get_docstring(node), in_class))
            inner = in_class, node.name
        elif isinstance(node, ast.Call) and in_function:
            target = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
            if target:
                rows.append(("call", f"{repo_id}:{file_path}:{in_function}->{target}:{node.lineno}", repo_id, file_path, target, "CALLS", node.lineno, in_function, None, None))
        open_nodes.extend((child, *inner) for child in ast.iter_child_nodes(node))
    return rows


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _ROWS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for repo, path, text in zip(batch.repo_id, batch.file_path, batch.content):
            try:
                rows.extend(parse(repo, path, text))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                rows.append(("broken", None, repo, path, *[None] * 6))
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"line_number": "Int32"})


def python_symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, calls) of Python files (repo_id, file_path, content)."""
    # symbols, calls and broken files are taken from it; parsing three times would cost more than writing the rows
    rows = cut(spread(files.where("content IS NOT NULL").select("repo_id", "file_path", "content")).mapInPandas(_parse, _ROWS))
    broken = files.join(rows.where("what = 'broken'").select("repo_id", "file_path"), ["repo_id", "file_path"], "left_semi").withColumn("language", F.lit("python"))
    lines = code_lines(broken, "content")
    shape = [F.col("name"), "kind", "line_number", "signature", "docstring", "parent_symbol"]
    own = rows.where("what = 'symbol'").select(F.col("id").alias("symbol_id"), "repo_id", "file_path", *shape)
    other = definitions(lines).select("symbol_id", "repo_id", "file_path", "name", "kind", "line_number", "signature", F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("parent_symbol"))
    called = rows.where("what = 'call'").select(F.col("id").alias("edge_id"), F.col("repo_id").alias("source_repo"), F.col("file_path").alias("source_file"), F.col("signature").alias("source_symbol"), F.col("name").alias("target_symbol"), F.col("kind").alias("edge_type"), "line_number")
    return own.unionByName(other), called.unionByName(calls(lines)).dropDuplicates(["edge_id"])
