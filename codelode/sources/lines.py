"""Symbols, calls, endpoints and imports, read from lines of code by Spark's own regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import strip

#: The definitions that a line can hold, by language of origin; the first that fits decides.
DEFINITIONS = [
    (r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z0-9_$]+)\s*\(([^)]*)\)", "function"),
    (r"^(?:export\s+)?class\s+([A-Za-z0-9_$]+)", "class"),
    (r"^(?:export\s+)?interface\s+([A-Za-z0-9_$]+)", "interface"),
    (r"^(?:export\s+)?type\s+([A-Za-z0-9_$]+)\s*=", "type"),
    (r"^(?:pub\s+)?fn\s+([A-Za-z0-9_]+)\s*\(([^)]*)\)", "function"),
    (r"^func\s+(?:\((?:[^)]+)\)\s+)?([A-Za-z0-9_]+)\s*\(([^)]*)\)", "function"),
    (r"^type\s+([A-Za-z0-9_]+)\s+struct", "struct"),
    (r"^(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "function"),
]
#: Words before a bracket that call nothing, and the forms of endpoints and client calls.
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "sizeof")
CALL = r"([A-Za-z0-9_$]+)\s*\("
PY_ENDPOINT = r"""@(?:app|router|api)\.(get|post|put|delete|patch)\(\s*["']([^"']+)["']"""
JS_ENDPOINT = r"""(?:app|router)\.(get|post|put|delete|patch)\(\s*["']([^"']+)["']"""
SCRIPT_IMPORT = r"""import\s+(?:(?:\{[^}]+\})|(?:[\w\s,*]+))\s+from\s+['"]([^'"]+)['"]"""
CLIENT_CALL = r"""(?:axios|fetch|apiClient|http|client)\.(?:get|post|put|delete|patch|\b)\s*\(\s*["']([^"']+)["']"""


def code_lines(files: DataFrame, content: str = "raw_content", first: Column | None = None) -> DataFrame:
    """(repo_id, file_path, language, line_number, line): the lines of each file or chunk, numbered from first."""
    start = F.lit(1) if first is None else first
    text = F.regexp_replace(F.col(content), "\r\n?", "\n")
    split = files.where(F.col(content).isNotNull()).select("repo_id", "file_path", "language", start.alias("__first"), F.posexplode(F.split(text, "\n", -1)).alias("__at", "line"))
    return split.select("repo_id", "file_path", "language", (F.col("__first") + F.col("__at")).alias("line_number"), "line")


def definitions(lines: DataFrame) -> DataFrame:
    """(symbol_id, repo_id, file_path, name, kind, line_number, signature) of each line that defines something."""
    text = strip(F.col("line"))
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, what in reversed(DEFINITIONS):
        hit = text.rlike(pattern)
        name, kind = F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(name), F.when(hit, F.lit(what)).otherwise(kind)
    found = lines.select("repo_id", "file_path", name.alias("name"), kind.alias("kind"), "line_number", F.substring(text, 1, 100).alias("signature")).where("name IS NOT NULL")
    return found.select(F.concat_ws(":", "repo_id", "file_path", "name").alias("symbol_id"), "*")


def calls(lines: DataFrame) -> DataFrame:
    """(edge_id, source_repo, source_file, source_symbol, target_symbol, edge_type, line_number) of each name before a bracket."""
    each = lines.select("repo_id", "file_path", "line_number", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(CALL), F.lit(1)))).alias("target_symbol"))
    return each.where(~F.col("target_symbol").isin(*NO_CALLS)).select(
        F.concat_ws(":", "repo_id", "file_path", "line_number", "target_symbol").alias("edge_id"), F.col("repo_id").alias("source_repo"), F.col("file_path").alias("source_file"),
        F.concat(F.lit("line_"), F.col("line_number")).alias("source_symbol"), "target_symbol", F.lit("CALLS").alias("edge_type"), "line_number",
    )


def endpoints(lines: DataFrame) -> DataFrame:
    """(symbol_id, repo_id, file_path, name, kind, line_number, signature) of the endpoints that lines declare."""

    def found(pattern: str, form: str) -> DataFrame:
        methods, paths = (F.regexp_extract_all("line", F.lit(pattern), F.lit(i)) for i in (1, 2))
        each = lines.where(F.col("line").rlike(pattern)).select("repo_id", "file_path", "line_number", F.explode(F.arrays_zip(methods.alias("method"), paths.alias("path"))).alias("x"))
        name = F.concat(F.upper("x.method"), F.lit(" "), F.col("x.path"))
        return each.select(F.concat_ws(":endpoint:", "repo_id", name).alias("symbol_id"), "repo_id", "file_path", name.alias("name"), F.lit("api_endpoint").alias("kind"), "line_number", F.format_string(form, "x.method", "x.path").alias("signature"))

    return found(PY_ENDPOINT, "@%s('%s')").unionByName(found(JS_ENDPOINT, "app.%s('%s')"))


def client_calls(lines: DataFrame) -> DataFrame:
    """(edge_id, source_repo, source_file, source_symbol, target_symbol, edge_type, line_number) of calls of a path."""
    each = lines.where(F.col("line").rlike(CLIENT_CALL)).select("repo_id", "file_path", "line_number", F.explode(F.regexp_extract_all("line", F.lit(CLIENT_CALL), F.lit(1))).alias("raw"))
    path = F.split_part("raw", F.lit("?"), F.lit(1))
    return each.withColumn("target_symbol", path).where(F.contains("target_symbol", F.lit("/"))).select(
        F.concat_ws(":", "repo_id", "file_path", "line_number", F.lit("API_CALL"), "target_symbol").alias("edge_id"), F.col("repo_id").alias("source_repo"), F.col("file_path").alias("source_file"),
        F.concat(F.lit("line_"), F.col("line_number")).alias("source_symbol"), "target_symbol", F.lit("CROSS_REPO_API").alias("edge_type"), "line_number",
    )


def import_lines(lines: DataFrame) -> DataFrame:
    """(repo_id, file_path, imports): the first six import lines of each file, by the rules of its language."""
    text = strip(F.col("line"))
    language, number = F.col("language"), F.col("line_number")
    fits = (
        ((language == "python") & (number <= 60) & (text.startswith("import ") | text.startswith("from ")))
        | (language.isin("typescript", "javascript") & (number <= 60) & (text.startswith("import ") | text.rlike(SCRIPT_IMPORT)))
        | ((language == "go") & (number <= 40) & (text.startswith("import ") | text.startswith('"')))
        | (language.isin("rust", "c", "cpp") & (number <= 40) & (text.startswith("use ") | text.startswith("#include")))
    )
    # at most sixty lines of a file fit
    own = lines.where(fits).groupBy("repo_id", "file_path").agg(F.array_sort(F.collect_list(F.struct("line_number", text.alias("text")))).alias("all"))
    return own.select("repo_id", "file_path", F.slice(F.col("all.text"), 1, 6).alias("imports"))
