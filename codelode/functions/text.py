"""Column expressions over code and its names; all of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file suffix; any other file is text.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".rs": "rust", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".c": "c", ".h": "c", ".cs": "csharp",
    ".rb": "ruby", ".php": "php", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".sql": "sql", ".sol": "solidity",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
}
#: White space of any kind, as a class of a regular expression.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """The text without white space at its ends, tabs and line feeds included."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def tokens(text: Column) -> Column:
    """The tokens of code: each word of [a-z0-9_] in lower case, and its runs of letters or digits if there are several."""

    def parts(word: Column) -> Column:
        runs = F.regexp_extract_all(word, F.lit("[a-z]+|[0-9]+"), F.lit(0))
        return F.when(F.size(runs) > 1, F.concat(F.array(word), runs)).otherwise(F.array(word))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.flatten(F.transform(words, parts))


_WORD, _RUN = "[a-z0-9_]", "(?:[a-z]+|[0-9]+)"


def token_count(low: Column) -> Column:
    """How many tokens a text in lower case has, counted without making them: its words, and the runs of words of several."""
    alone = f"(?<!{_WORD})_*{_RUN}_*(?!{_WORD})"
    return F.regexp_count(low, F.lit(f"{_WORD}+")) + F.regexp_count(low, F.lit(_RUN)) - F.regexp_count(low, F.lit(alone))


def token_frequency(low: Column, token: str) -> Column:
    """How often a text in lower case has a token: as a word, or as a run of a word of several."""
    found = F.regexp_count(low, F.lit(f"(?<!{_WORD}){token}(?!{_WORD})"))
    for kind in ("[a-z]", "[0-9]"):
        if re.fullmatch(f"{kind}+", token):
            found = found + F.regexp_count(low, F.lit(f"(?<!{kind}){token}(?!{kind})")) - F.regexp_count(low, F.lit(f"(?<!{_WORD})_*{token}_*(?!{_WORD})"))
    return F.when(F.contains(low, F.lit(token)), found).otherwise(0)


def lines(text: Column) -> Column:
    """The lines of a text, parted at line feeds."""
    return F.split(text, "\n", -1)


def first_lines(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(lines(F.coalesce(text, F.lit(""))), 1, n), "\n")


def imports(json_text: Column) -> Column:
    """The list of imports of its JSON text; null or no JSON gives an empty list."""
    return F.coalesce(F.from_json(json_text, "array<string>"), F.array().cast("array<string>"))


def filled(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(text != "", text)


def signature_text() -> Column:
    """What the signature vector is made of: symbol, scope, kind, doc, the first imports, the first lines."""
    named = imports(F.col("imports_json"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("symbol: "), filled(F.col("symbol_name"))),
        F.concat(F.lit("scope: "), filled(F.col("parent_symbol"))),
        F.concat(F.lit("kind: "), F.col("chunk_type")),
        F.concat(F.lit("doc: "), filled(F.col("docstring"))),
        F.when(F.size(named) > 0, F.concat(F.lit("imports: "), F.array_join(F.slice(named, 1, 3), ", "))),
        first_lines(F.col("raw_content")),
    )


def context_header() -> Column:
    """The comment lines that are put before a chunk: where it is from, what it is, its imports and its doc."""
    named = imports(F.col("imports_json"))
    symbol, parent = filled(F.col("symbol_name")), filled(F.col("parent_symbol"))
    kind = F.concat(F.lit(" ("), F.col("chunk_type"), F.lit(")"))
    what = (
        F.when(symbol.isNotNull() & parent.isNotNull(), F.concat(F.lit("// Scope: "), parent, F.lit(" -> "), symbol, kind))
        .when(symbol.isNotNull(), F.concat(F.lit("// Symbol: "), symbol, kind))
        .when(F.col("chunk_type") != "block", F.concat(F.lit("// Type: "), F.col("chunk_type")))
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("// [Context] Repository: "), F.col("repo_id"), F.lit(" | File: "), F.col("file_path"), F.lit(" | Language: "), F.col("language")),
        what,
        F.when(F.size(named) > 0, F.concat(F.lit("// Top Imports: "), F.array_join(F.slice(named, 1, 4), ", "))),
        F.concat(F.lit("// Doc: "), F.substring(F.replace(filled(F.col("docstring")), F.lit("\n"), F.lit(" ")), 1, 150)),
    )


def chunk_id() -> Column:
    """The first 16 hex digits of the SHA-256 of repository, file, first and last line."""
    return F.substring(F.sha2(F.concat_ws(":", "repo_id", "file_path", "start_line", "end_line"), 256), 1, 16)


def language(path: Column) -> Column:
    """The language by the suffix of the file name, else ``text``."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """Lower case for ASCII letters only, as LIKE compares them in the catalog."""
    return F.translate(text, _UPPER, _LOWER)


def contains_like(text: Column, part: Column) -> Column:
    """``text LIKE '%part%'``: ASCII letters of either case are equal, and % and _ in the part stay wild."""
    pattern = F.concat(F.lit("%"), F.replace(fold(part), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.call_function("like", fold(text), pattern)
