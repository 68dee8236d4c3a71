"""Functions paired with their documentation.

Symbols (the latest row per symbol_id) are joined with the chunks of their file by name, bare or after
the parent, so that the shuffle is spread by file and name. Inside the tasks a recursive pattern takes
comment, signature and balanced body in one match, with strings and comments protected; what is no
descriptive prose is filtered.

Defined results: a null or blank docstring, or one that says nothing, is replaced by the docstring or
comment attached to the definition; without prose in either there is no pair. A chunk whose content is
null has no definition. If several chunks fit, the one with the smallest chunk_id is taken; repeated rows
count once. The pattern is tried at one place, where the comment above the definition begins, and its
repeats never give back what they took, so its steps are bounded by the text alone (a second for a body of
about 20,000 blocks), not by a clock. Where it does not fit (functions that are assigned to a name, bodies
that never close), the comment is found in the same way and the code is the rest of the chunk. Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STRING = r'(?:"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`(?:[^`\\]|\\.)*+`)'
#: The string that is a docstring.
_DOC = r"(?P<doc>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*+\"(?=[ \t]*(?:\n|$))|'(?:[^'\\\n]|\\.)*+'(?=[ \t]*(?:\n|$)))"
_COMMENT = r"(?://[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)"
_ARGS = rf"(?P<args>\((?:[^()\"'`]++|{_STRING}|(?&args)|[\"'`])*+\))"

#: Languages with braces: attached comments and marks, the signature, and the balanced body.
BRACES = regex.compile(
    rf"(?P<head>(?:^[ \t]*(?:{_COMMENT}|@[\w.]+(?:\([^\n]*\))?|\#!?\[[^\n]*\])[ \t]*\n)*+)"
    r"(?P<sig>^[ \t]*(?!(?:if|for|while|switch|catch|return|else|do|try|new|throw|await)\b)(?:func[ \t]*\([^()\n]*\)[ \t]*)?"
    rf"[^\n(){{}};]*?\b(?P<name>[\w$]++)[ \t]*(?:<[^\n()]*>)?[ \t]*{_ARGS}[^{{}};\n]*)"
    rf"(?P<body>\{{(?:[^{{}}\"'`/]++|{_STRING}|{_COMMENT}|[\"'`/]|(?&body))*+\}})",
    regex.MULTILINE,
)
#: Python: comments and decorators, the signature, the docstring, and the indented body.
INDENTED = regex.compile(
    r"(?P<head>(?:^[ \t]*(?:\#[^\n]*|@[\w.]+(?:\([^\n]*\))?)[ \t]*\n)*+)"
    rf"(?P<sig>^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*{_ARGS}[^\n:]*:)[ \t]*(?:\#[^\n]*)?"
    rf"(?P<body>(?:\s*?\n(?P=indent)[ \t]+[rRuUbB]{{0,2}}{_DOC})?"
    r"(?:[^\n]*(?:\n(?:[ \t]*(?=\n)|(?P=indent)[ \t]+))?)*)",
    regex.MULTILINE | regex.DOTALL,
)
#: The docstring after the first line of a definition whose body has no usual form.
_QUOTED = regex.compile(rf"[^\n]*:[ \t]*\n\s*[rRuUbB]{{0,2}}{_DOC}", regex.DOTALL)
_MARKED = regex.compile(rf"{_COMMENT}|^[ \t]*\#(?!!?\[)[^\n]*", regex.MULTILINE)


def _above(lines: list[str], line: int) -> int:
    """The first line of the comments and marks that stand directly above a line, whole block comments included."""
    while line > 0:
        text = lines[line - 1].strip()
        if text.endswith("*/"):
            first = line - 1
            while first > 0 and "/*" not in lines[first]:
                first -= 1
            if not lines[first].lstrip().startswith("/*"):
                return line
            line = first
        elif text.startswith(("//", "#", "@")):
            line -= 1
        else:
            return line
    return line


def capture(text: str, name: str, language: str | None, line: int) -> tuple[str, str]:
    """(documentation, code) of the definition of name in text; line: its index in the text's lines."""
    python = language == "python"
    lines = text.split("\n")
    line = min(max(line, 0), len(lines) - 1)
    # a signature has its name in its first line: the nearest one that holds it
    above = _above(lines, next((i for i in range(line, -1, -1) if name in lines[i]), line))
    found = (INDENTED if python else BRACES).match(text, sum(map(len, lines[:above])) + above)
    if found and found["name"] == name:
        first = text.count("\n", 0, found.start("sig"))
        if first <= line <= first + found["sig"].count("\n"):
            doc = found["doc"] if python and found["doc"] else "\n".join(_MARKED.findall(found["head"]))
            return doc, found.group().strip("\n")
    above = _above(lines, line)
    doc = "\n".join(x for x in lines[above:line] if not regex.match(r"\s*(?:@[\w.]+(?:\(.*)?$|#!?\[)", x))
    rest = "\n".join(lines[line:])
    if python and (quoted := _QUOTED.match(rest)):
        doc = quoted["doc"]
    return doc, "\n".join([*lines[above:line], rest])


_EDGES = regex.compile(r"^\s*(?:/\*+!?|\*+/|//+!?|#+|\*(?!\*)|\"{3}|'{3})\s?|\s*(?:\*+/|\"{3}|'{3})\s*$")
_RULER = regex.compile(r"[\W_]*(?:\w+)?[\W_]*")
_DIRECTIVE = regex.compile(
    r"(?i)(?:eslint|tslint|jshint|pylint|flake8|noqa|nolint|nosec|nosonar|lint[:-]|type:\s*ignore|mypy:|pyright:|@ts-|prettier-|istanbul|c8 ignore|pragma|go:|fmt:|isort:|yapf:"
    r"|ruff:|region\b|endregion\b|-\*-|coding[:=]|vim:|clang-|rubocop|checkstyle|sourcemappingurl|@suppress|@jsx|\+build\b|!\[)"
)
_STAMP = regex.compile(r"(?i)(?:last[ -]?(?:modified|updated?|changed?)|created|updated|modified|changed|generated|date|version|revision|rev|copyright|author)\b\s*(?:on|by|at|in|\(c\))?\s*:?\s*v?[\d./:,\- ]{3,}\W*")
_CREDIT = regex.compile(r"(?i)(?:authors?|maintainers?|owners?|since|reviewers?|written by|reviewed by|contact|email)\b\s*:?\s*[\w.@<>,-]+(?:\s+[\w.@<>,-]+){0,2}\W*")
_PLACEHOLDER = regex.compile(
    r"(?i)\W*(?:(?:todo|fixme|xxx|hack|wip|tbd)\b.*|n\s*/\s*a|none|null|nil|undefined|unknown|empty|test|docstring|description|documentation|comment|summary|placeholder|doc"
    r"|see (?:above|below)|same as above|as above|ditto|to be (?:written|done|documented|filled(?: in)?|added)|coming soon|lorem ipsum.*"
    r"|(?:missing|no|add|insert|write|put|your|enter|fill in)\s+(?:the\s+|your\s+|a\s+)?(?:documentation|description|docs?|docstring|comment)s?(?:\s+(?:here|available|yet|provided|given|goes here))*"
    r"|(?:\w+\s+)?(?:description|documentation|docstring|comment|docs?)\s+(?:goes|comes|is)?\s*here"
    r"|auto[- ]?generated (?:method|function|constructor|catch|class)?\s*(?:stub|block|code)?|\{?@?inherit-?doc\}?|documentation (?:pending|missing)|not documented(?: yet)?)\W*"
)
_CODE = regex.compile(
    r"(?:.*[;{}]\s*$|[\w.\[\]\"'$]+\s*(?::=|[-+*/|&]?=)(?!=)\s*\S.*|(?:return|if|for|while|elif|else|import|from|const|let|var|def|func|fn|class|raise|throw|print|assert|await|yield|del|use|package)\b[^.!?]*[(){}\[\]=:;]\s*"
    r"|[\w$]+(?:(?:\.|::|->)[\w$]+)*\([^\s].*\)\s*|[\w$]+(?:(?:\.|::|->)[\w$]+)*\(\)\s*)$"
)
#: Tags whose text is an explanation, after an optional type and name; of all other tags nothing is prose.
_EXPLAINED = regex.compile(
    r"[@\\:](?:param|parameter|arg|argument|return|returns|throws?|raises?|exception|yields?|property|prop|brief|summary|description|desc|details|note|remarks?|warning|deprecated|example)\b:?"
    r"(?P<rest>.*)"
)
_NAMED = regex.compile(r"^[@\\:](?:param|parameter|arg|argument|property|prop|throws?|raises?|exception)\b")
_TAG = regex.compile(r"[@\\:]\w+|\{@\w+[^}]*\}\s*$")
_SECTION = regex.compile(r"(?i)(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|notes?|attributes)\s*:?")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")
_PARTS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{L}+")
_WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
#: Words that say nothing beside the name of what they stand for.
_EMPTY = frozenset("a an the this that these its his her it given of for to in on at by and or with from as is are be will function method procedure routine func def class api endpoint helper".split())


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ing", "ies", "es", "s", "ed"):
        if len(word) > len(end) + 2 and word.endswith(end):
            return word[: -len(end)]
    return word


def _parts(text: str) -> list[str]:
    return [p for w in _WORD.findall(text.replace("_", " ")) for p in _PARTS.findall(w)]


def prose(doc: str | None, name: str | None, parent: str | None = None) -> str:
    """What the documentation says in words; empty if it says nothing."""
    if not doc or not doc.strip():
        return ""
    kept = []
    for raw in unicodedata.normalize("NFC", doc).replace("\r", "\n").split("\n"):
        line = raw.strip()
        for _ in range(3):
            line = _EDGES.sub("", line).strip()
        if not line or _DIRECTIVE.match(line) or _STAMP.fullmatch(line) or _CREDIT.fullmatch(line) or _PLACEHOLDER.fullmatch(line) or _SECTION.fullmatch(line):
            continue
        if tag := _EXPLAINED.match(line):
            rest = regex.sub(r"^\s*(?:\{[^}]*\}|\[[^\]]*\])?\s*", "", tag["rest"])
            if _NAMED.match(line):
                rest = regex.sub(r"^[\w.$\[\]*]+\s*:?\s*[-–:]?\s*", "", rest)
            line = rest.strip(" :-")
        elif _TAG.match(line):
            continue
        if not line or _CODE.fullmatch(line):
            continue
        if not _WIDE.search(line) and _RULER.fullmatch(line):
            continue
        kept.append(line)
    text = " ".join(kept)
    if len(_WIDE.findall(text)) >= 4:
        return text
    known = {_stem(p) for p in _parts(name or "") + _parts(parent or "")}
    said = [p for p in _parts(text) if len(p) > 1 and p.lower() not in _EMPTY and _stem(p) not in known and not any(_same(_stem(p), k) for k in known)]
    return text if len(said) >= 2 else ""


def _same(a: str, b: str) -> bool:
    """Forms of one word, such as copies and copy, or pruned and prune."""
    short, long = sorted((a, b), key=len)
    return len(short) >= 3 and len(long) - len(short) <= 2 and long.startswith(short[:-1] if len(short) > 3 else short)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            text = r.raw_content.replace("\r\n", "\n").replace("\r", "\n")
            own = prose(r.docstring, r.name, r.parent_symbol)
            doc, code = capture(text, r.name, r.language, int(r.line_number - r.start_line))
            said = own or prose(doc, r.name, r.parent_symbol)
            if said:
                rows.append((r.symbol_id, r.chunk_id, code, said))
        if rows:
            yield pd.DataFrame(rows, columns=["symbol_id", "chunk_id", "code", "description"])


def pairs(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(symbol_id, chunk_id, code, description) of each function or method with documentation that says something."""
    order = F.struct(F.coalesce(F.col("indexed_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "repo_id", "file_path", "name", "kind", "line_number", "docstring", "parent_symbol")
    latest = (
        symbols.where(F.col("symbol_id").isNotNull())
        .groupBy("symbol_id")
        .agg(F.max(order).alias("row"))
        .select("symbol_id", "row.*")
        .where(F.col("kind").isin("function", "method") & F.col("name").isNotNull() & F.col("line_number").isNotNull())
    )
    spelt = latest.withColumn("symbol_name", F.explode(F.array_distinct(F.array_compact(F.array("name", F.concat_ws(".", "parent_symbol", "name"))))))
    lines = F.col("start_line") + F.size(F.split("raw_content", "\n", -1)) - 1
    code = (
        chunks.where(F.col("symbol_name").isNotNull() & F.col("raw_content").isNotNull() & F.col("start_line").isNotNull())
        .select("chunk_id", "repo_id", "file_path", "symbol_name", "language", "start_line", "raw_content", lines.alias("last_line"))
    )
    joined = spelt.join(code, ["repo_id", "file_path", "symbol_name"]).where(F.col("line_number").between(F.col("start_line"), F.col("last_line")))
    wanted = joined.select("symbol_id", "name", "parent_symbol", "docstring", "line_number", "chunk_id", "language", "start_line", "raw_content")
    out = wanted.mapInPandas(_extract, "symbol_id string, chunk_id string, code string, description string")
    return out.groupBy("symbol_id").agg(F.min(F.struct("chunk_id", "code", "description")).alias("pair")).select("symbol_id", "pair.*")
