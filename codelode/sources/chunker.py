"""Source files cut into chunks: sections at top-level constructs, and large sections at the separators of the language.

Sections, lines, symbols, enclosing classes, imports and headers are DataFrame expressions; only the
recursive cut of sections over the limit is a small Python helper in a pandas UDF.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.text import chunk_id, context_header, language, strip
from codelode.operators.changes import last_wins
from codelode.sources.lines import code_lines, import_lines

LIMIT, OVERLAP = 800, 100

#: Where a language begins a section, and the separators of its large sections, strongest first.
SECTIONS = {
    "python": r"(?=\n(?:class|def|async def)\s+)",
    "typescript": r"(?=\n(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|interface|type|enum|function|const|let|var)\s+)",
    "javascript": r"(?=\n(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|interface|type|enum|function|const|let|var)\s+)",
    "go": r"(?=\n(?:func|type|package)\s+)",
    "rust": r"(?=\n(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod)\s+)",
    "markdown": r"(?=\n#{1,6}\s+)",
    "sql": r"(?i)(?=\n(?:CREATE|SELECT|INSERT|UPDATE|DELETE|ALTER|DROP)\s+)",
}
OTHER_SECTION = r"(?=\n\n)"
_LAST = ["\n\n", "\n", " ", ""]
SEPARATORS = {
    "python": ["\nclass ", "\ndef ", "\nasync def ", "\n    def ", "\n    async def ", "\n\tdef ", "\n\tasync def "],
    "typescript": ["\nexport interface ", "\ninterface ", "\nexport class ", "\nclass ", "\nexport function ", "\nexport async function ", "\nfunction ", "\nasync function ", "\nexport const ", "\nconst ", "\nexport enum ", "\nenum ", "\nexport type ", "\ntype ", "\nnamespace ", "\nexport "],
    "javascript": ["\nexport class ", "\nclass ", "\nexport function ", "\nexport async function ", "\nfunction ", "\nasync function ", "\nexport const ", "\nconst ", "\nexport let ", "\nexport var ", "\nexport "],
    "go": ["\nfunc ", "\ntype ", "\npackage ", "\nimport "],
    "rust": ["\npub async fn ", "\nasync fn ", "\npub fn ", "\nfn ", "\npub struct ", "\nstruct ", "\npub enum ", "\nenum ", "\npub trait ", "\ntrait ", "\nimpl ", "\npub mod ", "\nmod "],
    "java": ["\npublic class ", "\nclass ", "\npublic interface ", "\ninterface ", "\nenum ", "\npublic ", "\nprotected ", "\nprivate "],
    "cpp": ["\nclass ", "\nstruct ", "\nenum ", "\nnamespace ", "\ntemplate"],
    "c": ["\nstruct ", "\nenum ", "\ntypedef "],
    "csharp": ["\npublic class ", "\nclass ", "\npublic interface ", "\ninterface ", "\nenum ", "\nstruct ", "\nnamespace "],
    "ruby": ["\ndef ", "\nclass ", "\nmodule "],
    "php": ["\nfunction ", "\nclass ", "\ninterface ", "\ntrait "],
    "markdown": ["\n# ", "\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "```\n"],
    "html": ["<body", "<main", "<header", "<footer", "<section", "<article", "<div", "<p", "<br", "<li"],
    "sql": ["\nCREATE TABLE ", "\nCREATE ", "\nSELECT ", "\nINSERT ", "\nUPDATE ", "\nDELETE ", "\nALTER ", "\nDROP "],
    "solidity": ["\ncontract ", "\ninterface ", "\nlibrary ", "\nfunction ", "\nstruct ", "\nenum ", "\npragma "],
}


#: The line by which a chunk of a language is named, and the indent of a Python definition.
NAMED_BY = {
    "python": r"(?m)^\s*(?:(class)\s+([A-Za-z0-9_]+)|(?:async\s+)?(def)\s+([A-Za-z0-9_]+))",
    "script": r"(?m)^(?:.*?(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|interface|type|enum|function)\s+([A-Za-z0-9_$]+)|.*?(?:export\s+)?(?:const|let|var)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?(?:\([^)\n]*\)|[A-Za-z0-9_$]+)\s*=>)",
    "go": r"(?m)^\s*(?:func\s+(?:\((?:[^)]+)\)\s+)?([A-Za-z0-9_]+)|type\s+([A-Za-z0-9_]+)\s+(struct|interface))",
    "rust": r"(?m)^\s*(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|impl)\s+([A-Za-z0-9_]+)",
    "markdown": r"(?m)^\s*#{1,6}\s+(.+)$",
}
PYTHON_INDENT = r"(?m)^([ \t]*)(?:class|(?:async\s+)?def)\s+[A-Za-z0-9_]+"

_PIECES = "array<struct<piece:string,lines_before:int>>"


def recursive_spans(text: str, separators: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the text that are mostly below the limit, cut before the strongest separator there is.

    A stretch is parted before each place of the first separator of its list that it holds. Parts of the limit or more
    are stretches of their own, with the weaker separators only; neighbours among the others are put together.
    """
    done: list[tuple[int, int]] = []
    waiting = [(0, len(text), separators, False)]  # stretches still to be parted, the next one last
    while waiting:
        low, high, level, whole = waiting.pop()
        if whole:
            done.append((low, high))
            continue
        used = next((i for i, s in enumerate(level) if not s or text.find(s, low, high) >= 0), len(level) - 1)
        weaker = level[used + 1 :] if level[used] and text.find(level[used], low, high) >= 0 else []
        parts = _parts(text, low, high, level[used])
        later = []
        for large, run in groupby(parts, key=lambda p: p[1] - p[0] >= limit):
            if large:
                later.extend((a, b, weaker, not weaker) for a, b in run)
            else:
                later.extend((a, b, [], True) for a, b in _together(list(run), limit, overlap))
        waiting.extend(reversed(later))
    return done


def _parts(text: str, low: int, high: int, separator: str) -> list[tuple[int, int]]:
    """The stretch parted before each place of the separator; before each character for an empty one."""
    at = [m.start() for m in re.finditer(re.escape(separator), text[low:high])] if separator else range(high - low)
    bounds = [low, *(low + i for i in at if i), high]
    return list(zip(bounds, bounds[1:])) if high > low else []


def _together(run: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Neighbouring parts put together up to the limit; the last ones, up to the overlap, begin the next span too."""
    out, first = [], 0
    for last in range(len(run)):
        if last + 1 < len(run) and run[last + 1][1] - run[first][0] <= limit:
            continue
        out.append((run[first][0], run[last][1]))
        if last + 1 < len(run):
            end, new = run[last][1], run[last + 1][1]
            first = next((i for i in range(first, last + 1) if end - run[i][0] <= overlap and new - run[i][0] <= limit), last + 1)
    return out


def _pieces(texts: pd.Series, languages: pd.Series) -> pd.Series:
    result = []
    for text, name in zip(texts, languages):
        found, cursor = [], 0
        for low, high in recursive_spans(text, SEPARATORS.get(name, []) + _LAST):
            piece = text[low:high].strip()
            if piece:
                at = text.find(piece, cursor)
                at = cursor if at < 0 else at
                cursor = at + 1
                found.append({"piece": piece, "lines_before": text.count("\n", 0, at)})
        result.append(found)
    return pd.Series(result)


def sections(files: DataFrame, content: str = "content") -> DataFrame:
    """(repo_id, file_path, language, section_no, lines_before, section): the files cut at top-level constructs."""
    text, name = F.col(content), language(F.col("file_path"))
    parts = F.split(text, OTHER_SECTION, -1)
    for known, pattern in SECTIONS.items():
        parts = F.when(name == known, F.split(text, pattern, -1)).otherwise(parts)
    cut = files.where(text.rlike(r"\S")).select("repo_id", "file_path", name.alias("language"), F.posexplode(parts).alias("section_no", "section"))
    before = Window.partitionBy("repo_id", "file_path").orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)
    newlines = F.length("section") - F.length(F.replace("section", F.lit("\n"), F.lit("")))
    return cut.withColumn("lines_before", F.coalesce(F.sum(newlines).over(before), F.lit(0)).cast("int")).where(F.col("section").rlike(r"\S"))


def _detected() -> tuple[Column, Column]:
    """The symbol and type of a chunk by the first line that defines something in its language."""
    name, text = F.col("language"), F.col("raw_content")

    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    python, script, go, rust, heading = NAMED_BY.values()
    indented = found(PYTHON_INDENT, 1)
    scripted = F.when(found(script, 1).isin("type", "enum"), "struct").when(found(script, 1) != "", found(script, 1)).when(found(script, 3) != "", "function")
    symbol = (
        F.when(name == "python", F.concat(found(python, 2), found(python, 4))).when(name.isin("typescript", "javascript"), F.concat(found(script, 2), found(script, 3)))
        .when(name == "go", F.concat(found(go, 1), found(go, 2))).when(name == "rust", found(rust, 2)).when(name == "markdown", strip(found(heading, 1)))
    )
    kind = (
        F.when((name == "python") & (found(python, 1) != ""), "class").when((name == "python") & (found(python, 3) != ""), F.when(indented.startswith("    ") | indented.startswith("\t"), "method").otherwise("function"))
        .when(name.isin("typescript", "javascript"), scripted).when((name == "go") & (found(go, 1) != ""), "function").when((name == "go") & (found(go, 3) != ""), found(go, 3))
        .when((name == "rust") & (found(rust, 1) != ""), F.when(found(rust, 1) == "fn", "function").otherwise("struct")).when((name == "markdown") & found(heading, 1).isNotNull() & (found(heading, 1) != ""), "doc")
    )
    return F.when(symbol != "", symbol), F.coalesce(kind, F.lit("block"))


def chunk_files(files: DataFrame) -> DataFrame:
    """The chunks of files (repo_id, file_path, content), with symbols, headers and ids; of equal ids the last wins."""
    cut = sections(files)
    small = cut.where(F.length("section") <= LIMIT).select("*", F.lit(0).alias("piece_no"), F.col("section").alias("piece"), F.col("lines_before").alias("before"))
    large = cut.where(F.length("section") > LIMIT).select("*", F.posexplode(F.pandas_udf(_pieces, _PIECES)("section", "language")).alias("piece_no", "x"))
    large = large.select(*cut.columns, "piece_no", F.col("x.piece").alias("piece"), (F.col("lines_before") + F.col("x.lines_before")).alias("before"))
    lines = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    doc = F.regexp_extract("piece", r'(?s)"""(.*?)"""', 1), F.regexp_extract("piece", r"(?s)'''(.*?)'''", 1)
    rows = small.unionByName(large).select(
        "repo_id", "file_path", "language", "section_no", "piece_no", (F.col("before") + 1).alias("start_line"), (F.col("before") + 1 + lines).alias("end_line"),
        strip(F.col("piece")).alias("raw_content"), F.when(F.col("piece").rlike(r"(?s)\"\"\".*?\"\"\"|'''.*?'''"), strip(F.when(doc[0] != "", doc[0]).otherwise(doc[1]))).alias("docstring"),
        F.when(F.col("piece").startswith("\n"), F.col("before") + 1).otherwise(F.col("before")).alias("seen"),
    )
    symbol, kind = _detected()
    rows = rows.withColumns({"symbol_name": symbol, "chunk_type": kind})
    # functions of Python that follow a class belong to the nearest one before
    every = code_lines(files.select("repo_id", "file_path", "content", language(F.col("file_path")).alias("language")), "content")
    class_name = F.regexp_extract(strip(F.col("line")), r"^class\s+([A-Za-z0-9_]+)", 1)
    classes = every.where("language = 'python'").select("repo_id", "file_path", F.col("line_number").alias("class_line"), class_name.alias("class_name")).where("class_name <> ''")
    keys = ["repo_id", "file_path", "section_no", "piece_no"]
    parents = rows.where("language = 'python' AND chunk_type = 'function'").select(*keys, "seen").join(classes, ["repo_id", "file_path"]).where("class_line <= seen")
    parents = parents.groupBy(*keys).agg(F.max_by("class_name", "class_line").alias("parent_symbol"))
    rows = rows.join(parents, keys, "left").withColumn("chunk_type", F.when(F.col("parent_symbol").isNotNull(), "method").otherwise(F.col("chunk_type")))
    rows = rows.join(import_lines(every), ["repo_id", "file_path"], "left").withColumn("imports_json", F.to_json(F.coalesce("imports", F.array().cast("array<string>"))))
    rows = rows.withColumn("enriched_content", F.concat_ws("\n", context_header(), "raw_content")).withColumn("imports_json", F.to_json(F.slice(F.coalesce("imports", F.array().cast("array<string>")), 1, 5)))
    rows = rows.withColumn("chunk_id", chunk_id())
    rows = last_wins(rows, ["chunk_id"], ["section_no", "piece_no"])
    return rows.select("chunk_id", "repo_id", "file_path", "language", "start_line", "end_line", "raw_content", "enriched_content", "symbol_name", "chunk_type", "parent_symbol", "imports_json", "docstring")
