"""Files that nobody here wrote by hand: generated, minified, vendored, or data saved as code.

Copies are found by winnowing: every ``KGRAM`` neighbouring tokens of the normalized stream (without comments
and imports, all strings and all numbers alike) are hashed, and the smallest hash of each window of ``WINDOW``
is kept as a fingerprint. That single fingerprints recur says little, as usual turns of code do too; a copy
has most of its fingerprints together in one other file. Each file names a class: itself, if the others of the
class have ``COPIED`` of its fingerprints, and all files of which it has ``COPIED``. A class that lies in
``MIN_REPOS`` unrelated repositories holds third-party copies. Files of fewer than ``MIN_PRINTS`` fingerprints
are compared as a whole, by all their tokens; less than ``TINY`` tokens tell nothing.

All these pairs are found: files of equal fingerprints are one set, and a file that has ``COPIED`` of the
fingerprints of a set has some of its rarest too: of so many as it may lack and n more, at least n. So only sets
that have those in common are compared, by an exact count.

A repository that depends on another one of the class has the file from there, and does not count, unless
that one's own copy lies in a folder for code from outside.

Copies from outside that lie in one repository only cannot be told by recurrence. So paths, and what contents
say, are evidence too: comments of tools and of other projects, long lines without white space, and how much is
left of the code when literals are taken out. Paths are judged by the JVM. Contents are judged chunk by chunk,
so no file is ever put together, and the figures are added up.

Fingerprints are added up before they are shuffled, and the few that more than ``HEAVY_SHARE`` of all rows have
are joined by broadcast; no list of files is collected. The pairs of sets that are compared are all written,
so very many versions of one file, each a little different, cost the square of their number.

Defined results: files are those of file_hashes, once each, however many rows there are; a null path or
repository is no file. Files without chunks are judged by their path, null contents count as empty. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import broadcast_if_small, cut, spread

KGRAM = 8
WINDOW = 12
MIN_REPOS = 3
COPIED = 0.8
#: Files of fewer fingerprints are compared by all their tokens, which must be so many at least.
MIN_PRINTS = 12
TINY = 30
#: Share of a file's fingerprints that are looked up besides those that a copy may lack; any finds the same copies.
MORE = 0.1
#: Share of all rows from which a fingerprint is joined by broadcast; there can be at most one through it.
HEAVY_SHARE = 0.0005
#: A line is long from so many characters on, literals not counted.
LONG_LINE = 250
#: Of a line of so many characters only the comment with which it begins is searched for marks.
VERY_LONG = 400

#: Languages whose files may be minified, and those that hold no code.
MINIFIABLE = ("javascript", "typescript", "css", "scss", "less", "html")
NO_CODE = ("markdown", "text", "json", "yaml", "toml", "xml", "css", "scss", "less", "html", "sql", "csv")

_VENDOR_DIR = r"(?i)(?:^|/)(?:vendor|vendors|vendored|third[_-]?party|node_modules|bower_components|jspm_packages|godeps|_workspace|external|externals|extern|deps|site-packages|dist-packages|pods|carthage)/"
_VERSION_DIR = r"(?i)(?:^|/)(?!(?:release|version|stable|build|rev|rc|api|v|ver)s?[-_])[a-z][a-z0-9_.]*(?:-[a-z][a-z0-9_]*)*-v?\d+\.\d+(?:\.\d+)*/"
_GENERATED_DIR = r"(?i)(?:^|/)(?:generated|__generated__|_generated|generated[-_](?:src|sources?|code)|auto[-_]?generated|gen)/"
_GENERATED_NAME = r"(?i)(?:\.(?:g|pb|generated|gen|designer|pbobjc|grpc)\.\w+|_pb2(?:_grpc)?\.pyi?|_(?:grpc_)?pb(?:_service)?\.(?:d\.ts|js|ts|mjs)|[_-](?:auto)?generated(?:_\w+)?\.\w+|_(?:string|gen|enumer)\.go|(?:^|/)zz_generated[^/]*|\.pb\.(?:go|cc|h|rs))$"
_MINIFIED_NAME = r"(?i)[.-]min\.(?:js|css|mjs|cjs|html)$"
_LOCK_NAME = r"(?i)(?:^|/)(?:[\w.-]*[-_.]lock\.(?:json|ya?ml|toml)|[^/]+\.lockb?|go\.sum|npm-shrinkwrap\.json|package\.resolved)$"

_TOOL = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|\bdo not (?:manually )?(?:edit|modify|change)\b|auto-?generated\b|(?:code|file|source) (?:was |is |has been )?(?:automatically )?generated\b"
    r"|\bautomatically (?:generated|created|produced|written)\b|^\W*generated (?:by|from|with|using|on)\b|machine[- ](?:made|generated|written)|(?:created|written|made) by a (?:tool|script|program)\b"
    r"|^\W*produced by \S+.*(?:\d|edits|overwritten)|^\W*output of \S+ v?\d|^\W*bindings for \S+,? (?:written|generated|created|made) by|(?:edits?|changes) (?:are|is|may be|will be) (?:overwritten|lost)"
    r"|^\W*source:\s*\S+\.(?:proto|thrift|fbs|idl|avsc|capnp|g4|y)\b|\bregenerate (?:with|by|using)\b|\bautomatisch (?:erzeugt|generiert|erstellt)|generad[oa] automáticamente|généré automatiquement"
    r"|generato automaticamente|gerado automaticamente|automatisch gegenereerd|automatiskt genererad|автоматически (?:сгенерирован|создан)|自動生成"
)
_OTHERS = re.compile(
    r"(?i)\bvendored from\b|\b(?:unmodified|verbatim|unchanged) (?:import|copy) of\b|\bcopied (?:verbatim|unchanged|as[- ]is|unmodified)\b|\bupstream\s*[=:]\s*\S+|\bupstream (?:commit|revision|tag)\b|\bsend patches upstream\b"
    r"|^\W*origin:\s.*\b(?:repository|tag|commit|release)\b|\btaken over (?:as is|unchanged)\b|\bdistributed by the \S+ (?:project|team|developers)\b|\bpackage \S+,? (?:release|version) v?\d|^\W*[\w.-]+ - version v?\d+\.\d"
    r"|^\W*[\w.-]+ v?\d+\.\d+(?:\.\d+)?(?:\s*\|.*|\s*(?:\*/)?\s*)$|\bcopyright (?:\(c\) )?(?:\d{4}[-, \d]* )?the \S+ developers\b|\bsee the COPYING file of\b|\w+-(?:style|like) licen[cs]e\b"
)
#: What is negated is no mark; the rest of its line may still hold one.
_NEGATED = re.compile(
    r"(?i)(?:\bnot|\bnever|n't|\bno longer|\bused to be)\s+(?:(?:being|been|be|yet)\s+)?(?:auto-?|machine[- ]?|automatically )?(?:generated|vendored)\b(?: (?:by|from|with|using|on) \S+)?(?: any ?more\b)?"
    r"|\bauto-?generated (?:\w+ )?(?:stub|block)"
)
#: To be left alone by hands: what says so is no sign of a hand.
_HANDS_OFF = re.compile(
    r"(?i)(?:\b(?:not|never|cannot|no longer)\b|n't\b)[^.;:!?]*?(?:\bby hand\b|hand-?written\b)|(?:\bby hand|hand-?written (?:changes|edits|code)) (?:are|is|will be|get|may be) (?:lost|overwritten|discarded)"
)
_OWN = re.compile(
    r"(?i)^\W*(?:removes?|deletes?|skips?|helpers?|tests?|checks?|finds?|detects?|reads?)\b(?! (?:(?:are|were|is|was) )?(?:auto-?|automatically )?generated (?:by|from|with|using)\b)|\bby hand\b|hand-?written|\bused to be\b|\binspired\b"
    r"|\bfreely\b|as you like|\brewritten\b|\bnone of its\b|\b(?:not|n't|no longer) (?:true|valid|appl(?:y|ies))\b"
)
_FORBIDDEN = re.compile(r"(?i)\bdo not (?:manually )?(?:edit|modify|change)\b[^.;:!?]*?\bby hand\b")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|/?\*|--|<!--|\"\"\"|'''|;)")
_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
#: A string (kept) or a comment (dropped); whichever begins first protects what is in it.
_COMMENT = re.compile(rf"^[ \t]*\"\"\".*?\"\"\"|({_STRING.pattern})|//[^\n]*|/\*.*?\*/|^[ \t]*#[^\n]*", re.S | re.M)
_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*[,;]?\s*){4,}")
_FILLER = re.compile(r"[\s,;+()\[\]{}]+")
_IMPORT = re.compile(r"^\s*(?:import|from|use|using|package|#include|require|mod|extern)\b[^\n]*|^\s*(?:const|var|let)\s+\S+\s*=\s*require\([^\n]*", re.M)
_TOKEN = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_]\w*|\d[\w.]*|[^\s\w]", re.S)
_LOCKED = re.compile(r"lockfileVersion|\bintegrity\b|\bresolved\b|\bchecksum\b|sha(?:1|256|384|512)[-:]|content-hash")


def marks_of(line: str) -> tuple[bool, bool]:
    """Whether a comment line is a mark of a tool, and one of another project."""
    line = _NEGATED.sub(" ", line)
    if _OWN.search(_HANDS_OFF.sub(" ", line)) and not _FORBIDDEN.search(line):
        return False, False
    return bool(_TOOL.search(line)), bool(_OTHERS.search(line))


def leading(lines: list[str]) -> list[str]:
    """The lines up to the first line of code, those inside a comment included."""
    out, close = [], ""
    for line in lines:
        text = line.strip()
        if close:
            close = "" if close in text else close
        elif start := next((x for x in _CLOSE if text.startswith(x)), None):
            close = "" if _CLOSE[start] in text[len(start) :] else _CLOSE[start]
        elif text and not text.startswith(("//", "#", "--")):
            break
        out.append(line)
    return out


def comment_of(line: str, language: str | None) -> str:
    """The line, or if it is very long the comment with which it begins; long words and spaces hold no mark."""
    if len(line) < VERY_LONG:
        return line
    text = line.lstrip()
    if start := next((x for x in _CLOSE if text.startswith(x)), None):
        text = text[: end if (end := text.find(_CLOSE[start], len(start))) >= 0 else None]
    elif not text.startswith("//") and (language in MINIFIABLE or not text.startswith(("#", "--", "*"))):
        return ""
    return re.sub(r"\s+", " ", re.sub(r"\S{200,}", " ", text))


FEATURES = "chunk_id string, repo_id string, file_path string, chars long, wide long, plain long, literal long, residue long, bare long, long_chars long, long_blank long, by_tool boolean, by_others boolean, locked boolean, functions boolean, minifiable boolean, code boolean"


def features(text: str, language: str | None, kind: str | None, first_line: int) -> tuple:
    """What the content of one chunk says, in the order of FEATURES from chars on."""
    lines = text.splitlines()
    begins = leading(lines) if first_line <= 3 and kind != "doc" else []
    inside = {i for i, x in enumerate(begins) if x.strip()}
    every = [x for i, x in enumerate(lines if kind == "block" else begins) if i in inside or _COMMENT_LINE.match(x)]
    marks = [marks_of(c) for x in every if (c := comment_of(x, language) if _COMMENT_LINE.match(x) or len(x) < VERY_LONG else "")]
    by_tool, by_others = any(tool for tool, _ in marks), any(others for _, others in marks)
    minifiable, code = language in MINIFIABLE, language not in NO_CODE
    literal = residue = bare = long_chars = long_blank = 0
    plain = ""
    if minifiable or code and kind == "block":
        plain = _COMMENT.sub(r"\1", text)
        stripped = _NUMBERS.sub(" ", _STRING.sub("", plain))
        bare = len(_FILLER.sub("", stripped))
        literal = len(_FILLER.sub("", plain)) - bare
        residue = len(re.findall(r"[A-Za-z_]\w*", stripped))
        for x in stripped.splitlines():
            if len(x) > LONG_LINE:
                long_chars += len(x)
                long_blank += x.count(" ")
    locked = language in ("json", "yaml", "toml", "text", None) and bool(_LOCKED.search(text))
    return len(text), len(text.encode(errors="replace")) - len(text), len(plain), literal, residue, bare, long_chars, long_blank, by_tool, by_others, locked, kind in ("function", "method", "class"), minifiable, code


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        lines = batch.start_line.fillna(1).astype(int)
        rows = [(i, r, f, *features(t, lang, k, n)) for i, r, f, t, lang, k, n in zip(batch.chunk_id, batch.repo_id, batch.file_path, batch.raw_content, batch.language, batch.chunk_type, lines)]
        yield pd.DataFrame(rows, columns=names)


def winnow(texts: list[str], kgram: int = KGRAM, window: int = WINDOW, cache: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint) pairs of the texts, without repeats."""
    return _winnow(*_streams(texts, {} if cache is None else cache), len(texts), kgram, window)


def _streams(texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, list[int]]:
    """The hashes of all normalized tokens of the texts, and how many each text has."""
    hashes: list[int] = []
    sizes = []
    for text in texts:
        before = len(hashes)
        for token in _TOKEN.findall(_IMPORT.sub("", text)):
            value = cache.get(token)
            if value is None:
                c = token[0]
                value = 0 if token[:2] in ("//", "/*") or c == "#" else xxhash.xxh64_intdigest('"' if c in "\"'" else "0" if c.isdigit() else token) | 1
                if len(token) < 40:
                    cache[token] = value
            if value:
                hashes.append(value)
        sizes.append(len(hashes) - before)
    return np.array(hashes, dtype=np.uint64), sizes


def _winnow(stream: np.ndarray, sizes: list[int], texts: int, kgram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(texts), sizes)
    n = len(stream) - kgram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    grams = np.zeros(n, dtype=np.uint64)
    for i in range(kgram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + stream[i : i + n]
    grams ^= grams >> np.uint64(31)
    inside = owner[:n] == owner[kgram - 1 :]
    grams, owner = grams[inside], owner[:n][inside]
    if not len(grams):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    least, owners = [np.minimum.reduceat(grams, starts)], [owner[starts]]  # for texts shorter than a window
    m = len(grams) - window + 1
    if m > 0:
        low, step = grams, 1
        while 2 * step <= window:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        low = np.minimum(low[:m], low[window - step : window - step + m])
        within = owner[:m] == owner[window - 1 :]
        least.append(low[within])
        owners.append(owner[:m][within])
    pairs = np.unique(np.stack((np.concatenate(owners).astype(np.uint64), np.concatenate(least)), axis=1), axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1].view(np.int64) if pairs[:, 1].flags.c_contiguous else np.ascontiguousarray(pairs[:, 1]).view(np.int64)


_PRINTS = "repo long, outside boolean, file binary, print long, chunk long, stream long, tokens long"


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each fingerprint of a chunk, and one for the chunk with a hash of all its tokens."""
    cache: dict[str, int] = {}
    names = [x.split()[0] for x in _PRINTS.split(", ")]
    for batch in batches:
        if len(cache) > 200_000:
            cache.clear()
        texts = list(batch.raw_content)
        stream, sizes = _streams(texts, cache)
        which, prints = _winnow(stream, sizes, len(texts), KGRAM, WINDOW)
        repo, outside, file = batch.repo.to_numpy(), batch.outside.to_numpy(), batch.file.to_numpy()
        ends = np.cumsum(sizes)
        whole = [xxhash.xxh64_intdigest(stream[end - n : end].tobytes()) >> 1 for end, n in zip(ends, sizes)]
        own = pd.DataFrame({"repo": repo, "outside": outside, "file": file, "chunk": batch.chunk, "stream": whole, "tokens": sizes}).reindex(columns=names)
        found = pd.DataFrame({"repo": repo[which], "outside": outside[which], "file": file[which], "print": prints}).reindex(columns=names)
        yield pd.concat([own, found]).astype({c: "Int64" for c in names if c not in ("file", "outside")})


def unrelated(members: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(class, repos): in how many unrelated repositories the files of each class (class, repo, outside) lie.

    outside tells that a copy lies in a folder for code from outside, so that it is not the repository's own.
    """
    needs = dependencies.where("repo_id <> depends_on_repo_id").select(F.xxhash64("repo_id").alias("repo"), F.xxhash64("depends_on_repo_id").alias("source")).distinct()
    own = members.where("NOT outside").select("class", F.col("repo").alias("source")).distinct()
    related = members.select("class", "repo").join(broadcast_if_small(needs), "repo").join(own, ["class", "source"]).select("class", "repo")
    return members.select("class", "repo").distinct().join(related, ["class", "repo"], "left_anti").groupBy("class").agg(F.count("*").alias("repos"))


def _sets(prints: DataFrame) -> DataFrame:
    """(file, set, prints): the smallest of the files with the same fingerprints, and how many these are."""
    each = prints.groupBy("file").agg(F.count("*").alias("prints"), *[F.sum(F.xxhash64("print", F.lit(i)).cast("decimal(38,0)")).alias(f"hash{i}") for i in (1, 2)])
    same = ["prints", "hash1", "hash2"]
    return each.join(each.groupBy(*same).agg(F.min("file").alias("set")), same).select("file", "set", "prints")


def _shared_prints(prints: DataFrame, heavy_share: float) -> DataFrame:
    """The rows of prints that several sets have, with their number n."""
    counts = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    most = prints.count() * heavy_share
    heavy = counts.where(F.col("n") > most)  # at most 1 / heavy_share rows
    hot = prints.join(F.broadcast(heavy), "print")
    rest = prints.join(F.broadcast(heavy.select("print")), "print", "left_anti").join(counts.where(F.col("n") <= most), "print")
    return hot.unionByName(rest)


def _rarest(prints: DataFrame, copied: float) -> DataFrame:
    """(set, print, prints, more): of each set those of which a copy has more than ``more``, the rarest of as many as it may lack and ``more`` and one.

    prints has only those that several sets have, m of each set; the others are the rarest of all, and no copy has them.
    """
    order = Window.partitionBy("set").orderBy("n", "print")
    least = F.ceil(F.lit(copied) * F.col("prints"))
    more = F.greatest(F.lit(0), F.least(F.floor(F.lit(MORE) * F.col("prints")), least - 1))
    ranked = prints.withColumns({"rank": F.row_number().over(order) + F.col("prints") - F.col("m"), "lacking": F.col("prints") - least, "more": more})
    return ranked.where("rank <= lacking + more + 1").select("set", "print", "prints", "more")


def copied_files(chunks: DataFrame, dependencies: DataFrame, min_repos: int = MIN_REPOS, copied: float = COPIED, min_prints: int = MIN_PRINTS, tiny: int = TINY, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(file): hashes of (repo_id, file_path) of the files of code that are copies which lie in unrelated repositories."""
    code = chunks.where("raw_content IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL").where(~F.coalesce(F.col("language").isin(*NO_CODE), F.lit(False)))
    code = code.select(F.xxhash64("repo_id").alias("repo"), _outside().alias("outside"), file_key().alias("file"), F.xxhash64("chunk_id").alias("chunk"), "raw_content")
    rows = cut(spread(code).mapInPandas(_prints, _PRINTS).distinct())  # repeated rows of a chunk give equal ones
    sets = cut(_sets(rows.where("print IS NOT NULL").select("file", "print")))
    firsts = sets.where("file = set").select("set", "file", "prints")
    prints = rows.where("print IS NOT NULL").select("file", "print").join(firsts, "file").select("set", "print", "prints")
    shared = cut(_shared_prints(prints, heavy_share).withColumn("m", F.count("*").over(Window.partitionBy("set"))))
    large = shared.where((F.col("prints") >= min_prints) & (F.col("m") >= copied * F.col("prints")))
    leads = shared.select(F.col("set").alias("lead"), "print")
    near = _rarest(large, copied).join(shared.select(F.col("set").alias("lead"), "print", "m"), "print").where((F.col("set") != F.col("lead")) & (F.col("m") >= copied * F.col("prints")))
    asked = cut(near.groupBy("set", "lead").agg(F.count("*").alias("n"), F.first("more").alias("more")).where("n > more").select("set", "lead"))
    # an exact count of what both sets have; the key holds the fingerprint, so a set with very many copies is spread
    common = large.select("set", "print", "prints").join(asked, "set").join(leads, ["lead", "print"])
    alike = cut(common.groupBy("set", "lead").agg(F.count("*").alias("n"), F.first("prints").alias("prints")).where(F.col("n") >= copied * F.col("prints")).select("set", "lead"))
    # the set that names a class is in it if several files have it, or most of its own fingerprints are in the others
    several = sets.where("file <> set").where(F.col("prints") >= min_prints).select("set", F.col("set").alias("lead")).distinct()
    met = large.select("set", "print").join(alike, "set").select(F.col("lead").alias("set"), "print").distinct()
    met = shared.join(met, ["set", "print"], "left_semi").groupBy("set").agg(F.count("*").alias("n"), F.first("prints").alias("prints"))
    met = met.where(F.col("n") >= copied * F.col("prints")).select("set", F.col("set").alias("lead"))
    classes = alike.unionByName(several).unionByName(met).distinct().select("set", F.hex("lead").alias("class"))
    owners = rows.where("print IS NULL").select("file", "repo", "outside").distinct()
    members = classes.join(sets.join(owners, "file").select("set", "repo", "outside").distinct(), "set").withColumn("small", F.lit(False))
    # small files: all tokens of all chunks, in any order of the chunks
    whole = rows.where("print IS NULL").groupBy("file").agg(F.sum(F.col("stream").cast("decimal(38,0)")).alias("stream"), F.sum("tokens").alias("tokens"), F.count("*").alias("chunks"))
    few = whole.join(sets.where(F.col("prints") >= min_prints), "file", "left_anti").where(F.col("tokens") >= tiny).select(F.col("file").alias("set"), F.concat_ws("-", "stream", "tokens", "chunks").alias("class"))
    members = cut(members.unionByName(few.join(owners.withColumnRenamed("file", "set"), "set").withColumn("small", F.lit(True))))
    enough = unrelated(members, dependencies).where(F.col("repos") >= min_repos)
    found = members.join(enough, "class", "left_semi")
    return sets.join(found.where("NOT small"), "set", "left_semi").select("file").unionByName(found.where("small").select(F.col("set").alias("file"))).distinct()


def file_key() -> Column:
    """A hash of repository and path that is wide enough to tell all files apart."""
    return F.unhex(F.md5(F.concat_ws("\n", "repo_id", "file_path")))


def _outside() -> Column:
    return F.col("file_path").rlike(_VENDOR_DIR) | F.col("file_path").rlike(_VERSION_DIR)


def _by_path() -> Column:
    path = F.col("file_path")
    return (
        F.when(path.rlike(_LOCK_NAME) & F.coalesce(F.col("locked"), F.lit(True)), "lock")
        .when(_outside(), "third-party")
        .when(path.rlike(_GENERATED_DIR) | path.rlike(_GENERATED_NAME), "generated")
        .when(path.rlike(_MINIFIED_NAME), "minified")
    )


def judge(files: DataFrame, chunks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repo_id, file_path, reason, evidence) of each file that was not written by hand; evidence names all that speaks for it."""
    at = F.coalesce(F.col("last_modified"), F.lit(float("-inf")))
    own = files.where("repo_id IS NOT NULL AND file_path IS NOT NULL").groupBy("repo_id", "file_path").agg(F.max(F.struct(at.alias("at"), "size_bytes"))["size_bytes"].alias("size"))
    code = chunks.select("chunk_id", "repo_id", "file_path", "raw_content", "language", "chunk_type", "start_line").where("raw_content IS NOT NULL AND repo_id IS NOT NULL AND file_path IS NOT NULL")
    each = spread(code).mapInPandas(_features, FEATURES).distinct()  # repeated rows of a chunk give equal features
    sums = [F.sum(c).alias(c) for c in ("chars", "wide", "plain", "literal", "residue", "bare", "long_chars", "long_blank")]
    flags = [F.bool_or(c).alias(c) for c in ("by_tool", "by_others", "locked", "functions", "minifiable", "code")]
    per_file = each.groupBy("repo_id", "file_path").agg(*sums, *flags)
    copies = copied_files(chunks, dependencies).withColumn("copied", F.lit(True))
    # in characters as all other figures, so without what UTF-8 adds to the known ones; chunks that are missing count as ordinary code
    whole = F.greatest(F.coalesce("size", F.lit(0)) - F.col("wide"), "chars")
    by_data = F.col("code") & ~F.col("functions") & (F.col("residue") <= 12) & (F.col("literal") >= 0.8 * (F.col("literal") + F.col("bare"))) & (F.col("plain") >= 0.6 * whole) & (F.col("literal") >= 120)
    by_lines = F.col("minifiable") & (F.col("long_chars") >= 0.7 * F.col("bare")) & (F.col("long_chars") >= 0.4 * whole) & (F.col("long_blank") < 0.12 * F.col("long_chars")) & (F.col("long_chars") > 0)
    found = [(F.col("copied"), "third-party", "fingerprints"), (_by_path().isNotNull(), _by_path(), "path"), (F.col("by_tool"), "generated", "mark"), (F.col("by_others"), "third-party", "mark"), (by_data, "data", "literals"), (by_lines, "minified", "long lines")]
    reason = F.coalesce(*[F.when(test, why if isinstance(why, Column) else F.lit(why)) for test, why, _ in found])
    evidence = F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in found]))), ", ")
    keyed = own.join(per_file, ["repo_id", "file_path"], "left").withColumn("file", file_key())
    return keyed.join(copies, "file", "left").select("repo_id", "file_path", reason.alias("reason"), evidence.alias("evidence")).where("reason IS NOT NULL")
