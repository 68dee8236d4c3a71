"""Language of documents and of their segments, and labels that are missing or wrong.

A multinomial naive Bayes model over hashed character n-grams is fitted on labelled samples, and then once
more together with sentences of about ``FIT_ROWS`` documents that have a label: those that the first model
does not find to be surely in another language than their label and most of their text say. The counts
are added up by Spark; the matrix of log-probabilities has ``BUCKETS`` rows and one column per language,
so its size does not depend on the data, and it is broadcast. Documents are scored batch by batch in
numpy: all n-grams of a batch are hashed at once and their rows of the matrix added up per segment.

A text is cut into segments (sentences of running text). Code, logs, links, identifiers and numbers are
taken out first; headings are no sentences. Letters are compared in lower case without accents, so that
lost accents, capitals and composed or decomposed letters make no difference.

Defined results: null, empty and blank texts, and those with no sentence, have no segments and are no
case. Repeated rows give repeated segments but one case. A null label is a missing one. Between languages
of equal score the first in alphabetical order wins. Without samples nothing can be told (a ValueError).
Texts of any length are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.session import spread

#: Labelled documents on which the model is fitted besides the samples (taken by a hash of doc_id).
FIT_ROWS = 10_000
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4, 5)
SMOOTHING = 0.02
#: Confidence from which a sentence in a language of its own makes a text a mixed one.
SURE = 0.9
#: Confidence in the language of the label up to which a sentence is not used to fit the model.
FOREIGN = 1e-3
#: Fewer words and letters, or letters of a script without spaces, tell too little to be called a sentence.
LEAST_WORDS, LEAST_LETTERS, LEAST_WIDE = 3, 12, 5
#: A log-likelihood ratio counts by this factor, as n-grams of one word are not independent.
TEMPER = 0.12

#: Codes and names by which a label may call a language.
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語 nihongo",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "sv": "sv swe swedish svenska",
}

_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.MULTILINE | re.DOTALL)
#: What is no running text, left to right; it begins at the start of a word, or with a mark.
_NOISE = re.compile(
    r"(?:(?<![A-Za-z0-9_])|(?=[`@#\[<(]))(?=\S?[^\s`@#<\[/_0-9(:.A-Z]*[`@#<\[/_0-9(:.A-Z])(?:`[^`\n]*`|(?:https?|ftp|file)://\S+|www\.\S+|(?:(?<!\S)|(?<=[`>\])]))\S+@\S+|\[\[[^\]\n]*\]\]|<[^<>\n]{1,80}>|[@#][A-Za-z0-9_][\w-]*|\(\s*\)"
    r"|(?<![A-Za-z0-9_])(?:^[ \t]*[a-z]+(?:\([^)\n]*\))?!?:(?=\s)|[A-Za-z0-9_]*[0-9_][A-Za-z0-9_]*|\b[a-z]+[A-Z][A-Za-z0-9_]*|\b[A-Z][a-z]+[A-Z][A-Za-z0-9_]*|\b[A-Za-z_]+(?:\.[A-Za-z_]+)+(?:\(\))?"
    r"|(?:\.{0,2}/)?[A-Za-z0-9_][\w.-]*(?:/[A-Za-z0-9_][\w.-]*)+(?::\d+)?))",
    re.MULTILINE,
)
_LOG = re.compile(r"^\s*(?:\[?\d{1,4}[-:/.]\d{1,2}[-:/.]\d{1,4}[^\n]*|\$ [^\n]*|at [\w.$]+\([^\n]*|Traceback[^\n]*|File \"[^\n]*)$")
#: How a line of code begins, and what it ends with.
_CODE_LINE = re.compile(
    r"\s*(?:for|if|while)\b.*\b(?:in|==|!=|<|>).*:\s*\S*\(|\s*[\w.\[\]\"']+\s*(?::=|[-+*/]?=)(?!=)\s*\S|\s*(?:const|let|var|return|import|from|def|func|fn|class|use|package)\s[^.]*[(={:;]|\w+ctl\s"
)
_CODE_ENDS = (";", "{", "}", ")")
_HEADING = re.compile(r"^\s*#{1,6}\s")
_LEAD = re.compile(r"^[\s>*+|•·-]*(?:\d+[.)]\s+)?(?:\[[ x]\]\s*)?")
#: Where a sentence may end; after a stop and white space it does not if a small letter follows.
_BREAK = re.compile(r"([.!?…][\"')\]»”]*\s+)(?=\S)|[。！？]|\s+[/|]\s+|\t+|\|")
#: Without any of these a line holds no noise.
_MAY_BE_NOISE = re.compile(r"[`@#<\[/_0-9(:]|\w\.\w|[a-z][A-Z]|www\.")
_WIDE = re.compile(r"[ᄀ-ᇿ⺀-鿿가-힯豈-﫿\U00020000-\U0003ffff]")
_LOOSE = re.compile(r"['’]{2,}|(?<![^ \n])['’]|['’](?![^ \n])")
_SPACES = re.compile(" {2,}")
_REPEATED = re.compile(r"(?<![^ \n])([^ \n])\1{5,}(?![^ \n])")


COUNTS = "lang string, bucket long, n long"
Model = tuple[list[str], np.ndarray]


class _Folding(dict):
    """What each character is worth: letters in lower case without accents, apostrophes and line feeds as they are, else a space."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", chr(code)).lower())
        kept = [c for c in parts if unicodedata.category(c) != "Mn"]
        own = self[code] = "".join(c if c in "'’" or unicodedata.category(c)[0] in "LM" else " " for c in kept)
        return own


_FOLDING = _Folding({10: "\n"})


def normalize_all(texts: list[str]) -> list[str]:
    """Of each text the words in lower case without accents, one space around each; long runs of one letter are no words."""
    folded = "\n".join(t.replace("\n", " ") for t in texts).translate(_FOLDING)
    if "'" in folded or "’" in folded:
        folded = _LOOSE.sub(" ", folded)
    lines = _SPACES.sub(" ", _REPEATED.sub("", folded)).split("\n")
    return [f" {own} " if (own := line.strip(" ")) else "" for line in lines]


def normalize(text: str) -> str:
    return normalize_all([text])[0]


def _blank(found: re.Match) -> str:
    """As many spaces, which keeps the offsets."""
    return " " * len(found[0]) if "\n" not in found[0] else re.sub(r"[^\n]", " ", found[0])


def _breaks(body: str, first: int) -> list[int]:
    marks = [first]
    for found in _BREAK.finditer(body, first):
        if not found[1] or "\t" in found[1] or unicodedata.category(body[found.end()]) != "Ll":
            marks.append(found.end())
    return [*marks, len(body)]


def raw_sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, running text) of what may be a sentence; offsets are in the text, noise is blanked out."""
    out = []
    text = text.replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_blank, text)
    at = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if not line or line.isspace() or _HEADING.match(line) or line.rstrip().endswith(_CODE_ENDS) or _LOG.match(line) or _CODE_LINE.match(line):
            continue
        body = _NOISE.sub(_blank, line) if _MAY_BE_NOISE.search(line) else line
        marks = _breaks(body, _LEAD.match(body).end())
        out.extend((start + low, start + high, body[low:high]) for low, high in zip(marks, marks[1:]))
    return out


def sentences_of(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, normalized words) of each sentence of running text, for each text.

    Less than ``LEAST_WORDS`` words or ``LEAST_LETTERS`` letters, or of scripts without spaces ``LEAST_WIDE``
    letters, are no sentence.
    """
    found = [raw_sentences(t) for t in texts]
    words = iter(normalize_all([body for own in found for _, _, body in own])) if any(found) else iter(())
    out = []
    for own in found:
        said = ((start, end, next(words)) for start, end, _ in own)
        out.append([x for x in said if x[2].count(" ") > LEAST_WORDS and len(x[2]) >= LEAST_LETTERS + 2 or len(_WIDE.findall(x[2])) >= LEAST_WIDE])
    return out


def sentences(text: str) -> list[tuple[int, int, str]]:
    return sentences_of([text])[0]


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-gram: their buckets in order, and where those of each text begin (with the end of the last)."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    widths = ends - starts
    wide = codes.astype(np.uint64) + np.uint64(1)
    rolling = np.zeros(len(codes), dtype=np.uint64)
    # the place of the last line feed up to each place: an n-gram that reaches over one is none
    feed = np.zeros(len(codes), dtype=np.int32)
    feed[ends] = 1
    feed = np.cumsum(feed, dtype=np.int32)
    for n in range(1, max(SIZES) + 1):
        if len(codes) < n:
            rolling = rolling[:0]
            yield np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
            continue
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1 :]
        if n not in SIZES:
            continue
        inner = (feed[n - 1 :] == feed[: len(rolling)]) & (codes[: len(rolling)] != 10)
        mixed = rolling[inner] ^ np.uint64(n * 0x9E3779B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets = ((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
        yield buckets, np.concatenate(([0], np.cumsum(np.maximum(widths - n + 1, 0))))


def tally(words: list[str]) -> np.ndarray:
    """How often each bucket occurs in normalized texts."""
    return sum((np.bincount(buckets, minlength=BUCKETS) for buckets, _ in ngrams([w for w in words if w])), np.zeros(BUCKETS, dtype=np.int64))


def counted(lang: str, words: list[str]) -> pd.DataFrame:
    """(lang, bucket, n) of normalized texts in one language."""
    n = tally(words)
    buckets = np.flatnonzero(n)
    return pd.DataFrame({"lang": lang, "bucket": buckets, "n": n[buckets]})


def _count_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, own in batch.groupby("lang"):
            yield counted(lang, normalize_all([_NOISE.sub(" ", t) for t in own.text]))


def matrix(counts: pd.DataFrame) -> Model:
    """The model of counts per language and bucket."""
    langs = sorted(counts.lang.unique())
    if not langs:
        raise ValueError("there are no labelled samples")
    cells = np.zeros((BUCKETS, len(langs)))
    np.add.at(cells, (counts.bucket.to_numpy(), np.searchsorted(langs, counts.lang.to_numpy(str))), counts.n.to_numpy())
    logs = np.log((cells + SMOOTHING) / (cells + SMOOTHING).sum(axis=0))
    logs[cells.sum(axis=1) == 0] = 0  # n-grams in no sample tell nothing
    return langs, logs.astype(np.float32)


def agreeing(langs: list[str], logs: np.ndarray, labels: list[str], texts: list[str]) -> dict[str, list[str]]:
    """Normalized sentences by language, of documents whose label names the language of most of the text."""
    out: dict[str, list[str]] = {}
    known = [(label, text) for label, text in zip(labels, texts) if label in langs]
    spoken = [[w for _, _, w in own] for own in sentences_of([text for _, text in known])]
    every, at = confidence(score([w for said in spoken for w in said], logs)), 0
    for (label, _), said in zip(known, spoken):
        odds, own, at = every[at : at + len(said)], langs.index(label), at + len(said)
        if not said:
            continue
        if np.average(odds.argmax(axis=1) == own, weights=[len(w) for w in said]) > 0.5:
            out.setdefault(label, []).extend(w for w, p in zip(said, odds[:, own]) if p > FOREIGN)
    return out


def fit(samples: DataFrame, documents: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The languages in alphabetical order, and the log-probabilities (BUCKETS x languages)."""
    clean = samples.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = clean.mapInPandas(_count_samples, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    first = matrix(counts)  # at most BUCKETS rows per language, however many samples there are
    model = documents.sparkSession.sparkContext.broadcast(first)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS, len(model.value[0])), dtype=np.int64)
        for batch in batches:
            for lang, words in agreeing(*model.value, batch.named, batch.text).items():
                total[:, model.value[0].index(lang)] += tally(words)
        bucket, column = np.nonzero(total)
        if not len(bucket):
            return
        yield pd.DataFrame({"lang": np.array(model.value[0], dtype=object)[column], "bucket": bucket, "n": total[bucket, column]})

    labelled = documents.select("doc_id", named(F.col("lang")).alias("named"), "text").where("named IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, fit_rows / max(1, documents.where(named(F.col("lang")).isNotNull()).count()))  # reads no texts
    taken = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("named", "text")
    more = spread(taken).mapInPandas(count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return matrix(pd.concat([counts, more]) if len(more) else counts)


def score(words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log-likelihood per text and language."""
    out = np.zeros((len(words), logs.shape[1]))
    step = 1000
    for low in range(0, len(words), step):
        own = out[low : low + step]
        for buckets, starts in ngrams(words[low : low + step]):
            some = np.flatnonzero(np.diff(starts))  # a text without n-grams stays at zero
            if len(some):
                own[some] += np.add.reduceat(np.take(logs, buckets, axis=0), starts[some], axis=0)
    return out


def confidence(scores: np.ndarray) -> np.ndarray:
    """The probability of each language, tempered."""
    shifted = (scores - scores.max(axis=1, keepdims=True)) * TEMPER
    odds = np.exp(shifted)
    return odds / odds.sum(axis=1, keepdims=True)


def segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, label, segment_no, start_char, end_char, lang, confidence, letters) of each sentence.

    Neighbouring sentences of one language are kept apart, so that each has its own confidence.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(samples, documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, logs = model.value
        for batch in batches:
            rows, words = [], []
            for doc_id, label, own in zip(batch.doc_id.astype("Int64"), batch.lang, sentences_of(list(batch.text))):
                for number, (start, end, said) in enumerate(own):
                    rows.append((doc_id, label, number, start, end, len(said)))
                    words.append(said)
            if not rows:
                continue
            odds = confidence(score(words, logs))
            best = odds.argmax(axis=1)
            frame = pd.DataFrame(rows, columns=["doc_id", "label", "segment_no", "start_char", "end_char", "letters"])
            yield frame.astype({"doc_id": "Int64"}).assign(lang=np.array(langs, dtype=object)[best], confidence=odds[np.arange(len(best)), best])

    wanted = documents.select("doc_id", "lang", "text").where("text IS NOT NULL")
    return spread(wanted).mapInPandas(run, "doc_id long, label string, segment_no int, start_char int, end_char int, letters int, lang string, confidence double")


def named(label: Column) -> Column:
    """The language that a label names in a customary spelling, else null."""
    spellings = F.create_map(*[F.lit(x) for lang, names in NAMES.items() for name in names.split() for x in (name, lang)])
    word = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s\-_(,;./]+)", 1)
    return F.try_element_at(spellings, word)


def languages(found: DataFrame, sure: float = SURE) -> DataFrame:
    """(doc_id, label, lang, confidence, share): the languages of each document, from its segments.

    A language counts if a sentence is surely in it; if none is sure, the one with most letters does.
    """
    each = found.groupBy("doc_id", "label", "lang").agg(F.sum("letters").alias("letters"), F.max("confidence").alias("confidence"))
    # at most as many entries as there are languages
    own = each.groupBy("doc_id", "label").agg(F.sum("letters").alias("total"), F.collect_list(F.struct("letters", "confidence", "lang")).alias("own"))
    top = F.array_max("own")["lang"]
    return (
        own.select("doc_id", "label", "total", F.explode(F.filter("own", lambda x: (x["confidence"] >= sure) | (x["lang"] == top))).alias("x"))
        .select("doc_id", "label", "x.lang", "x.confidence", (F.col("x.letters") / F.col("total")).alias("share"))
    )


def coverage(documents: DataFrame, found: DataFrame, sure: float = SURE) -> DataFrame:
    """(state, docs): how many documents have no text, no sentence, one language, or several."""
    own = languages(found, sure).groupBy("doc_id").agg(F.count_distinct("lang").alias("langs"))
    text = documents.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("said"))
    joined = text.join(own, text.doc_id.eqNullSafe(own.doc_id), "left")
    state = F.when(~F.col("said"), "no text").when(F.col("langs").isNull(), "no sentence").when(F.col("langs") == 1, "one language").otherwise("several languages")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("docs"))


def wrong_labels(documents: DataFrame, samples: DataFrame, sure: float = SURE) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing or wrong, or that has several."""
    own = languages(segments(documents, samples), sure)
    cases = own.groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))  # at most as many as there are languages
    wrong = cases.where((F.size("langs") > 1) | F.coalesce(named(F.col("label")) != F.element_at("langs", 1), F.lit(True)))
    return wrong.select("doc_id", F.explode("langs").alias("lang")).distinct()
