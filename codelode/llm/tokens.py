"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Short texts are encoded where they are, batch by batch. A long text is cut into pieces that are spread
over the cluster and encoded in parallel. The pieces are rows, and are joined in a tree, level by level:
each level joins ``FAN_IN`` neighbours, two at a time, into one row, until a text is one row. At each join
a window around it is encoded anew and grows until it agrees with both sides, so the result is exactly
that of encoding the text in one go:

* Words. The pattern that cuts a text into words looks only forward, so two scans that both begin a word
  at the same place agree from there on. A window starts at a word of the left side and ends as soon as it
  begins a word where the right side does.
* Tokens. A word that itself crosses the join (a long run without a break) is joined by tokens. A sequence
  of tokens is the encoding of a word exactly if each pair of neighbours is, so it is enough that the window
  has a token in common with the left side and one with the right side.

Defined results: null and empty texts have no ids (an empty list), each row of the input gives one row,
also repeated rows and rows without an id. Special tokens are never produced: their strings are ordinary
text. Lone surrogates are encoded as U+FFFD. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.session import spread

#: Where the vocabulary files are, and which of them is used, unless the caller says otherwise.
TOKENIZERS = os.environ.get("CODELODE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published pattern that cuts a text into words for this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Characters from which a text is cut into pieces, and the size of the pieces.
LONG = 1 << 14
PIECE = 1 << 13
#: Neighbouring rows of a text that one task joins at a level.
FAN_IN = 32

#: Words of a part of a text: where the part starts, where each word ends, how many tokens each has, and all tokens.
Part = tuple[int, np.ndarray, np.ndarray, np.ndarray]

_WORDS = regex.compile(PATTERN)
_loaded: dict[str, tiktoken.Encoding] = {}
_lock = threading.Lock()


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file, read once per process."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    with _lock:
        if path not in _loaded:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _loaded[path]


def _clean(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encode(text: str | None, path: str | None = None) -> list[int]:
    """The ids of a text, in one go."""
    return encoder(path).encode_ordinary(_clean(text)) if text else []


def words(text: str, offset: int, own: tiktoken.Encoding) -> Part:
    """The words of a piece of text that starts at offset, each with its ids."""
    found = [(offset + m.end(), own._encode_single_piece(m.group().encode())) for m in _WORDS.finditer(text)]
    return _part(offset, found)


def _part(start: int, found: list[tuple[int, list[int]]]) -> Part:
    return start, np.array([end for end, _ in found], dtype=np.int64), np.array([len(ids) for _, ids in found], dtype=np.int64), np.array([t for _, ids in found for t in ids], dtype=np.int64)


def _join_tokens(left: list[int], right: list[int], own: tiktoken.Encoding) -> list[int]:
    """The encoding of one word from those of its two parts."""
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        window = own._encode_single_piece(own.decode_bytes(a) + own.decode_bytes(b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        common_left = 0 if not whole_left and (window[:1] != a[:1]) else 1
        common_right = 0 if not whole_right and (window[-1:] != b[-1:]) else 1
        if common_left and common_right and (len(window) > 1 or whole_left and whole_right):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        width *= 2


def join(text: str, offset: int, left: Part, right: Part, own: tiktoken.Encoding) -> Part:
    """The words of two neighbouring parts; text holds both and starts at offset."""
    if not len(left[1]) or not len(right[1]):
        return left if len(left[1]) else right
    starts = np.concatenate(([right[0]], right[1][:-1]))  # where the words of the right side begin
    middle, stop = right[0], int(right[1][-1])
    # The last word may go on, and the one before it may have ended only because the piece did.
    keep = max(0, len(left[1]) - 2)
    kept = int(left[2][:keep].sum())
    at = int(left[1][keep - 1]) if keep else left[0]
    last = int(left[1][-2]) if len(left[1]) > 1 else left[0]
    tail, index = [], len(starts)
    for m in _WORDS.finditer(text, at - offset, stop - offset):
        low, high = m.start() + offset, m.end() + offset
        if low >= middle:
            place = int(np.searchsorted(starts, low))
            if place < len(starts) and starts[place] == low:
                index = place
                break
        if low == last and low < middle < high and high == right[1][0]:
            ids = _join_tokens(left[3][len(left[3]) - int(left[2][-1]) :].tolist(), right[3][: int(right[2][0])].tolist(), own)
        else:
            ids = own._encode_single_piece(m.group().encode())
        tail.append((high, ids))
    new, skipped = _part(at, tail), int(right[2][:index].sum())
    return left[0], np.concatenate((left[1][:keep], new[1], right[1][index:])), np.concatenate((left[2][:keep], new[2], right[2][index:])), np.concatenate((left[3][:kept], new[3], right[3][skipped:]))


def tree(text: str, offset: int, parts: list[Part], own: tiktoken.Encoding) -> Part:
    """The words of a stretch of text, which starts at offset, from those of its parts, joined two at a time."""
    while len(parts) > 1:
        parts = [join(text, offset, *parts[i : i + 2], own) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _whole(path: str | None):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([encode(t, path) for t in batch], dtype=object)

    return F.pandas_udf(run, "array<int>")


def _cuts(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch.key, batch.text):
                # some pieces at a time, so that a batch of very long texts is never held twice
                for low in range(0, len(text), 64 * size):
                    starts = range(low, min(low + 64 * size, len(text)), size)
                    yield pd.DataFrame({"key": key, "no": [at // size for at in starts], "start": list(starts), "text": [text[at : at + size] for at in starts]})

    return run


_PARTS = "key string, no int, start long, text string, ends array<long>, sizes array<long>, tokens array<long>"


def _parts(path: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for batch in batches:
            found = [words(t, at, own) for t, at in zip(batch.text, batch.start)]
            yield batch.assign(ends=[p[1] for p in found], sizes=[p[2] for p in found], tokens=[p[3] for p in found])

    return run


def _level(path: str | None):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        start, text = int(group.start.iloc[0]), "".join(group.text)
        parts = [(int(at), *map(np.asarray, rest)) for at, *rest in zip(group.start, group.ends, group.sizes, group.tokens)]
        _, ends, sizes, tokens = tree(text, start, parts, encoder(path))
        return pd.DataFrame({"key": [group.key.iloc[0]], "no": [int(group.no.iloc[0]) // FAN_IN], "start": [start], "text": [text], "ends": [ends], "sizes": [sizes], "tokens": [tokens]})

    return run


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(id, ids): one row per document, with the ids of its text."""
    rows = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    size = F.coalesce(F.length("__text"), F.lit(0))
    short = spread(rows.where(size < long)).select("__id", _whole(path)("__text").alias("ids"))
    # One group per long text: its ids are one row of the result in any case. Equal texts are encoded once.
    large = rows.where(size >= long).withColumn("key", F.sha2("__text", 256))
    texts = large.groupBy("key").agg(F.first("__text").alias("__text"))
    most = rows.agg(F.max(F.length("__text")).alias("n")).first()["n"] or 0
    cuts = texts.select("key", F.col("__text").alias("text")).mapInPandas(_cuts(piece), "key string, no int, start long, text string")
    # with a number, as partitions that are small in bytes would be put together, though each is seconds of work
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_left, joined = -(-most // piece), cuts.repartition(tasks, "key", "no").mapInPandas(_parts(path), _PARTS)
    while rows_left > 1:
        joined = joined.groupBy("key", F.floor(F.col("no") / FAN_IN).alias("__group")).applyInPandas(_level(path), _PARTS)
        rows_left = -(-rows_left // FAN_IN)
    joined = joined.select("key", F.col("tokens").cast("array<int>").alias("ids"))
    return short.unionByName(large.select("__id", "key").join(joined, "key").select("__id", "ids")).select(F.col("__id").alias(id_column), "ids")
