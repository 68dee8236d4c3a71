"""Splitting oversized texts at natural boundaries.

Each position of a text has a boundary strength (blank lines, starts of top-level blocks, line starts, line
ends, ends of statements, white space, none). A sparse table answers in constant time which position of a
window is the strongest; ties go to the right. A piece is cut in the second half of what the limit allows,
or before that if only there a line ends. The next piece starts by stepping back by the overlap: at the
strongest boundary of those last characters, or if there is none, by the whole overlap. If from there no
end of a line would be in reach any more, though it is from the cut itself, the overlap is shortened.

So a text in which no line is longer than the limit is cut at line ends only.

A text is scanned in blocks, so that memory stays flat for very long ones. Rows are independent of each
other; the shuffle that removes repeated rows also spreads them, as a file of the input may hold mostly
long texts.

Defined results: null and empty texts and those up to the limit have one piece at most and are left out;
repeated rows count once; a null start line gives null lines. Pieces never exceed the limit, each but the
first starts at most ``overlap`` characters before the end of the one before it, and together they cover
the text. A cut never falls between a carriage return and its line feed, nor within a line before a
combining mark or joiner, unless a run of such marks fills a whole window. Characters are code points.
Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 800
OVERLAP = 100
BLOCK = 1 << 16

#: Boundary strengths, weakest first.
FORBIDDEN, NONE, SPACE, STATEMENT, LINE_END, LINE, OUTDENT, TOP, BLANK, BLANK_TOP = range(10)
_STOPS = np.array([ord(c) for c in ".;,:!?)]}>。、！？；："], dtype=np.uint32)
_SPACES = np.array([ord(c) for c in " \t\x0b\x0c  　"], dtype=np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def strengths(codes: np.ndarray) -> np.ndarray:
    """The strength of a cut before each position (0 to the length)."""
    n = len(codes)
    out = np.full(n + 1, NONE, dtype=np.int8)
    if not n:
        return out
    before, after = codes[:-1], codes[1:]
    inner = out[1:n]
    space_before = np.isin(before, _SPACES)
    inner[space_before & ~np.isin(after, _SPACES)] = SPACE
    inner[(np.isin(after, _SPACES) | (after > 0x2E7F)) & np.isin(before, _STOPS)] = STATEMENT
    ends = np.flatnonzero(codes == 10) + 1
    if len(ends):
        starts = np.concatenate(([0], ends))
        bounds = np.concatenate((ends, [n]))
        indented = np.isin(codes, _SPACES)
        solid = np.flatnonzero(~indented & (codes != 13))
        # first solid character of each line; a line feed there means that the line is blank
        first = np.searchsorted(solid, starts)
        place = np.where(first < len(solid), solid[np.minimum(first, len(solid) - 1)] if len(solid) else n, n)
        blank = (place >= bounds) | (codes[np.minimum(place, n - 1)] == 10)
        depth = np.where(blank, 0, place - starts)
        # a line is cut before: stronger if it is less indented than the one before it, or follows a blank line
        line = np.full(len(starts), LINE, dtype=np.int8)
        line[1:][depth[1:] < depth[:-1]] = OUTDENT
        line[(depth == 0) & ~blank] = TOP
        closing = np.isin(codes[np.minimum(place, n - 1)], np.array([ord(c) for c in ")]}"], dtype=np.uint32)) & ~blank
        line[closing] = LINE
        after_blank = np.concatenate(([False], blank[:-1]))
        line[after_blank & ~blank] = np.where(depth[after_blank & ~blank] == 0, BLANK_TOP, BLANK)
        out[ends] = line[1:]
        last = ends - 1  # the line feeds, each with the carriage return before it
        last = last - ((last > 0) & (codes[np.maximum(last, 1) - 1] == 13))
        last = last[last > 0]
        out[last] = np.maximum(out[last], LINE_END)
    glued = np.zeros(n + 1, dtype=bool)
    glued[1:n] = (before == 13) & (after == 10)
    for i in np.flatnonzero((after >= 0x300) & (before != 10)):
        c = chr(after[i])
        if unicodedata.combining(c) or 0xFE00 <= after[i] <= 0xFE0F or after[i] == 0x200D or before[i] == 0x200D or 0x1F3FB <= after[i] <= 0x1F3FF:
            glued[i + 1] = True
    out[glued] = FORBIDDEN
    return out


class RangeMax:
    """Sparse table over (strength, position): the rightmost strongest position of any range in constant time."""

    def __init__(self, values: np.ndarray) -> None:
        keys = values.astype(np.int64) * (len(values) + 1) + np.arange(len(values))
        self.size, self.rows, step = len(values) + 1, [keys], 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def best(self, low: int, high: int) -> int:
        """The position in low..high, both included."""
        k = (high - low + 1).bit_length() - 1
        return int(max(self.rows[k][low], self.rows[k][high - (1 << k) + 1]) % self.size)

    def strength(self, at: int) -> int:
        return int(self.rows[0][at] // self.size)

    def first(self, low: int, high: int, least: int) -> int:
        """The first position in low..high of at least a strength; that at high must have it."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.strength(self.best(low, middle)) >= least else (middle + 1, high)
        return low


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, end) of the pieces of the text, in characters."""
    if limit < 2 or not 0 <= overlap < limit // 2:
        raise ValueError("the limit must be more than twice the overlap, and 2 at least")
    codes = _codes(text)
    n = len(codes)
    if n <= limit:
        return [(0, n)] if n else []
    block = max(block, 4 * limit)
    out, start, done, low, high, table = [], 0, 0, 0, -1, None
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        if table is None or start + 2 * limit > high:
            low, high = max(0, start - overlap), min(n, start + block)
            # one character and line more on both sides would only change strengths outside the windows that are asked for
            left = max(0, low - limit)
            values = strengths(codes[left : min(n, high + limit)])[low - left : high - left + 1]
            if high == n:
                values[-1] = LINE_END
            table = RangeMax(values)
        cut = low + _end(table, start - low, max(start, done) - low, limit)
        out.append((start, cut))
        done, start = cut, _step_back(table, low, start, cut, limit, overlap, high)


def _end(table: RangeMax, start: int, done: int, limit: int) -> int:
    """Where the piece that starts at start is cut, after done: in its second half, or before if only there a line ends."""
    cut = table.best(max(start + limit // 2, done + 1), start + limit)
    if table.strength(cut) < LINE_END and done + 1 < start + limit // 2:
        earlier = table.best(done + 1, start + limit)
        if table.strength(earlier) >= LINE_END:
            return earlier
    return cut


def _step_back(table: RangeMax, low: int, start: int, cut: int, limit: int, overlap: int, high: int) -> int:
    """Where the next piece starts."""
    least = max(cut - overlap, start + 1)
    if least >= cut:
        return cut
    back = low + table.best(least - low, cut - 1 - low)
    if table.strength(back - low) <= NONE:
        back = least
    # from the cut itself a line end may be in reach that is not from further back
    far = table.best(cut + 1 - low, min(cut + limit, high) - low)
    if table.strength(far) >= LINE_END and table.strength(table.best(cut + 1 - low, min(back + limit, high) - low)) < LINE_END:
        nearest = low + table.first(cut + 1 - low, far, LINE_END)
        if nearest - limit < cut:
            inner = low + table.best(max(nearest - limit, least) - low, cut - low)
            return inner if table.strength(inner - low) > NONE else max(nearest - limit, least)
        return cut
    return back


def at_line_end(text: str, at: int) -> bool:
    """Whether a cut leaves lines whole: it is at the end of the text, or before or after what ends a line."""
    return at == len(text) or text[at - 1] == "\n" or text[at] == "\n" or text[at : at + 2] == "\r\n"


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, text, first in zip(batch.chunk_id, batch.raw_content, batch.start_line):
                spans = pieces(text, limit, overlap)
                kind = "line" if all(at_line_end(text, end) for _, end in spans) else "inside"
                at = line = 0
                for number, (start, end) in enumerate(spans):
                    line += text.count("\n", at, start)
                    at = start
                    piece = text[start:end]
                    top = None if pd.isna(first) else int(first) + line
                    rows.append((chunk_id, number, start, end, top, None if top is None else top + piece[:-1].count("\n"), piece, kind))
            if rows:
                yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start_char", "end_char", "start_line", "end_line", "piece", "cut"]).astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece_no, start_char, end_char, start_line, end_line, piece, cut) of each chunk over the limit.

    cut is ``line`` if all cuts of the chunk are at line ends, else ``inside``.
    """
    large = (
        chunks.select("chunk_id", "raw_content", "start_line")
        .where(F.length("raw_content") > limit)
        .dropDuplicates(["chunk_id", "raw_content", "start_line"])
    )
    schema = "chunk_id string, piece_no int, start_char int, end_char int, start_line int, end_line int, piece string, cut string"
    return large.mapInPandas(_cut(limit, overlap), schema)
