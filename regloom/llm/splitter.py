"""Splitting oversized items at natural boundaries.

Every boundary of a text (paragraph, sentence, line, clause, word) has a position and a strength. A sparse
table over the strengths answers "where is the strongest boundary in this window, the rightmost of
equals" in constant time. Sentences end where the operator for sentence boundaries says. A piece may be ``min_chars`` to ``max_chars`` long; it ends at the strongest boundary of that window,
and the next piece starts at the strongest boundary around ``overlap`` characters before that end.
Where a window holds no boundary, the piece ends at the last boundary before it that is new text, and the next one starts at the nearest boundary further back. Only where
there is none either does the cut fall at the far end, but never inside a character cluster.

Defined results: pieces are slices of the stored text in order, the first starts at 0, the last ends at the
text's length and each starts before the end of its predecessor (at ``overlap`` > 0); a text within the limit
is one piece; an empty text is one empty piece; null gives none. Lengths are code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.llm.sentences import sentence_ends

MAX_CHARS = 1800
OVERLAP = 200

# Strength by kind of boundary; a cut lies after the match. A full stop after a long word that ends no sentence counts as a clause.
PARAGRAPH, SENTENCE, LINE, CLAUSE, WORD = 5, 4, 3, 2, 1
_BOUNDARY = re.compile(
    r"(?P<p>\n[^\S\n]*\n\s*)"
    r"|(?P<l>[^\S\n]*\n)"
    r"|(?P<t>(?<=\w{4})[.!?؟।॥…][\"'”’»“)\]]*(?=\s)[^\S\n]*)"
    r"|(?P<c>[;:,،؛](?=\s)[^\S\n]*|[；：，、])"
    r"|(?P<w>[^\S\n]+)"
)
_AFTER = re.compile(r"[^\S\n]*\n?")
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "t": CLAUSE, "c": CLAUSE, "w": WORD}


class SparseTable:
    """Range-maximum over ``values`` for ranges of up to ``longest``; the rightmost of equal maxima."""

    def __init__(self, values: np.ndarray, longest: int | None = None) -> None:
        longest = len(values) if longest is None else min(longest, len(values))
        self.values = values
        level = np.arange(len(values))
        self.levels = [level]
        width = 1
        while 2 * width <= longest:
            left, right = level[:-width], level[width:]
            level = np.where(values[right] >= values[left], right, left)
            self.levels.append(level)
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Index of the maximum of values[lo:hi], hi > lo."""
        k = (hi - lo).bit_length() - 1
        a, b = self.levels[k][lo], self.levels[k][hi - (1 << k)]
        return int(b if self.values[b] >= self.values[a] else a)


def boundaries(text: str) -> tuple[list[int], np.ndarray]:
    """Positions (ascending) and strengths of the cuts inside ``text``."""
    found = {m.end(): _STRENGTH[m.lastgroup] for m in _BOUNDARY.finditer(text)}
    for e in sentence_ends(text):
        at = _AFTER.match(text, e).end()
        found[at] = max(found.get(at, 0), SENTENCE)
    at = sorted(k for k in found if 0 < k < len(text))
    return at, np.array([found[k] for k in at], dtype=np.int8)


def _safe(text: str, at: int, floor: int) -> int:
    """The last position in (floor, at] that is not inside a character cluster; ``at`` if there is none."""
    i = at
    while i > floor + 1 and i < len(text):
        c, before = text[i], text[i - 1]
        if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️" or before == "‍" or (before == "\r" and c == "\n"):
            i -= 1
        else:
            return i
    return at


def pieces(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``."""
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    least = max_chars // 2 if min_chars is None else min_chars
    if not 0 <= overlap + overlap // 2 < least <= max_chars:
        raise ValueError("needs 1.5 * overlap < min_chars <= max_chars")
    at, strength = boundaries(text)
    table = SparseTable(strength, max_chars)

    def strongest(lo: int, hi: int) -> int | None:
        i, j = bisect_left(at, lo), bisect_right(at, hi)
        return at[table.argmax(i, j)] if j > i else None

    def last(lo: int, hi: int) -> int | None:
        """The last boundary in lo..hi."""
        i, j = bisect_left(at, lo), bisect_right(at, hi)
        return at[j - 1] if j > i else None

    out, start, end = [], 0, 0
    while n - start > max_chars:
        cut = strongest(start + least, start + max_chars)
        if cut is None:
            cut = last(end + 1, start + least - 1)
        if cut is None:
            cut = _safe(text, start + max_chars, start + least)
        out.append((start, cut))
        begun, start, end = start, cut, cut
        if overlap:
            half = overlap // 2
            back = strongest(max(end - overlap - half, begun + 1), end - overlap + half)
            if back is None:
                back = last(max(end - least, begun) + 1, end - overlap - half)
            start = max(_safe(text, end - overlap, end - overlap - half), begun + 1) if back is None else back
    out.append((start, n))
    return out


def split_oversized(items: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every item: (item_table, item_id, piece_no, n_pieces, start, end, piece).

    Items within the limit never leave the JVM; only the longer ones go through Arrow batches. Nothing is shuffled.
    """
    items = items.select("item_table", "item_id", "text")
    schema = "item_table string, item_id long, piece_no int, n_pieces int, start int, end int, piece string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_table", "item_id", "piece_no", "n_pieces", "start", "end", "piece"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for table, item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = pieces(text, max_chars, overlap)
                for k, (s, e) in enumerate(spans):
                    for col, v in zip(cols, (table, item, k, len(spans), s, e, text[s:e]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    size = F.length("text")
    whole = items.filter(size <= max_chars).select(
        "item_table", F.col("item_id").cast("long"), F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), size.alias("end"), F.col("text").alias("piece")
    )
    return items.filter(size > max_chars).mapInArrow(cut, schema).unionByName(whole)
