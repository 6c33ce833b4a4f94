"""Texts that hold most of the terms that are looked for.

A group of blocks holds queries and texts of one key or of several. One automaton of all terms of the group reads every text once; then the
hits of a query are the sum of the rows of its terms over the texts of its key, a byte for each.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regloom.joins import GROUP, blocked

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
#: Queries and texts of a key that meet in one task.
QUERY_ROWS, TEXT_ROWS = 4096, 2048


def presence(terms: Sequence[Sequence[str]], texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(numbers of the terms of each query, terms by texts: 1 where the text contains the term)."""
    index: dict[str, int] = {}
    numbers = [np.fromiter((index.setdefault(t, len(index)) for t in ts), np.int64, len(ts)) for ts in terms]
    there = np.zeros((len(index), len(texts)), np.uint8)
    if index:
        automaton = ahocorasick.Automaton()
        for t, i in index.items():
            automaton.add_word(t, i)
        automaton.make_automaton()
        for c, text in enumerate(texts):
            there[list({i for _, i in automaton.iter(text)}), c] = 1
    return numbers, there


def hits(numbers: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Terms of one query in each text, repeated terms as often as they are looked for."""
    return there[numbers].sum(axis=0, dtype=np.uint8 if len(numbers) < 256 else np.int32)


def spans(keys: Sequence) -> dict:
    """Range of each key in sorted keys."""
    out: dict = {}
    for i, k in enumerate(keys):
        out[k] = (out[k][0] if k in out else i, i + 1)
    return out


def most_terms(asked: DataFrame, texts: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """(``key``, ``ids``, terms, hits, at): in blocks, the text of the same key that contains most terms, of equals the one that comes first.

    ``asked``: ``key``, ``ids``, terms (array); ``texts``: ``key``, at (long), low. Queries without a hit are left out; a query comes out
    once for each block of texts of its key.
    """
    columns = [key, *ids]
    kinds = dict(asked.dtypes)
    schema = pa.schema([*((c, _ARROW[kinds[c]]) for c in columns), ("terms", pa.int32()), ("hits", pa.int32()), ("at", pa.int64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([(key, "ascending"), ("at", "ascending")])
        at, span = right["at"].to_pylist(), spans(right[key].to_pylist())
        numbers, there = presence(left["terms"].to_pylist(), right["low"].to_pylist())
        rows, found = [], []
        for q, k in enumerate(left[key].to_pylist()):
            if k in span and len(numbers[q]):
                lo, hi = span[k]
                n = hits(numbers[q], there[:, lo:hi])
                if n[top := int(n.argmax())]:
                    rows.append(q)
                    found.append((len(numbers[q]), int(n[top]), at[lo + top]))
        kept = left.select(columns).take(pa.array(rows, pa.int64()))
        values = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([*kept.columns, *(pa.array(v, schema.field(n).type) for v, n in zip(values, ("terms", "hits", "at"), strict=True))], names=schema.names).cast(schema)

    left, right = blocked(asked.select(*columns, "terms"), texts.select(key, "at", "low"), key, ids, ["at", "low"], QUERY_ROWS, TEXT_ROWS)
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in columns), "terms int, hits int, at long"])
    return left.groupBy(GROUP).cogroup(right.groupBy(GROUP)).applyInArrow(best, ddl)
