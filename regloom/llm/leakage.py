"""Evaluation texts leaking into training text: size-partitioned MinHash containment search.

A test item may leak in part, and a document is much longer than what it took over, so the Jaccard similarity of whole
sets says nothing. Sets are therefore partitioned by size until containment and similarity coincide: both sides
are cut into all passages of the query's size (``RUN`` words). For sets of equal size containment 1 means Jaccard 1, and
equal sets have equal MinHash values, so one key of ``ROWS`` MinHash values over the passage's shingles finds every leaked passage:
the recall of the search is 1 by construction. Neighbouring passages mostly share their minima, so a text of
n words has far fewer keys than passages. Texts shorter than one passage hold none and drop out at once.

A document passage that shares a key with an item passage is a candidate; it is verified by the exact RUN-word shingle, joined as a
hash of 64 bits by itself, never with the text it comes from. Items of up to ``SHARED_PASSAGES`` passages hand their keys to all tasks, so that
documents emit candidates only; beyond that, documents emit all passages and the join finds the candidates. The passages of one document
and one item give the share of the item's shingles that the document contains and the longest run.

Words are runs of letters and digits after folding case, look-alike and compatibility forms; punctuation and the kind of white space
do not count. Defined results: null, empty and short texts leak nothing; a passage that occurs in
several items is reported for each; repeated documents are reported one by one, a document id that occurs twice once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.llm.lookalikes import plain_rewriter
from regloom.session import materialise, prepare

#: Words in a row that make a leak; words of a shingle; MinHash values of a key.
RUN, SHINGLE, ROWS = 12, 5, 2
#: Passages of all items up to which their keys are shared with all tasks, 8 bytes each.
SHARED_PASSAGES = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def words(text: str) -> list[str]:
    t = plain_rewriter()(text)
    if not t.isascii():
        t = plain_rewriter()(unicodedata.normalize("NFKC", t))
    return _WORD.findall(t.casefold())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + k])
    return out


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``: from windows of doubling width, two of which cover it."""
    low, size = v, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    rest = width - size
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def passages(texts: list[str], run: int = RUN, shingle: int = SHINGLE, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """(text, position, MinHash key, hash of the words) of all passages of ``run`` words of ``texts``."""
    lists = [words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(lengths.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(lists))
    if len(flat) < run:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    codes, uniques = pd.factorize(flat)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in uniques), np.uint64, len(uniques))[codes]
    shingles = _rolled(h, shingle)
    width = run - shingle + 1
    key = np.zeros(len(h) - run + 1, np.uint64)
    for r in range(rows):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + _window_minima(_mixed(shingles * _SEEDS[r]), width))
    text = np.repeat(np.arange(len(lists)), lengths)
    inside = np.nonzero(text[: len(key)] == text[run - 1 :])[0]  # a passage lies within one text
    start = np.concatenate([[0], np.cumsum(lengths)])
    return text[inside], inside - start[text[inside]], key[inside].view(np.int64), _rolled(h, run)[inside].view(np.int64)


def _passage_rows(items: DataFrame, id_column: str, keys: np.ndarray | None = None) -> DataFrame:
    """(id, at, key, gram): one row per passage of each text; with ``keys`` (sorted) only those of a key among them."""
    names = [id_column, "at", "key", "gram"]
    shared = None if keys is None else items.sparkSession.sparkContext.broadcast(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, at, key, gram = passages(b.column(1).to_pylist())
            if shared is not None:
                known = shared.value
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[place] == key
                text, at, key, gram = text[hit], at[hit], key[hit], gram[hit]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(key), pa.array(gram)], names=names)

    rows = items.select(F.col(id_column).cast("long").alias(id_column), "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(cut, f"{id_column} long, at int, key long, gram long")


def leaked_passages(documents: DataFrame, test_items: DataFrame) -> DataFrame:
    """(doc_id, item_no, shared, containment, longest_run) of documents that hold ``RUN`` or more words of an item in a row."""
    prepare(documents.sparkSession)
    held = materialise(_passage_rows(test_items, "item_no"), "item-passages")
    size = held.count()
    keys = None
    if 0 < size <= SHARED_PASSAGES:
        keys = np.unique(held.select("key").toPandas()["key"].to_numpy(np.int64))
    found = _passage_rows(documents, "doc_id", keys).select("doc_id", "key", "gram")
    known = held.select("item_no", "at", "key", "gram")
    hits = lookup_join(found, known, ["key", "gram"], "inner").select("doc_id", "item_no", "at").distinct()
    order = Window.partitionBy("doc_id", "item_no").orderBy("at")  # at most the passages of one item
    runs = hits.withColumn("island", F.col("at") - F.row_number().over(order)).groupBy("doc_id", "item_no", "island").agg(F.count("*").alias("n"))
    leaks = runs.groupBy("doc_id", "item_no").agg(F.sum("n").alias("shared"), (F.max("n") + (RUN - 1)).alias("longest_run"))
    whole = held.groupBy("item_no").agg(F.count_distinct("at").alias("passages"))
    return leaks.join(whole, "item_no").select("doc_id", "item_no", "shared", (F.col("shared") / F.col("passages")).alias("containment"), "longest_run")
