"""Best policy chunk for each obligation: keyword share and token-set similarity.

Every distinct text that is looked for meets the chunks of its own policy, block by block, so that neither the rows nor the chunks of a
policy have to fit one task. Keyword shares are counted from one reading of every chunk (``terms``). With the similarity, keyword shares and
lengths of shared tokens are exact and computed for all chunks, the rest of the similarity is bounded by the lengths and, for chunks that may still
win, by counts of characters; the subsequence is computed only for chunks whose bound reaches the best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regloom.functions.rules import keywords
from regloom.joins import GROUP, blocked, lookup_join
from regloom.operators.terms import hits, most_terms, presence, spans
from regloom.session import materialise

KEYWORD_WEIGHT, FUZZY_WEIGHT = 0.68, 0.32
MAX_TERMS, QUERY_CHARS, CHUNK_CHARS = 35, 1000, 1600
_FOUND = pa.schema([("policy", pa.string()), ("h0", pa.int64()), ("h1", pa.int64()), ("score", pa.float64()), ("chunk_seq", pa.int32()), ("keyword_score", pa.float64())])
#: Queries and chunks of a policy that meet in one task.
BLOCK = 512, 4096
NO_MATCH = "No directly matching policy text was identified in the uploaded policy."


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = row & masks.get(c, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of two texts as sets of white-space tokens, 0 to 100; case counts."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    nx, ny = shared + gap + len(only_x), shared + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * _lcs(only_x, only_y)
    best = 100.0 * (1 - apart / (nx + ny)) if nx + ny else 100.0
    if shared:
        for n, only in ((nx, only_x), (ny, only_y)):
            best = max(best, 100.0 * (1 - (gap + len(only)) / (shared + n)))
    return best


def _joined_length(weights: np.ndarray) -> np.ndarray:
    """Length of tokens joined by blanks from the sums of their lengths plus one."""
    return np.maximum(weights - 1, 0)


class _Texts:
    """Token sets of clipped texts with what bounds their similarity: lengths of the joined tokens and counts of characters."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.tokens = [frozenset(t.split()) for t in texts]
        self.length = _joined_length(np.array([sum(len(w) + 1 for w in s) for s in self.tokens], dtype=np.float64))
        self.characters = np.zeros((len(texts), 128), np.int16)
        for row, s in zip(self.characters, self.tokens, strict=True):
            codes = np.frombuffer(" ".join(s).encode("utf-32-le", "surrogatepass"), np.uint32)
            np.add.at(row, codes & 127, 1)  # characters that fall together only loosen the bound


def _incidence(rows: list, index: dict[str, int], weight) -> np.ndarray:
    m = np.zeros((len(rows), len(index)), np.float32)
    for row, words in zip(m, rows, strict=True):
        for w in words:
            if (i := index.get(w)) is not None:
                row[i] += weight(w)
    return m


def _similarity_bounds(queries: _Texts, chunks: _Texts) -> np.ndarray:
    """(queries, chunks) upper bounds of the token-set similarity, 0 to 1.

    The length of the shared tokens is exact, so only the subsequence of the other tokens is estimated: texts whose characters
    differ in number are at least that far apart.
    """
    index = {w: i for i, w in enumerate(sorted({w for s in queries.tokens for w in s}))}
    shared = _joined_length(_incidence(queries.tokens, index, lambda w: len(w) + 1) @ _incidence(chunks.tokens, index, lambda w: 1).T.astype(np.float32))
    nx, ny = queries.length[:, None], chunks.length[None, :]
    apart = np.stack([np.abs(chunks.characters - row).sum(axis=1) for row in queries.characters]) if len(queries.texts) else np.zeros(shared.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = 1 - apart / (nx + ny)
        for n in (nx, ny):
            best = np.where(shared > 0, np.maximum(best, 2 * shared / (shared + n)), best)
    contained = (shared > 0) & ((shared >= nx) | (shared >= ny))
    return np.where((nx == 0) | (ny == 0), 0.0, np.where(contained, 1.0, best))


#: Chunks of a query that are looked at before the rest is bounded by counts of characters.
FIRST_CHUNKS = 16
_SLACK = 1e-9


def _best_chunks(left: pa.Table, right: pa.Table) -> pa.Table:
    """Best chunk of its policy for each query of a group, where the score is positive."""
    asked, held = left.to_pydict(), right.sort_by([("policy", "ascending"), ("chunk_seq", "ascending")]).to_pydict()
    span, seq = spans(held["policy"]), held["chunk_seq"]
    numbers, there = presence(asked["terms"], [t.lower() for t in held["text"]])
    queries, chunks = _Texts([t[:QUERY_CHARS] for t in asked["search"]]), _Texts([t[:CHUNK_CHARS] for t in held["text"]])
    index: dict[str, int] = {}
    tokens = [np.fromiter((index.setdefault(w, len(index)) for w in s), np.int64, len(s)) for s in queries.tokens]
    weights = np.zeros((len(index), len(chunks.texts)), np.uint16)
    for c, s in enumerate(chunks.tokens):
        for w in s:
            if (i := index.get(w)) is not None:
                weights[i, c] = len(w) + 1
    rows = []
    for q, policy in enumerate(asked["policy"]):
        if policy not in span:
            continue
        lo, hi = span[policy]
        keywords = hits(numbers[q], there[:, lo:hi]) / max(len(numbers[q]), 1)
        shared = _joined_length(weights[tokens[q], lo:hi].sum(axis=0, dtype=np.int32))
        best = _best_chunk(queries, q, chunks, lo, keywords, shared)
        if best[0] > 0:
            rows.append((policy, asked["h0"][q], asked["h1"][q], best[0], seq[lo + best[1]], best[2]))
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_FOUND, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)}, schema=_FOUND)


def _best_chunk(queries: _Texts, q: int, chunks: _Texts, lo: int, keywords: np.ndarray, shared: np.ndarray) -> tuple[float, int, float]:
    """(score, position, keyword share) of the best of the chunks from ``lo`` on, the first of equals; position -1 without a positive score."""
    nx, ny = queries.length[q], chunks.length[lo : lo + len(keywords)]
    with np.errstate(divide="ignore", invalid="ignore"):
        by_tokens = np.where(shared > 0, 2 * shared / (shared + np.minimum(nx, ny)), 0.0)  # 1 if one text contains the other
        by_length = np.maximum(1 - np.abs(nx - ny) / (nx + ny), by_tokens)
    filled = (nx > 0) & (ny > 0)
    loose = keywords * KEYWORD_WEIGHT + np.where(filled, by_length, 0.0) * FUZZY_WEIGHT + _SLACK
    best = (0.0, -1, 0.0)

    def judged(some: np.ndarray) -> None:
        """Looks at these chunks by descending bound, until none of the rest can win."""
        nonlocal best
        apart = np.abs(chunks.characters[lo + some] - queries.characters[q]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.maximum(1 - apart / (nx + ny[some]), by_tokens[some])
        bound = keywords[some] * KEYWORD_WEIGHT + np.where(filled[some], bound, 0.0) * FUZZY_WEIGHT + _SLACK
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < best[0]:
                break
            c = int(some[k])
            score = float(keywords[c] * KEYWORD_WEIGHT + token_set_ratio(queries.texts[q], chunks.texts[lo + c]) / 100 * FUZZY_WEIGHT)
            if score > best[0] or (score == best[0] > 0 and c < best[1]):
                best = (score, c, float(keywords[c]))

    first = np.argpartition(-loose, FIRST_CHUNKS)[:FIRST_CHUNKS] if len(loose) > FIRST_CHUNKS else np.arange(len(loose))
    judged(first)
    rest = loose >= best[0]
    rest[first] = False
    judged(np.nonzero(rest)[0])
    return best


@F.pandas_udf(T.DoubleType())
def _token_set_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else token_set_ratio(x, y) / 100 for x, y in zip(a, b, strict=True)])


def similarity(search: Column, text: Column) -> Column:
    """Token-set similarity of two columns, 0 to 1, over the clipped texts."""
    return _token_set_similarity(F.substring(search, 1, QUERY_CHARS), F.substring(text, 1, CHUNK_CHARS))


def keyword_score(search: Column, text: Column) -> Column:
    """Share of the terms of ``search`` that ``text`` contains."""
    terms = F.slice(keywords(search), 1, MAX_TERMS)
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t))) / F.greatest(F.size(terms), F.lit(1))


def _asked(register: DataFrame) -> DataFrame:
    """(policy, h0, h1, search, terms): the distinct texts that are looked for in a policy."""
    search = F.concat_ws(" ", "obligation", "language_from_directive")
    texts = register.filter("policy is not null").select("policy", search.alias("search")).distinct()
    return materialise(texts.select("policy", *_hashes(F.col("search")), "search", F.slice(keywords(F.col("search")), 1, MAX_TERMS).alias("terms")), "asked")


def _hashes(search: Column) -> list[Column]:
    return [F.xxhash64(search).alias("h0"), F.xxhash64(F.lit(1), search).alias("h1")]


def _result(register: DataFrame, best: DataFrame, chunks: DataFrame) -> DataFrame:
    """Register rows with the columns score, keyword_score, match_page and match_text.

    The chosen chunk is looked up by its number first, so that texts travel once a row."""
    best = materialise(best, "best")
    columns = [c for c in register.columns if c not in ("score", "keyword_score", "match_page", "match_text")]
    rows = register.select(*columns, *_hashes(F.concat_ws(" ", "obligation", "language_from_directive")))
    placed = lookup_join(rows, best, ["policy", "h0", "h1"])
    found = placed.join(chunks.select("policy", "chunk_seq", F.col("page").alias("match_page"), F.col("text").alias("match_text")), ["policy", "chunk_seq"], "left")
    return found.select(
        *columns,
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        F.coalesce("match_page", F.lit("Not located")).alias("match_page"),
        F.coalesce("match_text", F.lit(NO_MATCH)).alias("match_text"),
    )


def keyword_match(register: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best chunk by keyword share alone, the earliest of equals."""
    asked, chunks = _asked(register).drop("search"), materialise(chunks, "chunks")
    found = most_terms(asked, chunks.select("policy", F.col("chunk_seq").cast("long").alias("at"), F.lower("text").alias("low")), "policy", ["h0", "h1"])
    top = F.max(F.struct("hits", (-F.col("at")).alias("back"), "terms")).alias("top")
    best = found.groupBy("policy", "h0", "h1").agg(top)
    share = F.col("top.hits") / F.col("top.terms")
    return _result(register, best.select("policy", "h0", "h1", share.alias("score"), (-F.col("top.back")).cast("int").alias("chunk_seq"), share.alias("keyword_score")), chunks)


def hybrid_match(register: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best chunk by 0.68 keyword share + 0.32 token-set similarity; the earliest of equals.

    Adds score, keyword_score, match_page and match_text; without a positive score the default text.
    """
    chunks = materialise(chunks, "chunks")
    left, right = blocked(_asked(register), chunks.select("policy", "chunk_seq", "text"), "policy", ["h0", "h1"], ["chunk_seq"], *BLOCK)
    schema = "policy {0}, h0 long, h1 long, score double, chunk_seq int, keyword_score double".format(dict(register.dtypes)["policy"])
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[dict(register.dtypes)["policy"]]

    def best_chunks(x: pa.Table, y: pa.Table) -> pa.Table:
        return _best_chunks(x, y).cast(_FOUND.set(0, pa.field("policy", kind)))

    found = left.groupBy(GROUP).cogroup(right.groupBy(GROUP)).applyInArrow(best_chunks, schema)
    top = F.max(F.struct("score", (-F.col("chunk_seq")).alias("back"), "keyword_score")).alias("top")
    best = found.groupBy("policy", "h0", "h1").agg(top).select("policy", "h0", "h1", "top.score", (-F.col("top.back")).alias("chunk_seq"), "top.keyword_score")
    return _result(register, best, chunks)
