"""Near-duplicate records with small edits: a MinHash LSH forest with exact verification.

A text is the multiset of its words (runs of letters and digits, lower case, look-alike forms folded); element
``(word, k)`` stands for its k-th occurrence, so the Jaccard similarity J of the element sets and the word overlap
dice = 2c/(a+b) obey dice = 2J/(1+J). Equal multisets collapse into classes first; everything below works on one
representative per class, so groups of copies cost nothing.

Forest: every class has ``FUNCTIONS`` MinHash bytes. A tree orders ``DEPTH`` of them; the eight bytes in that order are one
64-bit path of its trie, so sorting the paths of a tree sorts its trie, and a shorter prefix is a mask over the low bytes.
The paths are exchanged once a round, packed, by tree and first two bytes; every task sorts its part and pairs the classes under
the same node. Matching starts at the whole path. From the verified pairs the
recall is estimated (each found pair of similarity s stands for 1/P(found | s) pairs, Horvitz-Thompson; P is simulated for the
very trees, as they share their functions). While the estimate is below ``target_recall``, for pairs of classes or for pairs of rows, the prefix
is shortened to the longest one that promises it and only pairs that first meet there are emitted. A target that no prefix reaches is an error.

Candidates pass an exact bound first (a parity bitmap of 128 bits bounds the symmetric difference from below, the word
counts bound the overlap from above), then the share of equal MinHash bytes (five standard deviations below what a pair at the
limit has, which loses fewer than one pair in a million), then the exact bound again with a bitmap as long as the text asks for; then the multisets
themselves are intersected. A trie node with more than
``NODE_PAIRS`` classes is not paired inside its task: its members are joined in blocks under the same bounds, so no
candidate is dropped. A class with many copies is split into blocks wherever its rows are joined.

Defined results: null texts and texts without words belong to no pair; equal texts pair with each other; the length of
a text is not limited; rows of different tables never pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.llm.lookalikes import plain_rewriter
from regloom.session import discard, materialise, prepare

FUNCTIONS, TREES, DEPTH, MIN_DEPTH = 128, 48, 8, 1
SIMILARITY, TARGET_RECALL = 0.80, 0.9995
#: Simulated pairs a depth.
SAMPLES = 100_000
#: Classes of one trie node that are paired inside its task.
NODE_PAIRS = 128
#: Paths one reducer sorts at a time.
KEYS_PER_PART = 2_000_000
#: Elements of texts of similar length that are hashed together.
HASHED_AT_ONCE = 1 << 15
#: Rows of one group that are joined as one block.
BLOCK_ROWS = 4096

_WORD = re.compile(r"[^\W_]+")
_G = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(plain_rewriter()(text).lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _plan() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks and multipliers of the hash functions and, by tree, the order of functions along a path.

    The trees deal out one shuffled pack of all functions after the other, so that two trees share as few as possible.
    """
    rng = np.random.default_rng(20240521)
    masks = rng.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)
    factors = rng.integers(0, 2**31, FUNCTIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    packs = [rng.permutation(FUNCTIONS) for _ in range(-(-TREES * DEPTH // FUNCTIONS))]
    return masks, factors, np.concatenate(packs)[: TREES * DEPTH].reshape(TREES, DEPTH)


def element_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all texts as 64-bit hashes, sorted within a text; offsets of the texts)."""
    lists = [words(t) for t in texts]
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(int(offsets[-1]), dtype=object)
    flat[:] = list(chain.from_iterable(lists))
    codes, uniques = pd.factorize(flat)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(u) for u in uniques), np.uint64, len(uniques))
    token = hashes[codes] if len(codes) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(lists)), lengths)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    index = np.arange(len(token))
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    occurrence = (index - np.maximum.accumulate(np.where(fresh, index, 0))).astype(np.uint64)
    return _mix(token + occurrence * _G), offsets


def signatures(texts: list[str]) -> dict[str, np.ndarray]:
    """Per text: word count, two halves of the multiset hash, MinHash bytes, two halves of the parity bitmap."""
    elements, offsets = element_arrays(texts)
    n = np.diff(offsets)
    some = np.nonzero(n)[0]
    starts = offsets[:-1][some]
    out = {
        "n": n,
        "h0": np.zeros(len(n), np.uint64),
        "h1": np.zeros(len(n), np.uint64),
        "sig": np.zeros((len(n), FUNCTIONS), np.uint8),
        "b0": np.zeros(len(n), np.uint64),
        "b1": np.zeros(len(n), np.uint64),
    }
    if not len(some):
        return out
    with np.errstate(over="ignore"):
        out["h0"][some] = np.add.reduceat(_mix(elements ^ _G), starts)
        out["h1"][some] = np.add.reduceat(_mix(elements + _G), starts)
        out["sig"][some] = _min_hashes((elements >> np.uint64(32)).astype(np.uint32), starts, n[some])
    bit = np.uint64(1) << (elements & np.uint64(63))
    upper = ((elements >> np.uint64(6)) & np.uint64(1)).astype(bool)
    out["b0"][some] = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), starts)
    out["b1"][some] = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), starts)
    return out


def _min_hashes(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, FUNCTIONS) bytes of the smallest hashes of each text's elements values[start : start + n].

    Texts of similar length lie side by side in a matrix, short ones padded with an element they have.
    """
    masks, factors, _ = _plan()
    out = np.empty((len(n), FUNCTIONS), np.uint8)
    order = np.argsort(n, kind="stable")
    lengths = n[order]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and lengths[end] * (end + 1 - at) <= HASHED_AT_ONCE and lengths[end] <= 1.3 * lengths[at] + 4:
            end += 1
        rows = order[at:end]
        longest = int(lengths[end - 1])
        block = values[starts[rows][None, :] + np.minimum(np.arange(longest)[:, None], n[rows][None, :] - 1)]
        hashed, low = np.empty_like(block), np.empty((FUNCTIONS, len(rows)), np.uint32)
        for f in range(FUNCTIONS):
            np.bitwise_xor(block, masks[f], out=hashed)
            np.multiply(hashed, factors[f], out=hashed)
            np.minimum.reduce(hashed, axis=0, out=low[f])
        out[rows] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(24)).T
        at = end
    return out


def _features(items: DataFrame) -> DataFrame:
    schema = "item_table string, item_id long, h0 long, h1 long, n int, sig binary, b0 long, b1 long"
    names = ["item_table", "item_id", "h0", "h1", "n", "sig", "b0", "b1"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = signatures(b.column(2).to_pylist())
            keep = pa.array(np.nonzero(s["n"])[0])
            long = lambda k: pa.array(s[k].view(np.int64))
            sig = pa.array([r.tobytes() for r in s["sig"]], pa.binary())
            cols = [b.column(0), b.column(1), long("h0"), long("h1"), pa.array(s["n"].astype(np.int32)), sig, long("b0"), long("b1")]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in cols], names=names)

    rows = items.select("item_table", F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    return rows.mapInArrow(compute, schema)


def _paths(sig: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """(rows, TREES) paths, the first function of a tree in the highest byte; tables are told apart by their salt."""
    along = sig[:, _plan()[2]].astype(np.uint64)  # rows, TREES, DEPTH
    path = np.zeros(along.shape[:2], np.uint64)
    for d in range(DEPTH):
        path |= along[:, :, d] << np.uint64(8 * (7 - d))
    return path ^ salt[:, None]


def _mask(depth: int) -> np.uint64:
    """The bits of a path that a prefix of ``depth`` bytes compares."""
    return np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 - depth))) & 0xFFFFFFFFFFFFFFFF)


def _candidates(classes: DataFrame, depth: int, parts: int, above: int | None = None) -> DataFrame:
    """(a, b, node): pairs a < b of classes under one node of ``depth``; rows with ``node`` are members of large nodes.

    Pairs under one node of the deeper level ``above``, which earlier rounds have met, are left out.
    """
    shared = min(depth, 2)  # bytes of a path that decide its part

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cid = b.column(0).to_numpy(zero_copy_only=False)
            salt = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, FUNCTIONS)
            path = _paths(sig, salt)
            with np.errstate(over="ignore"):
                place = _mix((path & _mask(shared)) + np.arange(1, TREES + 1, dtype=np.uint64)[None, :] * _G)
            part = place % np.uint64(parts)
            base = cid >> 16
            for group in np.unique(base):  # offsets from a common base need two bytes
                rows = np.nonzero(base == group)[0]
                k, p = path[rows].ravel(), part[rows].ravel()
                tree = np.tile(np.arange(TREES, dtype=np.uint8), len(rows))
                off = np.repeat((cid[rows] & 0xFFFF).astype(np.uint16), TREES)
                order = np.lexsort((tree, p))
                k, p, off, tree = k[order], p[order], off[order], tree[order]
                cuts = np.nonzero(np.diff(p))[0] + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(p[np.concatenate([[0], cuts])].astype(np.int32)),
                        pa.array(np.full(len(cuts) + 1, group, np.int64)),
                        *[pa.array([x.tobytes() for x in np.split(column, cuts)], pa.binary()) for column in (k, off, tree)],
                    ],
                    names=["part", "base", "paths", "offsets", "trees"],
                )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            for p, base, k, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by_part.setdefault(p, []).append((np.frombuffer(k, np.uint64), (base << 16) + np.frombuffer(o, np.uint16).astype(np.int64), np.frombuffer(t, np.uint8)))
        for p in list(by_part):
            path, c, tree = (np.concatenate(x) for x in zip(*by_part.pop(p), strict=True))
            order = np.lexsort((c, path, tree))
            path, c, tree = path[order], c[order], tree[order]
            node = path & _mask(depth)
            edges = np.concatenate([[0], np.nonzero((np.diff(node) != 0) | (np.diff(tree) != 0))[0] + 1, [len(node)]])
            size = np.diff(edges)
            left, right = [], []
            for n in np.unique(size[(size > 1) & (size <= NODE_PAIRS)]):
                at = edges[:-1][size == n]
                i, j = np.triu_indices(int(n), 1)
                x, y = (at[:, None] + i[None, :]).ravel(), (at[:, None] + j[None, :]).ravel()
                if above is not None:
                    fresh = (path[x] ^ path[y]) & _mask(above) != 0
                    x, y = x[fresh], y[fresh]
                left.append(np.minimum(c[x], c[y]))
                right.append(np.maximum(c[x], c[y]))
            if left:
                both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["a", "b", "node"])
            for x in np.nonzero(size > NODE_PAIRS)[0]:
                members = c[edges[x] : edges[x + 1]]
                name = xxhash.xxh3_64_intdigest(node[edges[x]].tobytes() + tree[edges[x]].tobytes()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64()), pa.array(np.full(len(members), name, np.int64))], names=["a", "b", "node"])

    packed = classes.select("cid", "item_table", "sig").mapInArrow(paths, "part int, base long, paths binary, offsets binary, trees binary")
    return packed.repartitionById(parts, "part").mapInArrow(pair, "a long, b long, node long")


def _bounded(a: str, b: str, similarity: float) -> F.Column:
    """Exact necessary condition on two classes with columns n, b0, b1: word counts and parity bitmaps."""
    col = lambda side, k: F.col(f"{side}_{k}")
    total = col(a, "n") + col(b, "n")
    apart = F.bit_count(col(a, "b0").bitwiseXOR(col(b, "b0"))) + F.bit_count(col(a, "b1").bitwiseXOR(col(b, "b1")))
    same = col(a, "item_table") == col(b, "item_table")
    return same & (2 * F.least(col(a, "n"), col(b, "n")) >= similarity * total - 1e-9) & (apart <= (1 - similarity) * total + 1e-9)


def _sketch(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("cid").alias(side), *[F.col(k).alias(f"{side}_{k}") for k in ("item_table", "n", "b0", "b1")])


def _block_join(rows: DataFrame, key: list[str], payload: list[str], condition, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Self-join on ``key``; a key with many rows is split into blocks of its left side.

    ``condition`` gets the aliases "x" and "y"; every unordered pair is met once in each order.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__rows")).filter("__rows > 1")
    sized = rows.select(*key, *payload).join(sizes, key).withColumn("__blocks", F.ceil(F.col("__rows") / block_rows).cast("int")).drop("__rows")
    x = sized.withColumn("__block", F.pmod(F.xxhash64(*payload), F.col("__blocks")).cast("int")).alias("x")
    y = sized.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).alias("y")
    return x.join(y, [*[F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*key, "__block"]], condition])


def _plausible(found: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidate pairs that pass the exact bounds."""
    pairs = found.filter("node is null").select("a", "b").distinct()
    direct = pairs.join(_sketch(classes, "a"), "a").join(_sketch(classes, "b"), "b").filter(_bounded("a", "b", similarity)).select("a", "b")
    members = found.filter("node is not null").select("node", F.col("a").alias("cid")).join(classes.select("cid", "item_table", "n", "b0", "b1"), "cid")
    total = F.col("x.n") + F.col("y.n")
    apart = F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))) + F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1")))
    close = (
        (F.col("x.cid") < F.col("y.cid"))
        & (F.col("x.item_table") == F.col("y.item_table"))
        & (2 * F.least(F.col("x.n"), F.col("y.n")) >= similarity * total - 1e-9)
        & (apart <= (1 - similarity) * total + 1e-9)
    )
    blocked = _block_join(members, ["node"], ["cid", "item_table", "n", "b0", "b1"], close).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    return direct.unionByName(blocked).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose MinHash bytes agree often enough for a pair at the limit, less five standard deviations."""
    p = similarity / (2 - similarity)
    p += (1 - p) / 256
    least = FUNCTIONS * p - 5 * math.sqrt(FUNCTIONS * p * (1 - p))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, FUNCTIONS) for i in (2, 3))
            keep = pa.array(np.nonzero((x == y).sum(axis=1) >= least)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ends")
    sigs = materialise(lookup_join(classes.select("cid", "sig"), ends, ["cid"], "inner", salts=1), "sigs")
    both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    alike = materialise(both.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long"), "alike")
    discard(ends)
    discard(sigs)
    return alike


def parity(elements: np.ndarray) -> bytes:
    """Parity of the elements by their low bits, four to eight bits an element: a bitmap whose length is a power of two."""
    bits = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """At most the number of elements that only one of the two sets has; the longer bitmap is folded to the other's length."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) < len(v):
        u, v = v, u
    return int(np.bitwise_count(np.bitwise_xor.reduce(u.reshape(-1, len(v)), axis=0) ^ v).sum())


def _close(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose parities leave an overlap of ``similarity`` possible: an exact bound that costs a tenth of the multisets."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy(zero_copy_only=False)
            apart = np.fromiter((parity_distance(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)), np.int64, b.num_rows)
            keep = pa.array(np.nonzero(apart <= (1 - similarity) * total + 1e-9)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    side = lambda s: sets.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", (F.col("na") + F.col("nb")).cast("long"), "pa", "pb").mapInArrow(bound, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(a, b, dice): pairs whose multisets overlap enough."""
    ends = materialise(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "ends")
    wanted = materialise(lookup_join(classes.select("cid", "item_table", F.col("rep").alias("item_id")), ends, ["cid"], "inner", salts=1), "wanted")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = element_arrays(b.column(1).to_pylist())
            out = [np.sort(flat[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)]
            columns = [pa.array([len(x) for x in out], pa.int32()), pa.array([parity(x) for x in out], pa.binary()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["cid", "n", "parity", "elements"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dice = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                dice.append(2 * len(np.intersect1d(u, v, assume_unique=True)) / (len(u) + len(v)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dice, pa.float64())], names=["a", "b", "dice"])

    texts = lookup_join(items.select("item_table", F.col("item_id").cast("long").alias("item_id"), "text"), wanted, ["item_table", "item_id"], "inner", salts=1)  # item ids are unique
    sets = materialise(texts.select("cid", "text").mapInArrow(elements, "cid long, n int, parity binary, elements binary"), "sets")
    close = materialise(_close(pairs, sets, similarity), "close")  # many long texts share half of their words; their multisets are not sent
    both = close.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb")), "b")
    found = materialise(both.select("a", "b", "ea", "eb").mapInArrow(overlap, "a long, b long, dice double").filter(F.col("dice") >= similarity - 1e-9), "pairs")
    for table in (ends, wanted, sets, close):
        discard(table)
    return found


@lru_cache(maxsize=DEPTH)
def _thresholds(depth: int) -> np.ndarray:
    """Sorted sample of the share of equal functions from which the trees find a pair at ``depth``.

    The trees order the same functions, so their misses coincide. If every function gets a uniform number and agrees
    where it lies below the similarity, a tree agrees from the largest number of its path on, and the forest from the smallest of these.
    """
    rng = np.random.default_rng(depth)
    found = []
    for _ in range(SAMPLES // 5000):
        u = rng.random((FUNCTIONS, 5000), dtype=np.float32)
        found.append(np.min([u[path].max(axis=0) for path in _plan()[2][:, :depth]], axis=0))
    return np.sort(np.concatenate(found))


def _detected(dice: np.ndarray, depth: int) -> np.ndarray:
    """Probability that a pair of this overlap shares a path of ``depth``; a byte agrees by chance once in 256."""
    j = dice / (2 - dice)
    at = _thresholds(depth)
    return np.maximum(np.searchsorted(at, j + (1 - j) / 256) / len(at), 1e-6)


def _overlaps(found: DataFrame, classes: DataFrame) -> np.ndarray:
    """Rows of (dice, pairs of classes, pairs of rows), by overlap rounded down to thousandths."""
    copies = classes.filter("copies > 1").select("cid", "copies")
    a, b = copies.toDF("a", "copies_a"), copies.toDF("b", "copies_b")
    weight = F.coalesce("copies_a", F.lit(1)) * F.coalesce("copies_b", F.lit(1))
    rows = found.join(a, "a", "left").join(b, "b", "left").groupBy(F.floor(F.col("dice") * 1000 + 1e-6).alias("k"))
    return np.array([tuple(r) for r in rows.agg(F.count("*"), F.sum(weight)).collect()], dtype=float).reshape(-1, 3) * [0.001, 1, 1]


def _estimated_recall(overlaps: np.ndarray, depth: int, searched: int | None = None) -> float:
    """Horvitz-Thompson estimate of the share of pairs that paths of ``depth`` find, of classes or of rows, whichever is less.

    ``overlaps`` were found at ``searched``, by default the same depth.
    """
    if not len(overlaps):
        return 1.0
    total = overlaps[:, 1:] / _detected(overlaps[:, 0], searched or depth)[:, None]
    return float(np.min((total * _detected(overlaps[:, 0], depth)[:, None]).sum(axis=0) / total.sum(axis=0)))


def _members(features: DataFrame, classes: DataFrame) -> DataFrame:
    """(item_table, item_id, cid, copies): every row with its class. Classes of many copies meet their rows by a lookup, so that none of them is one task."""
    key = ["item_table", "h0", "h1"]
    hot = materialise(classes.filter(F.col("copies") > BLOCK_ROWS), "hot")
    marked = lookup_join(features, hot, key)
    rest = marked.filter("cid is null").drop("cid", "copies").join(classes.filter(F.col("copies") <= BLOCK_ROWS), key)
    return marked.filter("cid is not null").unionByName(rest).select("item_table", "item_id", "cid", "copies")


class NearDuplicates:
    """Classes of equal texts and pairs of similar classes.

    ``classes``: cid, item_table, rep (smallest item id), n, copies; ``members``: item_table, item_id, cid;
    ``pairs``: a, b (cid, a < b), dice. ``depth`` and ``recall`` say where the search stopped.
    """

    def __init__(self, items: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL, depth: int = DEPTH) -> None:
        prepare(items.sparkSession)
        features = materialise(_features(items), "features")
        grouped = features.groupBy("item_table", "h0", "h1").agg(
            F.min("item_id").alias("rep"), F.count("*").alias("copies"), *[F.first(k).alias(k) for k in ("n", "sig", "b0", "b1")]
        )
        self.classes = materialise(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
        # signatures stay with the classes only; every table goes as soon as the next one is written
        slim = materialise(features.select("item_table", "item_id", "h0", "h1"), "rows")
        discard(features)
        self.members = _members(slim, self.classes.select("item_table", "h0", "h1", "cid", "copies"))
        parts = max(1, math.ceil(self.classes.count() * TREES / KEYS_PER_PART))
        parts = max(parts, min(2 * TREES, 2 * items.sparkSession.sparkContext.defaultParallelism))
        above, pairs = None, None
        while True:
            candidates = materialise(_candidates(self.classes, depth, parts, above), "candidates")
            plausible = materialise(_plausible(candidates, self.classes, similarity), "plausible")
            discard(candidates)
            alike = _alike(plausible, self.classes, similarity)
            discard(plausible)
            found = _verified(alike, self.classes, items, similarity)
            discard(alike)
            self.pairs = pairs = found if pairs is None else materialise(pairs.unionByName(found).distinct(), "pairs")
            overlaps = _overlaps(pairs, self.classes)
            self.depth, self.recall = depth, _estimated_recall(overlaps, depth)
            if self.recall >= target_recall:
                break
            if depth <= MIN_DEPTH:
                raise RuntimeError(f"recall {self.recall:.4f} at depth {depth}: these trees do not reach {target_recall}")
            above, depth = depth, depth - 1
            while depth > MIN_DEPTH and _estimated_recall(overlaps, depth, above) < target_recall:
                depth -= 1

    def row_pairs(self) -> DataFrame:
        """(item_table, id_a, id_b): all pairs of rows, copies included."""
        rows = self.members
        within = _block_join(rows.filter("copies > 1").select("item_table", "cid", "item_id"), ["item_table", "cid"], ["item_id"], F.col("x.item_id") < F.col("y.item_id"))
        within = within.select(F.col("x.item_table").alias("item_table"), F.col("x.item_id").alias("id_a"), F.col("y.item_id").alias("id_b"))
        # the rows of a class with many copies are dealt out to blocks, and its pairs go to each of them
        blocks = F.ceil(F.col("copies") / BLOCK_ROWS).cast("int")
        placed = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), blocks).cast("int"))
        sized = self.classes.select("cid", blocks.alias("blocks"))
        every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1)).alias(f"block_{side}")
        linked = self.pairs.join(sized.toDF("a", "blocks_a"), "a").join(sized.toDF("b", "blocks_b"), "b")
        linked = linked.select("a", "b", "blocks_b", every("a")).select("a", "b", "block_a", every("b"))
        a = placed.select(F.col("cid").alias("a"), F.col("block").alias("block_a"), "item_table", F.col("item_id").alias("ia"))
        b = placed.select(F.col("cid").alias("b"), F.col("block").alias("block_b"), F.col("item_id").alias("ib"))
        across = linked.join(a, ["a", "block_a"]).join(b, ["b", "block_b"]).select("item_table", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        return within.unionByName(across)

    def groups(self) -> DataFrame:
        """(item_table, item_id, class_id, group_id): ids are the smallest item id of the class and of the group."""
        labels = connected_components(self.pairs.select("a", "b"))
        named = self.classes.select("cid", "item_table", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        heads = named.groupBy("root").agg(F.min("rep").alias("group_id"))
        full = named.join(heads, "root").select("cid", F.col("rep").alias("class_id"), "group_id")
        return self.members.join(full, "cid").select("item_table", "item_id", "class_id", "group_id")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node of each component, by alternating large-star and small-star steps."""
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    signature = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = materialise(small, "star")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()
