"""Visually identical text: transitive look-alike classes and one representative for each.

Relations between strings come from rules over the Unicode character data (canonical compositions, full-width and
half-width forms, non-breaking forms, f-ligatures) and from a short list of letters whose glyphs coincide.
Union-find over these strings (single code points and sequences alike) gives transitive classes, so a
Cyrillic letter with a combining accent falls into the class of the precomposed Latin letter. The
representative of a class is its most frequent member in the corpus (ties: lowest code points), and an
Aho-Corasick automaton rewrites every other member, leftmost-longest.

Invisible characters are erased; the joiners U+200C and U+200D stay next to letters of scripts whose shape they
change. Differences that can be seen (case, accents, superscripts, quotation marks, line breaks, the
number of spaces) are kept.

Defined results: null text stays null and takes part in no pair; empty text is a text of its own, equal in look to
text made of invisible characters only; the length of a text is not limited.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.session import materialise, prepare

# Letters with coinciding glyphs, Cyrillic and Greek against Latin.
CYRILLIC = "АВЕКМНОРСТУХаеорсухѕіјһԁԛԝЅІЈԌԚԜӏ"
CYRILLIC_LATIN = "ABEKMHOPCTYXaeopcyxsijhdqwSIJGQWl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳν"
GREEK_LATIN = "ABEZHIKMNOPTYXocjv"
# An Armenian letter and the small Roman numerals of one letter.
OTHERS = "օⅰⅴⅹⅼⅽⅾⅿ"
OTHERS_LATIN = "oivxlcdm"
# Invisible characters (soft hyphen, combining grapheme joiner, vowel separator, zero-width space, marks, embeddings and isolates of
# direction, word joiner, invisible operators, variation selectors, byte order mark), and the two joiners that matter to some scripts.
INVISIBLE = "\u00ad\u034f\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"
JOINERS = "‌‍"
LIGATURES = range(0xFB00, 0xFB05)

_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_SHAPED = "؀-ࣿऀ-෿ༀ-႟ក-᢯"
_JOINER = re.compile(f"(?<![{_SHAPED}])[{JOINERS}]+(?![{_SHAPED}])")


class UnionFind:
    """Union-find over strings with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb, key=lambda s: (len(s), s))] = min(ra, rb, key=lambda s: (len(s), s))

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            groups[self.find(x)].append(x)
        return [sorted(g, key=lambda s: (len(s), s)) for g in groups.values() if len(g) > 1]


@lru_cache(maxsize=1)
def lookalike_classes() -> tuple[tuple[str, ...], ...]:
    """All classes with two or more members; the universe is fixed by Unicode, not by the data."""
    uf = UnionFind()
    letters = [*zip(CYRILLIC, CYRILLIC_LATIN, strict=True), *zip(GREEK, GREEK_LATIN, strict=True), *zip(OTHERS, OTHERS_LATIN, strict=True)]
    for a, b in letters:
        uf.union(a, b)
    uf.union("‐", "-")
    composed: list[str] = []
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        parts = unicodedata.decomposition(ch)
        if not parts:
            continue
        tag, _, rest = parts.rpartition("> ")
        if tag in ("<wide", "<narrow", "<noBreak") or (tag == "<compat" and cp in LIGATURES):
            uf.union(ch, "".join(chr(int(h, 16)) for h in rest.split()))
        elif not tag and " " in rest and 0xC0 <= cp < 0x2000:
            composed.append(ch)
    twins = {m: [x for x in c if len(x) == 1] for c in uf.classes() for m in c}
    for ch in composed:
        full = unicodedata.normalize("NFD", ch)
        uf.union(ch, full)
        for base in twins.get(full[0], ()):
            sequence = base + full[1:]
            uf.union(full, sequence)
            uf.union(full, unicodedata.normalize("NFC", sequence))
    return tuple(tuple(c) for c in uf.classes())


def prepared(text: str) -> str:
    """Composed form without invisible characters."""
    if text.isascii():
        return text
    text = _composed(text)
    if _INVISIBLE.search(text):
        text = _composed(_INVISIBLE.sub("", text))
    if _JOINER.search(text):
        text = _composed(_JOINER.sub("", text))
    return text


def _composed(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Rewrites: each member that is not the representative of its class, to the representative."""
    out = {}
    for members in lookalike_classes():
        # a string that composing would change is no representative
        best = min(members, key=lambda s: (not unicodedata.is_normalized("NFC", s), -counts.get(s, 0), not s.isascii(), len(s), s))
        out.update((m, best) for m in members if m != best)
    return out


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton."""

    def __init__(self, rewrites: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, v in rewrites.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.ascii_stays = not any(k.isascii() for k in rewrites)
        # a text without any of these holds no member that is rewritten
        single = {c for k in rewrites for c in k if not c.isascii()} - {c for k in rewrites if len(k) > 1 for c in k[:1]} | {k for k in rewrites if len(k) == 1}
        wordy = [re.escape(k) for k in rewrites if len(k) > 1 and k.isascii()]
        alternatives = (["[" + "".join(map(re.escape, sorted(single))) + "]"] if single else []) + wordy
        self.trigger = re.compile("|".join(alternatives) or r"(?!)")

    def __call__(self, text: str) -> str:
        if self.ascii_stays and text.isascii():
            return text
        t = prepared(text)
        if not self.trigger.search(t):
            return t
        parts, at = [], 0
        for end, (n, rep) in self.automaton.iter_long(t):
            start = end + 1 - n
            parts.append(t[at:start])
            parts.append(rep)
            at = end + 1
        if not parts:
            return t
        parts.append(t[at:])
        out = "".join(parts)
        # a mark may now compose with the end of a rewritten string
        return out if unicodedata.is_normalized("NFC", out) else self(unicodedata.normalize("NFC", out))


@lru_cache(maxsize=1)
def plain_rewriter() -> Rewriter:
    """Rewriter that prefers the lowest code points; for comparisons that need no corpus."""
    return Rewriter(representatives({}))


@lru_cache(maxsize=1)
def _members() -> tuple[frozenset[str], tuple[str, ...]]:
    single = frozenset(m for c in lookalike_classes() for m in c if len(m) == 1)
    several = tuple(m for c in lookalike_classes() for m in c if len(m) > 1)
    return single, several


_MARKED = re.compile("[^̀-ͯ][̀-ͯ]+")


def count_members(texts: Iterable[str]) -> Counter:
    """How often each class member occurs in ``texts`` (after composing and erasing)."""
    single, several = _members()
    counts: Counter = Counter()
    joined = "\n".join(prepared(t) for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    values, n = np.unique(codes, return_counts=True) if len(codes) < 4096 else (lambda b: (np.nonzero(b)[0], b[np.nonzero(b)[0]]))(np.bincount(codes))
    for v, k in zip(values.tolist(), n.tolist(), strict=True):
        ch = chr(v)
        if ch in single:
            counts[ch] += k
    marked = Counter(_MARKED.findall(joined)) if not joined.isascii() else Counter()
    for m in several:
        if m.isascii():
            if k := joined.count(m):
                counts[m] += k
        elif m in marked:
            counts[m] += marked[m]
    return counts


def member_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Corpus counts of class members: counted per batch, summed per partition, then over all rows.

    The result has at most as many rows as the classes have members, whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total.update(count_members(t for t in b.column(0).to_pylist() if t))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["member", "n"])

    rows = texts.select(column).mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n")).collect()
    return {r["member"]: r["n"] for r in rows}


def canonical_forms(texts: DataFrame, column: str, output: str = "canonical", counts: dict[str, int] | None = None) -> DataFrame:
    """Adds ``output``: the text in which look-alike texts are equal. Other columns pass through."""
    prepare(texts.sparkSession)
    if output != column:
        texts = texts.drop(output)
    rewrites = representatives(member_counts(texts, column) if counts is None else counts)
    at = texts.columns.index(column)
    schema = texts.select("*", F.col(column).cast("string").alias(output)).schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Rewriter(rewrites)
        for b in batches:
            out = pa.array([None if t is None else f(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=schema.names)

    return texts.mapInArrow(rewrite, schema)


def look_hashes(items: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(item_table, item_id, look, raw): 128-bit hash of the canonical text and of the stored one, as binary."""
    rewrites = representatives(counts)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Rewriter(rewrites)
        digest = xxhash.xxh3_128_digest
        for b in batches:
            texts = b.column(2).to_pylist()
            raw = [digest(t) for t in texts]
            look = [digest(f(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], names=["item_table", "item_id", "look", "raw"])

    return (
        items.select("item_table", "item_id", "text")
        .filter(F.col("text").isNotNull())
        .mapInArrow(hashes, "item_table string, item_id long, look binary, raw binary")
    )


#: Forms of a look, or rows of a form, that one task pairs at most with those of another; larger groups are split.
SPLIT_ROWS = 4096


def stored_forms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, forms) of the looks that are stored in two forms or more.

    rows: item_table, item_id, look, raw; forms: item_table, look, raw, n (rows of the form), first (smallest item id), forms (forms of the look).
    """
    prepare(items.sparkSession)
    hashed = materialise(look_hashes(items, member_counts(items, "text")), "looks")
    forms = hashed.groupBy("item_table", "look", "raw").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    several = forms.groupBy("item_table", "look").agg(F.count("*").alias("forms")).filter("forms > 1")
    several = materialise(several, "several")
    forms = materialise(lookup_join(forms, several, ["item_table", "look"], "inner", salts=1), "forms")
    rows = lookup_join(hashed, several.drop("forms"), ["item_table", "look"], "inner").distinct()
    return rows, forms


def lookalike_pairs(items: DataFrame) -> DataFrame:
    """Pairs of items of one table that look the same but are stored with different characters.

    The distinct forms of a look are joined first, so rows that are equal never meet; then each form gives place to its rows.
    Looks of many forms and forms of many rows are split into blocks, so no task meets all pairs of a hot group.
    """
    rows, forms = stored_forms(items)
    key = ["item_table", "look"]
    blocks = lambda n: F.ceil(F.col(n) / SPLIT_ROWS).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n, by: F.pmod(F.xxhash64(by), n).cast("int")
    left = forms.select(*key, F.col("raw").alias("raw_a"), blocks("n").alias("blocks_a"), dealt(blocks("forms"), "raw").alias("block"))
    right = forms.select(*key, F.col("raw").alias("raw_b"), blocks("n").alias("blocks_b"), numbers(blocks("forms")).alias("block"))
    # the planner does not see that blocks multiply the forms of a hot look, and would send all of them to the driver
    pairs = left.join(right.hint("merge"), [*key, "block"]).filter("raw_a < raw_b").drop("block")
    pairs = pairs.withColumn("block_a", numbers(F.col("blocks_a"))).withColumn("block_b", numbers(F.col("blocks_b")))
    placed = lookup_join(rows, forms.select(*key, "raw", blocks("n").alias("blocks")), [*key, "raw"]).withColumn("block", dealt(F.col("blocks"), "item_id"))
    side = lambda s: placed.select(*key, F.col("raw").alias(f"raw_{s}"), F.col("block").alias(f"block_{s}"), F.col("item_id").alias(f"item_{s}"))
    both = pairs.join(side("a"), [*key, "raw_a", "block_a"]).join(side("b"), [*key, "raw_b", "block_b"]).filter("item_a <> item_b")
    return both.select("item_table", F.least("item_a", "item_b").alias("id_a"), F.greatest("item_a", "item_b").alias("id_b"))


def lookalike_groups(items: DataFrame) -> DataFrame:
    """(item_table, group_id, forms, items): the looks that are stored in two forms or more; group_id is the smallest item id. Its size does not grow with the number of pairs."""
    _, forms = stored_forms(items)
    grouped = forms.groupBy("item_table", "look").agg(F.min("first").alias("group_id"), F.count("*").alias("forms"), F.sum("n").alias("items"))
    return grouped.select("item_table", "group_id", "forms", "items")
