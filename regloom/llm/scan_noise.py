"""Noise in text from scanned pages: furniture of the page, broken words, misread characters.

Pass one counts the words of all texts, the running heads that carry a page number, and by document the lines at page edges (next to a page
number or a page mark). A word of the vocabulary occurs at least ``MIN_COUNT`` times, a head ``MIN_HEADS`` times; a line that stands at page edges of
``EDGE_REPEATS`` texts of a document is one of its heads, beside its titles. Up to ``SHARED`` words and as many heads are shared with all tasks. If there are more, the
most frequent are, and the others stay in a written table, where each text's odd words are looked up; the results are the same. From the shared words come, on the driver, the words that are misreadings of far more frequent ones
(by the usual confusions of character recognition) and the fragments of words torn apart by a stray space. Frequencies are only compared with each other.

Pass two repairs each text: lines that fuzzily repeat a head of their document, or a head seen with page numbers, go; so do page numbers. A line that says "page" is one by its form. A bare number has to continue
the sequence of pages: it is the number of the text's page or of a neighbour, or, where the page is unknown, stands at a page edge or interrupts a sentence of a scanned document; so does a roman number. A word broken at the end of a line is joined if the vocabulary
prefers the joined form to the hyphenated one; misread words and stray characters are put right; lines are joined into
paragraphs, keeping list items and in-band page marks on lines of their own.

A text whose document is known not to be a scan is repaired only if it shows two faults or more: a single odd word is a slip of another kind.

Defined results: null stays null without faults; empty text stays empty; plain line wrapping and ``--- Page n ---`` lines are no
faults; texts that repeat get the same result each time; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.llm.lookalikes import plain_rewriter
from regloom.session import materialise, prepare

MIN_COUNT, MIN_HEADS, EDGE_REPEATS, SHARED = 8, 3, 3, 500_000
#: A misreading or torn word is at most 1/RATIO as frequent as the word it stands for.
RATIO = 8

# What is printed and what character recognition makes of it.
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("a", "o"), ("i", "j"), ("t", "f"), ("s", "8"), ("l", "1"), ("d", "cl"), ("u", "ii"), ("m", "rn"),
    ("h", "b"), ("g", "q"), ("in", "m"), ("ri", "n"), ("w", "vv"), ("S", "5"), ("B", "8"), ("O", "0"), ("I", "1"), ("cl", "d"), ("rn", "m"),
)

# Letters that differ from a plain one by an accent.
_ACCENTED = {"a": "äáàâãå", "c": "çč", "e": "éèêë", "i": "íìîï", "o": "öóòôõø", "u": "üúùû", "n": "ñ"}

_TOKEN = re.compile(r"[^\W_]+")
_MARK = re.compile(r"--- Page \d+ ---\Z")
_NUMBER_LINE = re.compile(
    r"(?i)(?:(?:page|bladsy|seite|página|стр\.?) \d{1,4}(?: (?:of|van|von|de|из) \d{1,4})?|p a g e +\d{1,4}|p\. ?\d{1,4}|[-–] \d{1,4} [-–])\Z"
)
_SIGN = re.compile(r"(?im)^[^\S\n]*(?:--- page|(?:page|bladsy|seite|página|стр\.?) \d|p a g e |p\. ?\d|[-–] \d)")
_BARE_NUMBER = re.compile(r"(?i)(?:(?P<n>\d{1,4})(?: ?/ ?\d{1,4})?|\[(?P<b>\d{1,4})\]|\([ivxlc]{1,7}\))\Z")
_HEAD_AFTER = re.compile(r"(?P<head>\S.*\S) \| \d{1,4}\Z")
_HEAD_BEFORE = re.compile(r"\d{1,4}[ \t]{2,}(?P<head>\S.*)\Z")
_BROKEN = re.compile(r"(?P<a>[^\W\d_]+)(?P<h>[-‐¬\xad])[^\S\n]*\Z")
_TORN = re.compile(r"(?<![^\W_])[^\W\d_]+\Z")
_STRAY = re.compile(r"(?<=\w)[|\\~^·](?=\s|\Z)")
_HYPHENS = frozenset("-‐¬\xad")
_STRAYS = "|\\~^·"
_ITEM = re.compile(r"[(\[]?(?:[a-z]|[ivx]{1,4}|\d{1,2})[)\]]\s|[-*•–]\s")


class _Lookup:
    """Counts of the shared words and of those looked up for the text in hand; what is missing is noted in ``asked``, unless the rare words are all known."""

    def __init__(self, shared: dict[str, int], rare: dict[str, int] | None = None) -> None:
        self.shared = shared
        self.rare = rare
        self.found: dict[str, int] = {}
        self.asked: set[str] = set()

    def times(self, key: str) -> int | None:
        if self.rare is not None:
            return self.rare.get(key, 0)
        n = self.found.get(key)
        if n is None:
            self.asked.add(key)
        return n

    def get(self, word: str, default: int = 0) -> int:
        n = self.shared.get(word)
        if n is None:
            n = self.times(word) or 0
            return n if n >= MIN_COUNT else default
        return n

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0


class Vocabulary:
    """Words with their counts, and what follows from them; small enough to be broadcast.

    With ``looked`` the counts of rare words are taken from ``rare`` or looked up (see ``_Lookup``): always where a misreading depends on how often the
    word itself occurs, and for all other words and for heads if ``counts`` or ``heads`` had to leave frequent ones out. ``longest_head`` is the number of
    words of the longest head of all.
    """

    def __init__(
        self,
        counts: dict[str, int],
        heads: frozenset[str] = frozenset(),
        looked: bool = False,
        complete: bool = True,
        all_heads: bool = True,
        lower: dict[str, int] | None = None,
        rare: dict[str, int] | None = None,
        longest_head: int | None = None,
    ) -> None:
        self.counts = counts
        self.heads = heads
        self.all_heads = all_heads
        self.longest_head = max((len(h.split()) for h in heads), default=0) if longest_head is None else longest_head
        self.lookup = _Lookup(counts, rare) if looked else None
        self.known = counts if complete else self.lookup
        self.lower = lower or {}
        self.seen: dict[str, str | None] = {}
        self.misread: dict[str, str] = {}
        self.names: set[str] = set()
        # a correction is more frequent than its misreading, so it is judged before it
        for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if x := self.correction(w, n, counts):
                self.misread[w] = x
        longest: dict[str, int] = {}
        for w, n in counts.items():
            if w in self.misread or not w.isalpha():
                continue
            for i in range(1, len(w)):
                for part in (w[:i], w[i:]):
                    if longest.get(part, 0) < n:
                        longest[part] = n
        self.solid = frozenset(w for w, n in counts.items() if w not in self.misread and longest.get(w, 0) < RATIO * n)

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    def is_misread(self, word: str) -> bool:
        """Whether a word of the vocabulary is itself a misreading."""
        if word in self.counts or self.known is self.counts:
            return word in self.misread
        return self.corrected(word) is not None

    def is_known_head(self, line: str) -> bool:
        if not self.longest_head or line.count(" ") >= 2 * self.longest_head or len(tokens := _TOKEN.findall(line.lower())) > self.longest_head:
            return False
        template = head_template(tokens, self.known)
        return template in self.heads or not self.all_heads and bool(self.lookup.times("\0" + template))

    def _is_name(self, word: str, known: dict[str, int] | _Lookup) -> bool:
        """Whether the lower-case form of a word is unknown."""
        low = word.lower()
        if known is self.counts and self.known is not self.counts:  # judging the shared words: the rare ones are looked up once
            self.names.add(low)
            return low not in self.counts and low not in self.lower
        return low not in known

    def _lost_accent(self, word: str, i: int, bad: str, n: int, known: dict[str, int] | _Lookup) -> bool:
        """Whether the letter that could be a misreading is rather one that lost its accent."""
        return any(known.get(word[:i] + c + word[i + 1 :], 0) >= RATIO * n for c in _ACCENTED.get(bad, ""))

    def correction(self, word: str, n: int = 1, known: dict[str, int] | _Lookup | None = None) -> str | None:
        """The word that ``word``, seen ``n`` times, is a misreading of."""
        known = self.known if known is None else known
        if len(word) < 3 or word.isupper() or word.isdigit():
            return None
        figures = sum(c.isdigit() for c in word)
        if 2 * figures > len(word):
            return None
        best, found = 0, None
        for good, bad in CONFUSIONS:
            i = word.find(bad)
            while i >= 0:
                x = word[:i] + good + word[i + len(bad) :]
                k = known.get(x, 0)
                if k > best and k >= RATIO * n and (len(word) > 3 or k >= 300 * n) and not self.is_misread(x):
                    doubtful = good == "a" and word[0].isupper() and k < 50 * n
                    if not (doubtful and self._is_name(x, known)) and not self._lost_accent(word, i, bad, n, known):
                        best, found = k, x
                i = word.find(bad, i + 1)
        if found is None and figures and not word.isdigit():
            # several figures read for letters
            x = word
            for good, bad in CONFUSIONS:
                if bad.isdigit():
                    x = x.replace(bad, good)
            if x != word and known.get(x, 0) >= RATIO * n:
                found = x
        return found

    def corrected(self, word: str) -> str | None:
        """Correction of a word that is not solid, from the table or, for a rare word, computed."""
        if word in self.misread:
            return self.misread[word]
        if word in self.counts:
            return None
        if word not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.correction(word)
            if found and self.lookup:
                n = self.lookup.times(word) or 1
                found = found if n == 1 else self.correction(word, n)
            if self.lookup and self.lookup.asked:
                return found  # may rest on counts that are still to be looked up
            self.seen[word] = found
        return self.seen[word]


_FIGURED = re.compile(r"(?=[^\W\d_]*\d)(?=.*[a-z].*[a-z])[^\W_]{3,}\Z")
_LETTERS = str.maketrans("5081", "soBl")


def _figures_inside(word: str) -> bool:
    """One or two figures that stand for letters inside a lower-case word."""
    n = sum(c.isdigit() for c in word)
    if not (1 <= n <= 2 and _FIGURED.match(word)) or sum(c.islower() for c in word) < 2 * n:
        return False
    return bool(re.search(r"[a-zà-ÿ][0158]|[0158][a-zà-ÿ]{2}", word)) and not re.match(r"\d+(?:st|nd|rd|th|ste|de|er|e|km|m|kg)\Z", word)


_CAPITAL = str.maketrans("5081", "SOBI")


def _capital_figure(word: str, counts: dict[str, int]) -> str | None:
    """A word in capitals with the letter that a figure in it stands for."""
    if len(word) < 5 or not word.isupper() or sum(c.isdigit() for c in word) != 1:
        return None
    w = word.translate(_CAPITAL)
    return w if w.lower() in counts else w.replace("I", "L") if w.lower().replace("i", "l") in counts else None


_ENDS = frozenset(".;:,!?\"”)。！？；：，、।؟؛»」』")


def head_key(line: str) -> str:
    """A line as a running head: lower case, letters only, single spaces."""
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()))


def head_template(tokens: list[str], counts: dict[str, int]) -> str:
    """The words of a line with those outside the vocabulary starred, so heads that differ in a name coincide."""
    return " ".join("#" if t.isdigit() else t if t in counts else "*" for t in tokens)


def _numbered_head(line: str) -> str | None:
    if "|" not in line and not line[:1].isdigit():
        return None
    m = _HEAD_AFTER.match(line) or _HEAD_BEFORE.match(line)
    return m.group("head") if m and len(head_key(m.group("head")).split()) >= 2 else None


def _repeats(key: list[str], known: list[list[str]]) -> bool:
    """Whether a line of words fuzzily repeats the beginning of a known head."""
    n = len(key)
    for words in known:
        front = words[: n + 1]
        if len(front) < 3:
            continue
        left = Counter(front)
        hits = 0
        for w in key:
            if left[w] > 0:
                left[w] -= 1
                hits += 1
        if hits >= max(3, 0.75 * n) and key[0] == words[0]:
            return True
    return False


@lru_cache(maxsize=4096)
def _head_words(titles: tuple[str, ...]) -> list[list[str]]:
    return [head_key(x).split() for x in titles if x]


def _is_head(line: str, vocabulary: Vocabulary, known: list[list[str]]) -> bool:
    if line[0].islower() or line[-1] in _ENDS or len(line) < 8:
        return False
    key = head_key(line).split()
    if len(key) < 2:
        return False
    if known and len(key) >= 3 and _repeats(key, known):
        return True
    return vocabulary.is_known_head(line)


def _is_edge(line: str) -> bool:
    return not line or bool(_MARK.match(line) or _NUMBER_LINE.match(line))


def _is_page_number(lines: list[str], i: int, page: int | None, scanned: bool | None) -> bool:
    line = lines[i]
    if len(line) > 40:
        return False
    if _NUMBER_LINE.match(line):
        return True
    m = _BARE_NUMBER.match(line) if len(line) < 12 else None
    if not m or scanned is False:
        return False
    before, after = (lines[i - 1] if i else ""), (lines[i + 1] if i + 1 < len(lines) else "")
    edge = _is_edge(before) or _is_edge(after)
    number = m.group("n") or m.group("b")
    broken = bool(scanned and before) and before[-1] not in ".:;!?"  # it interrupts a sentence
    if number is None:
        return edge or broken
    return abs(int(number) - page) <= 1 if page is not None else edge or broken and len(number) < 4


def edge_lines(text: str) -> set[str]:
    """Lines next to a page number or a page mark, as they may head or foot a page."""
    if not _SIGN.search(text):
        return set()
    lines = [x.strip() for x in text.split("\n")]
    filled = [i for i, x in enumerate(lines) if x]
    signs = [bool(_MARK.match(lines[i]) or _NUMBER_LINE.match(lines[i])) for i in filled]
    if not any(signs):
        return set()
    near = [i for k, i in enumerate(filled) if not signs[k] and (k and signs[k - 1] or k + 1 < len(filled) and signs[k + 1])]
    return {lines[i] for i in near if len(head_key(lines[i]).split()) >= 2 and lines[i][-1] not in ".;:,!?\"”)" and not lines[i][0].islower()}


def repair(text: str, vocabulary: Vocabulary, titles: tuple[str, ...] | list[str] = (), page: int | None = None, scanned: bool | None = None) -> tuple[str, list[str]]:
    """(continuous paragraphs, sorted kinds of fault found); ``page`` and ``scanned`` say what is known of the text's origin."""
    faults: Counter = Counter()
    t = plain_rewriter()(text) if not text.isascii() else text
    if "\xad" in text:  # a soft hyphen at a line end is a break, elsewhere it is invisible
        t = plain_rewriter()(re.sub("\xad[^\\S\\n]*\\n", "¬\n", text))
    known = _head_words(tuple(titles))
    lines: list[str] = []
    raws = t.split("\n")
    bare = [x.strip() for x in raws]
    for i, (raw, line) in enumerate(zip(raws, bare, strict=True)):
        if line and not _MARK.match(line):
            if _is_page_number(bare, i, page, scanned):
                faults["page number"] += 1
                lines.append("\0")
                continue
            if _numbered_head(line) or _is_head(line, vocabulary, known):
                faults["running header"] += 1
                lines.append("\0")
                continue
        lines.append(raw.rstrip())
    joined = _words(_join_breaks(lines, vocabulary, faults), vocabulary, faults)
    if scanned is False and faults.total() == 1:
        return _paragraphs(raws), []
    return _paragraphs(joined), sorted(faults)


def _join_breaks(lines: list[str], vocabulary: Vocabulary, faults: Counter) -> list[str]:
    """Lines without furniture (marked by a NUL), broken words put together."""
    kept = []
    furniture = False
    for line in lines:
        if line == "\0":
            furniture = True
            continue
        blank = not line.strip()
        if blank and (furniture or (kept and kept[-1] == "\1")):
            if kept and kept[-1] not in ("", "\1"):
                kept.append("\1")  # a blank line next to furniture: the text may run on
            continue
        if furniture and kept and kept[-1] == "":
            kept[-1] = "\1"
        furniture = False
        kept.append("" if blank else line)
    out: list[str] = []
    for line in kept:
        if line == "\1":
            out.append("\1")
            continue
        prior = len(out) - 1
        while prior >= 0 and out[prior] == "\1":
            prior -= 1
        tail = out[prior].rstrip() if prior >= 0 else ""
        m = _BROKEN.search(out[prior], max(0, len(tail) - 40)) if tail[-1:] in _HYPHENS else None
        first = re.match(r"\s*([^\W\d_]+)", line)
        if m and first and first.group(1)[0].islower():
            a, b = m.group("a"), first.group(1)
            whole, hyphened = vocabulary.known.get(a + b, 0), vocabulary.known.get(f"{a}-{b}", 0)
            both = vocabulary.known.get(a, 0) and vocabulary.known.get(b, 0)
            real = m.group("h") in "-‐" and hyphened > whole
            if not real:
                faults["broken word"] += 1
            glue = "-" if real or (m.group("h") in "-‐" and not whole and both and hyphened) else ""
            out[prior] = out[prior][: m.start("h")] + glue + line.lstrip()
            del out[prior + 1 :]
            continue
        torn = _TORN.search(out[prior], max(0, len(out[prior]) - 40)) if prior >= 0 and first and first.group(1)[0].islower() else None
        if torn:
            a, b = torn.group(), first.group(1)
            if not (a in vocabulary.solid and b in vocabulary.solid):
                whole = vocabulary.known.get(a + b, 0)
                if whole >= max(MIN_COUNT, RATIO * min(vocabulary.known.get(a, 0), vocabulary.known.get(b, 0))) and not vocabulary.is_misread(a + b):
                    faults["broken word"] += 1
                    out[prior] = out[prior].rstrip() + line.lstrip()
                    del out[prior + 1 :]
                    continue
        if prior != len(out) - 1:
            # furniture stood between two pieces: a new paragraph only after the end of a sentence
            ended = prior < 0 or out[prior].rstrip()[-1:] in ".!?:;\"”" or not first or not first.group(1)[0].islower()
            del out[prior + 1 :]
            if ended and out and out[-1] != "":
                out.append("")
        out.append(line)
    while out and out[-1] in ("", "\1"):
        out.pop()
    return out


def _words(lines: list[str], vocabulary: Vocabulary, faults: Counter) -> list[str]:
    """Stray characters out, torn words joined, misread words put right; only words that are not solid are looked at."""
    solid, counts = vocabulary.solid, vocabulary.known
    whole = "\n".join(lines)
    any_odd = {w for w in set(_TOKEN.findall(whole)) - solid if not w.isdigit()}
    if not any_odd and not any(c in whole for c in _STRAYS):
        return lines
    for i, line in enumerate(lines):
        if any(c in line for c in _STRAYS) and _STRAY.search(line):
            faults["misread characters"] += 1
            line = lines[i] = _STRAY.sub("", line)
        odd = [w for w in any_odd if w in line]
        edits: list[tuple[int, int, str]] = []
        for w in odd:
            corrected = _capital_figure(w, counts) if w.isupper() else vocabulary.corrected(w)
            if w.isupper() and not corrected:
                continue  # codes in capitals are no words, unless a figure stands for a letter
            if not corrected and _figures_inside(w):
                corrected = w.translate(_LETTERS)
            at = line.find(w)
            while at >= 0:
                end = at + len(w)
                if (at == 0 or not _alnum(line[at - 1])) and (end == len(line) or not _alnum(line[end])):
                    gap = _torn_at(line, at, end, vocabulary) if w.isalpha() else None
                    if gap is not None:
                        edits.append((gap, gap + 1, ""))
                    elif corrected:
                        edits.append((at, end, corrected))
                at = line.find(w, end)
        if edits:
            faults["misread characters"] += len(set(edits))
            parts, at = [], 0
            for start, end, new in sorted(set(edits)):
                if start >= at:
                    parts += [line[at:start], new]
                    at = end
            lines[i] = "".join(parts) + line[at:]
    return lines


def _alnum(c: str) -> bool:
    return c.isalnum()


_BEFORE = re.compile(r"(?<![^\W_])[^\W\d_]+\Z")
_AFTER = re.compile(r"[^\W\d_]+(?![^\W_])")


def _torn_at(line: str, at: int, end: int, vocabulary: Vocabulary) -> int | None:
    """Position of a space that tears the word at line[at:end] from its other half."""
    counts = vocabulary.known

    def whole(a: str, b: str) -> bool:
        k = counts.get(a + b, 0)
        return k >= MIN_COUNT and k >= RATIO * min(counts.get(a, 0), counts.get(b, 0)) and not vocabulary.is_misread(a + b)

    w = line[at:end]
    if at > 1 and line[at - 1] == " " and w[0].islower():
        m = _BEFORE.search(line, max(0, at - 32), at - 1)
        if m and whole(m.group(), w):
            return at - 1
    if end + 1 < len(line) and line[end] == " " and line[end + 1].islower():
        m = _AFTER.match(line, end + 1)
        if m and whole(w, m.group()):
            return end
    return None


def _paragraphs(lines: list[str]) -> str:
    out: list[str] = []
    fresh = True
    for line in lines:
        s = line.strip()
        if not s:
            if out and out[-1] != "":
                out.append("")
            fresh = True
        elif fresh or _MARK.match(s) or _ITEM.match(s) or (out and _MARK.match(out[-1])):
            out.append(s)
            fresh = False
        else:
            out[-1] = f"{out[-1]} {s}"
    while out and out[-1] == "":
        out.pop()
    return "\n".join(out)


def _hyphened(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+-[^\W\d_]+", text) if "-" in text else []


def word_statistics(items: DataFrame) -> DataFrame:
    """(kind, word, n): words and hyphenated words (w), numbered running heads (h), lines at page edges with their document before a NUL (e), all tokens (t).

    Counted per partition, then summed; a line at a page edge counts once a text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = plain_rewriter()
        found: dict[str, Counter] = {"w": Counter(), "h": Counter(), "e": Counter()}
        tokens = 0

        def flush() -> pa.RecordBatch:
            kinds = [k for k, c in found.items() for _ in c]
            words, n = [w for c in found.values() for w in c], [x for c in found.values() for x in c.values()]
            for c in found.values():
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["kind", "word", "n"])

        for b in batches:
            for text, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = rewrite(text)
                # codes of figures and capitals are no words; leaving them out keeps the table small
                words = [w for w in _TOKEN.findall(t) if not w.isupper() and not w.isdigit()]
                found["w"].update(words)
                found["w"].update(_hyphened(t))
                tokens += len(words)
                if "\n" in t:
                    if doc is not None:
                        found["e"].update(f"{doc}\0{line}" for line in edge_lines(t))
                if " | " in t or "   " in t or "\t" in t:
                    for line in t.split("\n"):
                        if head := _numbered_head(line.strip()):
                            found["h"][head] += 1
            if sum(map(len, found.values())) > 400_000:
                yield flush()
        yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(["t"]), pa.array([""]), pa.array([tokens], pa.int64())], names=["kind", "word", "n"])

    rows = items.select("text", F.col("doc").cast("string") if "doc" in items.columns else F.lit(None).cast("string").alias("doc")).filter(F.col("text").isNotNull())
    counted = rows.mapInArrow(count, "kind string, word string, n long")
    return counted.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _templates(heads: DataFrame, words: DataFrame, counts: dict[str, int], complete: bool) -> DataFrame:
    """(template, n) of numbered heads; words that ``counts`` leaves out are looked up."""
    broadcast = heads.sparkSession.sparkContext.broadcast(counts)

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(w, t) for w in b.column(0).to_pylist() for t in set(_TOKEN.findall(w.lower())) if not t.isdigit() and t not in broadcast.value]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["word", "key"])

    def templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [head_template(_TOKEN.findall(w.lower()), ChainMap(dict.fromkeys(more or ()), broadcast.value)) for w, more in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), b.column(1)], names=["template", "n"])

    if complete:
        rows = heads.withColumn("more", F.lit(None).cast("array<string>"))
    else:
        asked = heads.select("word").mapInArrow(unknown, "word string, key string")
        more = lookup_join(asked, words.filter(F.col("n") >= MIN_COUNT).select("key"), ["key"], "inner").groupBy("word").agg(F.collect_list("key").alias("more"))
        rows = heads.join(more, "word", "left").select("word", "n", "more")
    return rows.mapInArrow(templates, "template string, n long").groupBy("template").agg(F.sum("n").alias("n"))


def build_vocabulary(items: DataFrame) -> tuple[Vocabulary, DataFrame, DataFrame]:
    """(vocabulary of all texts, table of counts by key for all other words and heads, heads by document as (doc, title)).

    What reaches the driver is bounded by ``SHARED`` words and as many head templates, for any corpus; whatever
    the bound leaves out is looked up in the table, so thresholds are the same at all sizes.
    """
    spark = items.sparkSession
    stats = materialise(word_statistics(items), "words")
    total = stats.filter("kind = 't'").agg(F.sum("n")).first()[0] or 0
    bound = total // SHARED + 1  # at most SHARED words are as frequent as this
    words = stats.filter("kind = 'w'").select(F.col("word").alias("key"), "n")
    every, frequent = words.agg(F.count("*"), F.count_if(F.col("n") >= MIN_COUNT)).first()
    least = MIN_COUNT if frequent <= SHARED else max(MIN_COUNT, bound)
    kept = {r["key"]: r["n"] for r in words.filter(F.col("n") >= (1 if every <= SHARED else least)).toLocalIterator()}
    counts = {w: n for w, n in kept.items() if n >= least}
    rare = {w: n for w, n in kept.items() if n < least} if every <= SHARED else None
    complete = least == MIN_COUNT
    heads = materialise(
        _templates(stats.filter("kind = 'h'").select("word", "n"), words, counts, complete).filter((F.col("n") >= MIN_HEADS) & F.col("template").rlike(r"\p{L}{3}")), "heads"
    )
    some, longest = heads.agg(F.count("*"), F.max(F.size(F.split("template", " ")))).first()
    least_heads = MIN_HEADS if some <= SHARED else max(MIN_HEADS, bound)
    shared = frozenset(r["template"] for r in heads.filter(F.col("n") >= least_heads).toLocalIterator())
    known = {"heads": shared, "looked": True, "complete": complete, "all_heads": least_heads == MIN_HEADS, "rare": rare, "longest_head": longest or 0}
    v = Vocabulary(counts, **known)
    if v.names and rare is None:
        asked = spark.createDataFrame([(w,) for w in v.names], "key string")
        lower = {r["key"]: r["n"] for r in lookup_join(words.filter(F.col("n") >= MIN_COUNT), asked, ["key"], "inner").toLocalIterator()}
        v = Vocabulary(counts, **known, lower=lower)
    parts = F.split("word", "\0", 2)
    repeated = stats.filter((F.col("kind") == "e") & (F.col("n") >= EDGE_REPEATS)).select(parts[0].alias("doc"), parts[1].alias("title"))
    return v, words.unionByName(heads.select(F.concat(F.lit("\0"), "template").alias("key"), "n")), repeated


def repair_scans(items: DataFrame, titles: DataFrame | None = None, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(item_table, item_id, repaired, faults): every item repaired, with the kinds of fault it had.

    ``items`` has item_table, item_id, text and, if known, doc and page (a number); ``titles`` has doc, title and, if known, scanned (whether the document
    was read from a scan). Texts whose repair needs counts of rare words are repaired again with them, until none is missing.
    """
    spark = items.sparkSession
    prepare(spark)
    v, table, heads = build_vocabulary(items) if vocabulary is None else (vocabulary, None, None)
    if v.lookup and v.lookup.rare is not None and v.all_heads:
        table = None  # nothing is left to look up
    shared = spark.sparkContext.broadcast(v)
    if titles is not None:
        origin = titles.select("doc", "title", F.col("scanned") if "scanned" in titles.columns else F.lit(None).cast("boolean").alias("scanned"))
        heads = origin if heads is None else origin.unionByName(heads.withColumn("scanned", F.lit(None).cast("boolean")))
    rows = items.select("item_table", F.col("item_id").cast("long").alias("item_id"), "text", *[F.col(c).cast(t) if c in items.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc", "string"), ("page", "int"))])
    if heads is not None:
        if "scanned" not in heads.columns:
            heads = heads.withColumn("scanned", F.lit(None).cast("boolean"))
        known = heads.filter("doc is not null").groupBy("doc").agg(F.collect_set("title").alias("titles"), F.max("scanned").alias("scanned"))
        rows = lookup_join(rows, materialise(known, "heads"), ["doc"])
    else:
        rows = rows.withColumns({"titles": F.lit(None).cast("array<string>"), "scanned": F.lit(None).cast("boolean")})
    kept = ["item_table", "item_id", "text", "page", "titles", "scanned"]
    rows = rows.select(*kept, F.lit(None).cast("array<struct<key:string,n:bigint>>").alias("counts"))
    schema = "item_table string, item_id long, repaired string, faults array<string>, text string, page int, titles array<string>, scanned boolean, counts array<struct<key:string,n:bigint>>, asked array<string>"
    names = [f.split()[0] for f in schema.replace("<key:string,n:bigint>", "").split(", ")]

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for b in batches:
            done, asked = [], []
            for t, page, heads, scan, c in zip(*(b.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if vocab.lookup:
                    vocab.lookup.found = {x["key"]: x["n"] for x in c or ()}
                    vocab.lookup.asked = set()
                done.append((None, []) if t is None else repair(t, vocab, heads or (), page, scan))
                asked.append(sorted(vocab.lookup.asked) if vocab.lookup else [])
            ready = pa.array([not a for a in asked], pa.bool_())
            later = [pa.compute.if_else(ready, pa.scalar(None, b.column(i).type), b.column(i)) if i == 2 else b.column(i) for i in range(2, 7)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string())), *later, pa.array(asked, pa.list_(pa.string()))],
                names=names,
            )

    result = None
    while True:
        passed = rows.mapInArrow(mend, schema)
        if table is None:
            return passed.select("item_table", "item_id", "repaired", "faults")
        passed = materialise(passed, "mended")
        ready = passed.filter(F.size("asked") == 0).select("item_table", "item_id", "repaired", "faults")
        result = ready if result is None else result.unionByName(ready)
        open_ = passed.filter(F.size("asked") > 0).select(*kept, "counts", "asked", F.xxhash64("text", "asked").alias("h"))
        if open_.isEmpty():
            return result
        wanted = open_.select("h", F.explode("asked").alias("key")).distinct()
        known = materialise(table.join(wanted.select("key").distinct(), "key"), "counts")
        answers = lookup_join(wanted, known, ["key"]).groupBy("h").agg(F.collect_list(F.struct("key", F.coalesce("n", F.lit(0)).alias("n"))).alias("more"))
        more = lookup_join(open_, materialise(answers, "answers"), ["h"])
        rows = more.select(*kept, F.concat(F.coalesce("counts", F.array().cast("array<struct<key:string,n:bigint>>")), "more").alias("counts"))
