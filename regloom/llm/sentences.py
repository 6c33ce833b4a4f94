"""Sentence boundaries across languages and scripts.

A pushdown automaton reads the terminators, quotation marks, brackets and item marks of each paragraph. The stack holds open
quotations and brackets, so a full stop inside either ends nothing; what follows the closing mark decides
whether the quotation ended the sentence or stands within it. It also holds the levels of lists: an item mark at the start of a line opens one where the text before
it ended with a colon, or in a list with a semicolon, a comma or a conjunction; the full stop of such a mark ends nothing, and the end of the sentence closes its lists. A full stop at level zero is checked against a trie of
abbreviations (walked backwards, look-alike letters folded), decimals, ordinals and list numbers. Scripts with their own
terminators need no following space; Thai paragraphs break at spaces that are not next to a figure.

Defined results: offsets are code points of the stored text; an empty line ends a sentence, a single line break
does not; page marker lines belong to no sentence; null, empty and blank texts have no sentences. An unclosed
quotation or bracket is given up at the end of its paragraph, which is then read again without it. Time is linear in the length of the text. Where capitals give no hint (a sentence in
capitals throughout, or with a capital in every word), an abbreviation that may end a sentence, an ellipsis or a closed quotation ends it only if other writing follows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.llm.lookalikes import lookalike_classes
from regloom.session import prepare

# Abbreviations. Kinds: "always" never ends a sentence before more text; "figure" is an
# abbreviation only before a figure; "open" may end one, the next letter's case decides.
ALWAYS = (
    "e.g|i.e|cf|viz|vs|approx|ca|dr|prof|mr|mrs|ms|mx|messrs|hon|adv|rev|st|udkt|nkk|mnu|mnr|mev|bv|d.w.s|d.i|o.a|m.b.t|t.o.v|"
    "p. ex|p.ex|mme|mlle|me|env|c.-à-d|z. b|z.b|d. h|d.h|u. a|bzw|vgl|inkl|hr|fr|i. v|т. е|т.е|т. п|т. д|др|проф|гг|डॉ|रु|श्री|कु"
).split("|")
FIGURE = "no|nos|nr|nrs|art|arts|s|ss|para|paras|reg|regs|sec|ch|cl|fig|vol|p|pp|par|item|abs|abb|tab|ziff|kap|s.|n|ст|п|пп|стр|№|क्र".split("|")
OPEN = "etc|ltd|inc|co|corp|plc|p.m|a.m|p.a|jr|sr|ens|bpk|edms|usw|gmbh|г|руб|млн|тыс".split("|")
# German month names, after which an ordinal does not end a sentence.
MONTHS = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
TERMINATORS = ".!?…؟।॥。！？．"
_WIDE = "。！？।॥"
_EVENT = re.compile(rf"[{TERMINATORS}]+|[\"＂“”„‟«»「」『』]|(?P<item>(?<=\n)[^\S\n]*(?:[(\[][a-z\d]{{1,4}}[)\]]|\d{{1,3}}[.)]|[a-z][.)]|[-•*–])(?=\s))|[()\[\]（）［］【】]")
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_PAGE = re.compile(r"(?m)(?:^|\n)[^\S\n]*--- Page \d+ ---[^\S\n]*$")
_AHEAD = re.compile(r"[\s​‌‍⁠﻿­]*")
_WORD = re.compile(r"\w+")
_INVISIBLE = "​‌‍⁠﻿­"
# marks that look alike or differ in width count as one
_MARKS = str.maketrans("＂（）［］", "\"()[]")
_CLOSES = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "]": "[", "】": "【"}
_QUOTES = set("\"＂“”„‟«»「」『』")
_LIST = "•"
_LEADS = re.compile(r"(?:[;,]|\b(?:and|or|en|of|und|oder|et|ou|и|или))\s*\Z")
_SMALL = re.compile(r"(?<![\w.])[a-zß-ÿа-яё]\w")
_SEVERAL = re.compile(r"(?:[A-ZÀ-ÞА-Я]\w*\W+){2}[A-ZÀ-ÞА-Я]")
_THAI = re.compile("[฀-๿]")
_THAI_SPACE = re.compile(r"(?<![\d\s])[^\S\n]+(?![\d\s])")


@lru_cache(maxsize=1)
def _fold_map() -> dict[str, str]:
    return {m: c[0] for c in lookalike_classes() for m in c if len(m) == 1 and len(c[0]) == 1}


def _fold(text: str) -> str:
    f = _fold_map()
    return "".join(f.get(ch, ch) for ch in text.lower() if ch not in _INVISIBLE)


@lru_cache(maxsize=1)
def abbreviation_trie() -> dict:
    """Trie over reversed, folded abbreviations; the key "" holds the kind."""
    root: dict = {}
    for kind, words in (("always", ALWAYS), ("figure", FIGURE), ("open", OPEN)):
        for w in words:
            node = root
            for ch in reversed(_fold(w)):
                node = node.setdefault(ch, {})
            node[""] = kind
    return root


def _abbreviation(text: str, dot: int, floor: int) -> str | None:
    """Kind of the longest abbreviation that ends right before the full stop at ``dot``."""
    node, i, kind = abbreviation_trie(), dot - 1, None
    fold = _fold_map()
    while i >= floor:
        ch = text[i]
        if ch in _INVISIBLE:
            i -= 1
            continue
        ch = fold.get(ch, ch).lower()
        if ch.isspace():
            ch = " "
        node = node.get(fold.get(ch, ch))
        if node is None:
            break
        i -= 1
        if "" in node:
            j = i
            while j >= floor and text[j] in _INVISIBLE:
                j -= 1
            if j < floor or not text[j].isalnum():
                kind = node[""]
    return kind


def _cased_next(text: str, at: int, end: int) -> tuple[str, bool, int]:
    """(first visible character at or after ``at`` or "", whether white space precedes it, its position)."""
    m = _AHEAD.match(text, at, end)
    j = m.end()
    gap = any(ch.isspace() for ch in m.group())
    return (text[j] if j < end else ""), gap, j


def _no_hint(text: str, start: int, stop: int, at: int, end: int) -> bool:
    """Whether the sentence from ``start`` to ``stop``, of three words or more, and what follows at ``at`` are both without small initial letters."""
    return bool(_SEVERAL.search(text, start, stop)) and not _SMALL.search(text, start, stop) and not _SMALL.search(text, at, min(at + 30, end))


def _ends_at_stop(text: str, i: int, j: int, start: int, end: int) -> bool:
    """Whether the run of terminators text[i:j], at level zero, ends the sentence that began at ``start``."""
    run = text[i:j]
    nxt, gap, at = _cased_next(text, j, end)
    if not nxt:
        return True
    if run[-1] in _WIDE:
        return True
    if run != "." and run != "．":
        if run[-1] in "!?؟":
            return not (nxt.islower() or nxt in ",;")
        return gap and not nxt.islower() and not _no_hint(text, start, i, at, end) and (nxt.isalnum() and not nxt.isnumeric() or nxt.isdigit() or nxt in _QUOTES)
    before = text[i - 1] if i > start else ""
    k = i - 1
    while before and before in _INVISIBLE and k > start:
        k -= 1
        before = text[k]
    if before.isdigit():
        if nxt.isdigit() and not gap:
            return False
        m = re.search(r"\d+\Z", text[max(start, k - 3) : k + 1])
        number = m.group()
        head = text[start : k + 1 - len(number)].strip()
        if len(number) <= 3 and not head:
            return False  # a list number
        if len(number) <= 2 and gap and text.startswith(MONTHS, at):
            return False
    if nxt.islower():
        return False
    kind = _abbreviation(text, i, start)
    if kind == "always":
        return False
    if kind == "figure" and (nxt.isdigit() or nxt.isnumeric()):
        return False
    if kind is None and before.isalpha():
        one = k - 1
        while one >= start and text[one] in _INVISIBLE:
            one -= 1
        if (one < start or not (text[one].isalnum() or text[one] == ".")) and (before.isupper() or before.islower()) and (gap or not nxt.isdigit()):
            return False  # an initial
    if kind == "open" and nxt.isupper() and _no_hint(text, start, i, at, end):
        return False
    if gap:
        return not (nxt in ",;:)" or nxt in TERMINATORS)
    if nxt in _QUOTES:
        return True
    return nxt.isupper() and (before.islower() or before.isdigit() or before in "%)٪") or (nxt.isalpha() and not nxt.isupper() and not nxt.islower() and before in "%٪")


def _ends_at_close(text: str, j: int, start: int, end: int, mark: str) -> bool:
    """Whether a quotation closed at ``j`` (position after the mark), whose text ended with a terminator, ends the sentence that began at ``start``."""
    nxt, gap, at = _cased_next(text, j, end)
    if not nxt:
        return True
    if nxt in ",;:，、；：)" or nxt in TERMINATORS or nxt.islower():
        return False
    code = ord(nxt)
    if 0x0590 <= code < 0x0E00 and nxt.isalpha():
        return False  # scripts without capitals: the quotation stands within its sentence
    if mark in "」』" or (mark == "”" and code >= 0x3000):
        return not 0x3041 <= code <= 0x3096
    return not (nxt.isupper() and _no_hint(text, start, j, at, end))


def sentence_ends(stored: str) -> list[int]:
    """Offsets after the last character of each sentence of ``stored``."""
    text = _PAGE.sub(lambda m: " " * len(m.group()), stored) if "--- Page" in stored else stored
    out: list[int] = []
    at = 0
    for m in (*_BLANK.finditer(text), None):
        stop = m.start() if m else len(text)
        if stop > at:
            _paragraph(text, at, stop, out)
        at = m.end() if m else stop
    return out


def _paragraph(text: str, start: int, end: int, out: list[int]) -> None:
    body = text[start:end]
    end = start + len(body.rstrip())
    start += len(body) - len(body.lstrip())
    if end <= start:
        return
    thai = len(_THAI.findall(body))
    if 2 * thai > len(body):
        out.extend(m.start() for m in _THAI_SPACE.finditer(text, start, end))
        out.append(end)
        return
    given_up: set[int] = set()
    ends, open_marks = _read(text, start, end, given_up)
    if open_marks:  # without these the others match
        ends, _ = _read(text, start, end, open_marks)
    out.extend(ends)


def _read(text: str, start: int, end: int, ignored: set[int]) -> tuple[list[int], set[int]]:
    """(ends of the sentences of a paragraph, positions of marks that were never closed)."""
    out: list[int] = []
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # open marks by kind, so that the stack is never searched
    begun = start
    last_stop = -1  # end of the last run of terminators inside a quotation or bracket

    def ended(j: int) -> int:
        out.append(j)
        stack.clear()  # only lists are open
        held.clear()
        while j < end and text[j].isspace():
            j += 1
        return j

    for ev in _EVENT.finditer(text, start, end):
        i, j = ev.span()
        c = text[i].translate(_MARKS)
        if ev.lastgroup == "item":
            before = text[begun:i].rstrip()
            if before.endswith((":", "：")) or held[_LIST] and _LEADS.search(before[-12:]):
                stack.append((_LIST, i))
                held[_LIST] += 1
                continue
            if i <= begun:
                continue
            # no item: a full stop at its end is one of the sentence
            if not text[j - 1] == "." or len(stack) > held[_LIST]:
                continue
            i, c = j - 1, "."
        if c in TERMINATORS:
            if len(stack) > held[_LIST]:
                last_stop = j
            elif _ends_at_stop(text, i, j, begun, end):
                begun = ended(j)
            continue
        if i in ignored:
            continue
        mate = c
        closing = c in _CLOSES or c == '"' and held[c] > 0 or c == "“" and bool(stack) and stack[-1][0] in "„‟"
        if not closing:
            if c != '"' or j < end and not text[j].isspace():  # what is followed by a space opens nothing
                stack.append((c, i))
                held[c] += 1
            continue
        if c == "“":
            mate = stack[-1][0]
        elif c != '"':
            mate = _CLOSES[c]
            if c == "”" and not held[mate]:
                mate = "„" if held["„"] else "‟"
        if not held[mate]:
            continue
        while True:
            mark, _ = stack.pop()
            held[mark] -= 1
            if mark == mate:
                break
        if len(stack) == held[_LIST] and last_stop > 0 and not text[last_stop:i].strip(_INVISIBLE + " \n\t   ") and _ends_at_close(text, j, begun, end, c):
            if c in _QUOTES or text[begun].translate(_MARKS) == mate:
                begun = ended(j)
        last_stop = -1
    if begun < end and (not out or out[-1] < end):
        out.append(end)
    return out, {i for mark, i in stack if mark != _LIST}


def sentences(items: DataFrame) -> DataFrame:
    """(item_table, item_id, sent_no, sent_start, sent_end): one row per sentence, offsets of the stored text."""
    prepare(items.sparkSession)
    names = ["item_table", "item_id", "sent_no", "sent_start", "sent_end"]
    schema = "item_table string, item_id long, sent_no int, sent_start int, sent_end int"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            no: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for r, text in enumerate(b.column(2).to_pylist()):
                at = 0
                for k, e in enumerate(sentence_ends(text)):
                    rows.append(r)
                    no.append(k)
                    starts.append(at)
                    ends.append(e)
                    at = e
                first = len(ends) - (no[-1] + 1 if no and rows[-1] == r else 0)
                for x in range(first, len(ends)):
                    starts[x] = _first_visible(text, starts[x], ends[x])
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(no, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=names
            )

    items = items.select("item_table", F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    return items.mapInArrow(split, schema)


_GAP = re.compile(r"(?:\s|(?<![^\n])--- Page \d+ ---(?=[^\S\n]*(?:\n|\Z)))*")


def _first_visible(text: str, at: int, end: int) -> int:
    return _GAP.match(text, at, end).end()
