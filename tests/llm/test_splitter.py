import random

import numpy as np
import pytest

from regloom.llm.splitter import SparseTable, boundaries, pieces, split_oversized


def test_sparse_table_equals_scan():
    rng = random.Random(1)
    for _ in range(200):
        v = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 40))])
        t = SparseTable(v)
        lo = rng.randrange(len(v))
        hi = rng.randint(lo + 1, len(v))
        best = max(range(lo, hi), key=lambda i: (v[i], i))
        assert t.argmax(lo, hi) == best


def test_pieces_cover_and_respect_limits():
    rng = random.Random(4)
    bits = ["word ", "Sentence ends. ", "\n\n", "\n", "。", "；", "x" * 30, "é́", "१ "]
    for _ in range(300):
        t = "".join(rng.choices(bits, k=rng.randint(0, 120)))
        spans = pieces(t, 100, 20)
        assert spans[0][0] == 0 and spans[-1][1] == len(t)
        assert all(0 <= e - s <= 100 for s, e in spans)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c < b < d and (10 <= b - c <= 30 or 30 < b - c < 50 and not any(b - 30 <= x <= b - 10 for x in boundaries(t)[0]))
        rebuilt = t[: spans[0][1]] + "".join(t[p[1] : q[1]] for p, q in zip(spans, spans[1:], strict=False))
        assert rebuilt == t


def test_strongest_boundary_and_rightmost_of_equals():
    t = "a" * 55 + ". " + "b" * 10 + " " + "c" * 20 + " " + "d" * 60
    assert pieces(t, 100, 0)[0] == (0, 57)  # the sentence beats the later words
    t = ("w" * 9 + " ") * 12
    assert pieces(t, 100, 0)[0] == (0, 100)
    assert pieces("x" * 250, 100, 0) == [(0, 100), (100, 200), (200, 250)]
    accent = "x" * 99 + "é" + "y" * 50
    assert pieces(accent, 100, 0)[0] == (0, 99)
    with pytest.raises(ValueError):
        pieces("x" * 200, 100, 60)


def test_earlier_boundaries_beat_a_cut_inside_a_word():
    t = "some word " * 66 + "x" * 1500 + " tail" * 100
    spans = pieces(t)
    assert spans[0] == (0, 660) and spans[1][0] < 660 and t[spans[1][0] - 1] == " " and spans[1][1] > 2160
    t = "word " * 30 + "y" * 5000 + " end " * 30
    spans = pieces(t)
    assert spans[0] == (0, 150) and spans[-1][1] == len(t) and all(e - s <= 1800 for s, e in spans)
    assert all(a < c < b < d for (a, b), (c, d) in zip(spans, spans[1:], strict=False))


def test_abbreviations_end_no_sentence():
    t = "The fund, e.g. the pool of No. 7, pays. " * 60
    for s, e in pieces(t):
        assert t[:e].rstrip().endswith("pays.") and (s == 0 or t[:s].rstrip().endswith(("pays.", ",", "pool", "fund,")))
    cuts, strength = boundaries("See e.g. No. 7 here. Then go.")
    assert [c for c, k in zip(cuts, strength, strict=True) if k == 4] == [21]


def test_table_of_windows():
    v = np.arange(5000) % 7
    t = SparseTable(v, 100)
    assert len(t.levels) == 7 and t.argmax(1000, 1100) == max(range(1000, 1100), key=lambda i: (v[i], i))


def test_operator(spark):
    rows = [("t", 1, "short", 0), ("t", 2, "word " * 1000, 0), ("t", 3, None, 0), ("t", 4, "", 0), ("t", 2, "word " * 1000, 0), ("u", 5, "x" * 1800, 0), ("u", 6, "y" * 1801, 0), ("u", 7, "z" * 300_000, 0)]
    df = spark.createDataFrame(rows, "item_table string, item_id long, text string, piece_no int")
    out = split_oversized(df).collect()
    n = {}
    for r in out:
        assert r["piece"] == next(x[2] for x in rows if x[1] == r["item_id"])[r["start"] : r["end"]]
        n[r["item_id"]] = n.get(r["item_id"], 0) + 1
    assert n == {1: 1, 2: 6, 4: 1, 5: 1, 6: 2, 7: n[7]} and n[7] > 180
    assert split_oversized(df.limit(0)).count() == 0
