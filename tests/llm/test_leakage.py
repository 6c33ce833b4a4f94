import random

import numpy as np

from regloom.llm import leakage
from regloom.llm.leakage import RUN, leaked_passages, passages, words


def test_equal_passages_share_a_key():
    rng = random.Random(1)
    for _ in range(100):
        run = [f"w{rng.randint(0, 30)}" for _ in range(RUN)]
        a = [f"a{i}" for i in range(rng.randint(0, 9))] + run + ["x"] * rng.randint(0, 5)
        b = ["y"] * rng.randint(0, 9) + run
        text, at, key, gram = passages([" ".join(a), "", "w " * (RUN - 1), " ".join(b)])
        assert set(text) <= {0, 3} and len(text) == len(a) + len(b) - 2 * (RUN - 1)
        assert set(key[text == 0]) & set(key[text == 3]) and set(gram[text == 0]) & set(gram[text == 3])
        assert at.max() <= max(len(a), len(b)) - RUN
    assert len(passages([])[0]) == len(passages(["w " * (RUN - 1)])[0]) == 0


def test_window_minima():
    v = np.random.default_rng(1).integers(0, 99, 40)
    for width in (1, 2, 5, 8, 11):
        assert leakage._window_minima(v, width).tolist() == [v[i : i + width].min() for i in range(41 - width)]


def longest(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best, row = max(best, *new), new
    return best


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    tokens = [f"w{i}" for i in range(60)]
    items = [[rng.choice(tokens) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = []
    for _ in range(120):
        t = [rng.choice(tokens) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            i = rng.choice(items)
            n = rng.choice([8, 11, 12, 13, 30])
            at = rng.randint(0, max(0, len(i) - n))
            t[len(t) // 2 : len(t) // 2] = i[at : at + n]
        docs.append(t)
    spell = lambda t: rng.choice([" ".join, ", ".join, " ".join, lambda x: " ".join(x).upper(), lambda x: "\n- ".join(x).replace("w", "ｗ")])(t)
    rows = [(k, spell(t), 0) for k, t in enumerate(docs)] + [(500, None, 0), (501, "", 0), (502, " ".join(items[3]) * 1, 0), (502, " ".join(items[3]), 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, key int")
    e = spark.createDataFrame([(k, " ".join(t), 0) for k, t in enumerate(items)] + [(77, None, 0), (78, " ".join(items[0]), 0)], "item_no long, text string, items int")
    got = {(r["doc_id"], r["item_no"]): r for r in leaked_passages(d, e).collect()}
    truth = {}
    for k, text, _ in rows:
        for i, t in [*enumerate(items), (78, items[0])]:
            if text is not None and (n := longest(words(text), t)) >= RUN:
                truth[k, i] = n
    assert set(got) == set(truth) and len(truth) > 20
    assert all(got[k]["longest_run"] == n for k, n in truth.items())
    assert leaked_passages(d.limit(0), e).count() == 0 and leaked_passages(d, e.limit(0)).count() == 0
    monkeypatch.setattr(leakage, "SHARED_PASSAGES", 10)  # too many items to share their keys
    assert {(r["doc_id"], r["item_no"]): r for r in leaked_passages(d, e).collect()} == got
