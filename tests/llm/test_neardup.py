import random
from collections import Counter

import numpy as np
import pytest

from regloom.llm import neardup
from regloom.llm.neardup import NearDuplicates, connected_components, words


def dice(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def corpus(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(12, 80))
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 14))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(t)
            rows.append(" ".join(t))
    return rows


def frame(spark, texts, table="t"):
    return spark.createDataFrame([(table, i, t, 0) for i, t in enumerate(texts)], "item_table string, item_id long, text string, n int")


def expected(texts):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] is not None and texts[j] is not None and dice(texts[i], texts[j]) >= 0.8 - 1e-9}


def test_pairs_equal_brute_force(spark):
    texts = corpus(1, 60, 5) + [None, "", "!!", "One two three", "one, TWO thrее", "a " * 30_000, "a " * 30_001] + ["same words here"] * 4
    found = NearDuplicates(frame(spark, texts))
    got = {(r["id_a"], r["id_b"]) for r in found.row_pairs().collect()}
    truth = expected(texts)
    assert got <= truth
    assert len(got) >= 0.99 * len(truth)
    again = NearDuplicates(frame(spark, texts)).row_pairs().collect()
    assert {(r["id_a"], r["id_b"]) for r in again} == got and len(again) == len(got)


def test_groups_follow_from_pairs(spark):
    texts = corpus(2, 25, 4) + ["x y z"] * 3 + [None]
    found = NearDuplicates(frame(spark, texts))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found.row_pairs().collect():
        a, b = sorted((root(r["id_a"]), root(r["id_b"])))
        parent[b] = a
    rows = found.groups().collect()
    assert len(rows) == len(texts) - 1
    for r in rows:
        assert r["group_id"] == root(r["item_id"])


def test_large_nodes_lose_nothing(spark, monkeypatch):
    texts = [" ".join(f"w{i}" for i in range(30)) + f" x{k}" for k in range(40)]
    monkeypatch.setattr(neardup, "NODE_PAIRS", 8)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    got = NearDuplicates(frame(spark, texts)).row_pairs().count()
    assert got == 40 * 39 // 2


def test_prefix_is_shortened_until_the_recall(spark):
    words_ = [f"w{i}" for i in range(60)]
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        base = rng.sample([f"{w}{rng.randint(0, 9)}" for w in words_], 40)
        other = list(base)
        for i in rng.sample(range(40), 7):
            other[i] = f"z{rng.randint(0, 10**6)}"
        texts += [" ".join(base), " ".join(other)]
    found = NearDuplicates(frame(spark, texts))
    assert found.depth < neardup.DEPTH
    assert found.recall >= neardup.TARGET_RECALL
    got = {(r["id_a"], r["id_b"]) for r in found.row_pairs().collect()}
    assert got == expected(texts)


def test_detection_is_that_of_the_trees():
    rng = random.Random(5)
    left, right = [], []
    for _ in range(1500):
        base = [f"v{rng.randint(0, 10**9)}" for _ in range(50)]
        left.append(" ".join(base))
        right.append(" ".join(base[:42] + [f"z{rng.randint(0, 10**9)}" for _ in range(8)]))
    salt = np.zeros(1500, np.uint64)
    x, y = (neardup._paths(neardup.signatures(t)["sig"], salt) for t in (left, right))
    for depth in (8, 6):
        found = ((x ^ y) & neardup._mask(depth) == 0).any(axis=1).mean()
        assert abs(neardup._detected(np.array([0.84]), depth)[0] - found) < 0.016
    assert neardup._detected(np.array([0.84]), 8)[0] < 0.97


def test_recall_of_pairs_of_classes_and_of_rows(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0), (2, 3, 0.84)], "a long, b long, dice double")
    classes = spark.createDataFrame([(0, 1), (1, 1), (2, 30), (3, 20)], "cid long, copies long")
    overlaps = neardup._overlaps(pairs, classes)
    assert sorted(map(tuple, overlaps)) == [(0.84, 1, 600), (1.0, 1, 1)]
    assert neardup._estimated_recall(overlaps, 8) < 0.97
    assert neardup._estimated_recall(overlaps, 4, 8) > neardup._estimated_recall(overlaps, 6, 8) > 0.99


def test_signatures_do_not_depend_on_the_batch():
    texts = [f"a b c {i} " * (1 + i % 7) for i in range(50)] + ["", "long " * 50_000 + "tail"]
    together = neardup.signatures(texts)["sig"]
    for i in (0, 13, 49, 50, 51):
        assert (neardup.signatures([texts[i]])["sig"][0] == together[i]).all()


def test_long_bitmaps_are_an_exact_bound():
    """Pairs well under the limit go by their parities, whatever their lengths; no pair at the limit does."""
    rng = np.random.default_rng(7)
    for n in (1, 3, 20, 300, 5000):
        for share in (0.0, 0.4, 0.7, 0.75, 0.8, 0.9, 1.0):
            for m in (n, n + n // 3):
                common = min(int(share * (n + m) / 2), n)
                pool = np.unique(rng.integers(0, 2**63, n + m - common, dtype=np.uint64))
                x, y = pool[rng.permutation(len(pool))][:n], None
                y = np.concatenate([x[:common], np.setdiff1d(pool, x)])
                apart = neardup.parity_distance(neardup.parity(x), neardup.parity(y))
                assert apart == neardup.parity_distance(neardup.parity(y), neardup.parity(x)) <= len(np.setxor1d(x, y))
                if n >= 300 and share <= 0.7:
                    assert apart > 0.2 * (len(x) + len(y))


def test_multisets_of_pairs_under_the_limit_are_not_joined(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:cut] + [f"x{k}_{i}" for i in range(300 - cut)]) for k, cut in enumerate([300] + [rng.randint(195, 210) for _ in range(20)] + [280])]
    elements = [neardup.element_arrays([t])[0] for t in texts]
    sets = spark.createDataFrame([(k, len(e), neardup.parity(e)) for k, e in enumerate(elements)], "cid long, n int, parity binary")
    pairs = spark.createDataFrame([(i, j) for j in range(len(texts)) for i in range(j)], "a long, b long")
    got = {tuple(r) for r in neardup._close(pairs, sets, 0.8).collect()}
    assert expected(texts) == {(0, 21)} == got


def test_an_unreachable_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MIN_DEPTH", 8)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join([f"g{g}{w}" for w in base[: 50 - k]] + [f"z{g}{i}" for i in range(k)]) for g in range(12) for k in (0, 8)]
    with pytest.raises(RuntimeError):
        NearDuplicates(frame(spark, texts))


def test_hot_class_is_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    base = " ".join(f"w{i}" for i in range(30))
    texts = [base] * 23 + [base + " x"] * 7 + [base + " y"]
    rows = [tuple(r) for r in NearDuplicates(frame(spark, texts)).row_pairs().select("id_a", "id_b").collect()]
    assert len(rows) == len(set(rows)) == 31 * 30 // 2


def test_tables_do_not_mix_and_empty_input(spark):
    df = frame(spark, ["a b c d e f"]).unionByName(frame(spark, ["a b c d e f"], "u"))
    assert NearDuplicates(df).row_pairs().count() == 0
    nothing = NearDuplicates(df.limit(0))
    assert nothing.row_pairs().count() == 0 and nothing.groups().count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_incomplete_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=2)
