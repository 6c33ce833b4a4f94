from pathlib import Path

import pytest

from regloom.llm.mixing import TOKENIZER, MinCostFlow, mix, plan_mix

needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer here")


def test_min_cost_flow():
    f = MinCostFlow(4)
    a, b = f.add(0, 1, 5, 1), f.add(0, 2, 5, 3)
    f.add(1, 3, 4, 0)
    f.add(2, 3, 9, 0)
    assert f.run(0, 3) == 9
    assert (f.edges[a ^ 1][1], f.edges[b ^ 1][1]) == (4, 5)


def test_plan():
    weights = {"a": (0.5, 1), "b": (0.3, 3), "c": (0.2, 2), "empty": (0.1, 9)}
    plan = plan_mix({("a",): 1000, ("b",): 50, ("a", "b"): 100, ("c",): 400}, weights)
    got = {}
    for (p, s), n in plan.flows.items():
        got[s] = got.get(s, 0) + n
        assert s in p
    # b has 3 * 50 of its own and up to 100 shared: 250 tokens are its quota of the whole
    assert got["b"] == 250 and abs(got["a"] - 250 / 0.3 * 0.5) <= 3 and abs(got["c"] - 250 / 0.3 * 0.2) <= 3
    assert plan_mix({}, weights).size == 0
    small = plan_mix({("a",): 1000, ("b",): 500, ("c",): 400}, weights, size=100)
    assert {s: n for (_, s), n in small.flows.items()} == {"a": 50, "b": 30, "c": 20}


@needs_tokenizer
def test_mix(spark):
    rows = [(i, "a", f"review number {i} of the big source", 1) for i in range(400)]
    rows += [(1000 + i, " B ", f"short text {i}", 1) for i in range(20)]
    rows += [(2000 + i, "c", f"review number {i} of the big source", 1) for i in range(100)]  # copies in another source
    rows += [(3000, None, "x", 1), (3001, "other", "x", 1), (3002, "a", None, 1), (3003, "a", "", 1), (3004, "b", "short text 1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.2, 4), ("c", 0.15, 2), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed, report = mix(docs, weights)
    used = {}
    for r in mixed.collect():
        used[r["doc_id"]] = used.get(r["doc_id"], 0) + r["uses"]
    assert all(n <= (4 if 1000 <= d < 2000 else 1) for d, n in used.items())
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert shares["none"] == 0 and abs(sum(shares.values()) - 1) < 1e-9
    for s, target in (("a", 0.6), ("b", 0.2), ("c", 0.15)):
        assert abs(shares[s] - target / 0.95) < 0.02
    assert sorted(map(tuple, mix(docs, weights)[0].collect())) == sorted(map(tuple, mixed.collect()))
    assert sorted(map(tuple, mix(docs, weights, seed=1)[0].collect())) != sorted(map(tuple, mixed.collect()))
    nothing, zero = mix(docs.limit(0), weights)
    assert nothing.count() == 0 and {r["tokens"] for r in zero.collect()} == {0}
