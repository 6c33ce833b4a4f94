"""Documents that come in pieces, with blocks small enough that every document has several."""

import random
import re

import pytest
from pyspark.sql import functions as F

from regloom.operators import clauses as cl
from regloom.operators import match, policy
from regloom.operators.running import running


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.randint(0, 3), rng.choice([None, None, f"m{i}"]), rng.random() < 0.1) for d in "abc" for i in rng.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "doc string, at long, n long, mark string, flag boolean")
    got = running(df, "doc", ["at"], F.floor(F.col("at") / 7), {"sum": F.col("n")}, {"seen": F.col("mark")}, {"more": F.col("flag")}).collect()
    assert len(got) == len(rows)
    for r in got:
        before = sorted(x for x in rows if x[0] == r["doc"] and x[1] < r["at"])
        assert r["sum"] == sum(x[2] for x in before)
        assert r["seen"] == next((x[3] for x in reversed(before) if x[3]), None)
        assert r["more"] == any(x[4] for x in rows if x[0] == r["doc"] and x[1] > r["at"])
    assert running(df.limit(0), "doc", ["at"], F.lit(0), {"sum": F.col("n")}).count() == 0


@pytest.mark.parametrize("block", [1, 3])
def test_clauses_of_documents_in_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(cl, "BLOCK_ROWS", block)
    rng = random.Random(4)
    bits = ["1. ", "2.1", "2.1 x", "\n", "\n\n", "3.4.\n", "word ", "--- Page 3 ---\n", "\n--- Page 4 ---\n", "\r", "  ", "7.", " ", "--- Page 9 ---"]
    docs = [["".join(rng.choices(bits, k=rng.randint(0, 5))) for _ in range(rng.randint(1, 9))] for _ in range(120)] + [["", ""], ["1.", "2.", " "], ["1.", "", "x"]]
    pieces = spark.createDataFrame([(i, k, t) for i, d in enumerate(docs) for k, t in enumerate(d)], "doc long, at long, text string")
    whole = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "doc long, text string")
    got = sorted(map(tuple, cl.clauses(pieces, glue="\n").collect()))
    assert got == sorted(map(tuple, cl.clauses(whole).collect()))
    for i, d in enumerate(docs):
        text = "\n".join(re.sub(r"\s+", " ", x.strip()) for x in "\n".join(d).replace("\r", "\n").split("\n"))
        found = list(re.finditer(r"(?m)^\s*((?:\d+\.)+\d*)\s+(?=\S)", text))
        sections = ["Introduction"] + [m.group(1).rstrip(".") for m in found]
        words = [text[a:b].strip() for a, b in zip([0, *[m.end() for m in found]], [*[m.start() for m in found], len(text)], strict=True)]
        want = [(s, w) for s, w in zip(sections, words, strict=True) if w or len(words) == 1]
        assert [(r[2], r[3]) for r in got if r[0] == i] == want, d


def test_rendered_pages_are_the_document(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK_ROWS", 2)
    rng = random.Random(6)
    docs = [[(rng.choice([None, n]), rng.choice(["", " ", "a\n", "\n b ", "1. x"])) for n in range(1, rng.randint(2, 9))] for _ in range(150)]
    pages = spark.createDataFrame([(i, p, k, t) for i, d in enumerate(docs) for k, (p, t) in enumerate(d)], "doc long, page int, k long, text string")
    pieces = cl.render_pages(pages, ["k"])
    got = {r["doc"]: r["text"] for r in cl.whole_documents(pieces).collect()}
    for i, d in enumerate(docs):
        parts = [f"\n\n{t}" for p, t in d if p is None] + [f"\n\n--- Page {p} ---\n{t}" for p, t in d if p is not None]
        assert got[i] == "".join(parts).strip(), d
    whole = spark.createDataFrame([(i, t) for i, t in got.items()], "doc long, text string")
    assert sorted(map(tuple, cl.clauses(pieces).collect())) == sorted(map(tuple, cl.clauses(whole).collect()))


def test_chunks_of_policies_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(policy, "BLOCK_ROWS", 2)
    rng = random.Random(8)
    bits = ["1. ", "2. Head", "\n", "word ", "\r", "\t", "long" * 5, "10.\n   2. x"]
    docs = [[f"--- Page {k} ---\n" + "".join(rng.choices(bits, k=9)) + "end" for k in range(rng.randint(1, 7))] for _ in range(60)]
    pieces = spark.createDataFrame([(i, k, t) for i, d in enumerate(docs) for k, t in enumerate(d)], "policy long, k long, text string")
    whole = spark.createDataFrame([(i, "\n".join(d)) for i, d in enumerate(docs)], "policy long, text string")
    assert sorted(map(tuple, policy.chunk_policies(pieces, 12, ["k"]).collect())) == sorted(map(tuple, policy.chunk_policies(whole, 12).collect()))


def test_bounds_hold():
    rng = random.Random(9)
    words = ["board", "exit", "plan", "Risk", "annual", "é", "取締役会", "a", "of", "the"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(60)]
    q, c = match._Texts(texts[:25]), match._Texts(texts[25:])
    bound = match._similarity_bounds(q, c)
    for i, a in enumerate(q.texts):
        for j, b in enumerate(c.texts):
            assert match.token_set_ratio(a, b) / 100 <= bound[i, j] + 1e-9, (a, b)
