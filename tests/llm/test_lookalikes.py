import random
import re
import unicodedata
from collections import defaultdict

from regloom.llm.lookalikes import Rewriter, canonical_forms, lookalike_classes, lookalike_pairs, plain_rewriter, representatives


def test_classes_are_transitive():
    of = {m: c for c in lookalike_classes() for m in c}
    assert {"A", "Α", "А", "Ａ"} <= set(of["A"])
    assert {"é", "é", "е́", "ｅ́"} <= set(of["é"])
    assert of["ё"] == of["ë"] and " " in of[" "] and of["ﬁ"] == of["fi"]
    assert "1" not in of.get("l", ()) and "e" not in of["é"]
    assert len({m for c in lookalike_classes() for m in c}) == sum(map(len, lookalike_classes()))


SAME = [
    ("Fund", "Ｆund"), ("café", "café"), ("café", "cafе́"), ("a b", "a b"), ("soft", "so­ft"), ("zero", "ze​ro"), ("risk-based", "risk‑based"), ("finance", "ﬁnance"),
    ("März", "Мärz"), ("März", "Ｍａ̈rz"), ("12%", "１２％"), ("", "​"), ("Осмотр", "Oсмoтp"),
]
OTHER = [("a", "A"), ("é", "e"), ("m²", "m2"), ("½", "1/2"), ("a b", "a  b"), ("a\nb", "a b"), ("“a”", '"a"'), ("(a)", "[a]"), ("l", "1"), ("क्ष", "क्‍ष"), ("a;", "a,")]


def test_same_and_different():
    f = plain_rewriter()
    for a, b in SAME:
        assert f(a) == f(b), (a, b)
    for a, b in OTHER:
        assert f(a) != f(b), (a, b)


def test_representative_is_the_most_frequent():
    assert representatives({"А": 5, "A": 4})["A"] == "А"
    assert representatives({"A": 4, "А": 4})["А"] == "A"
    assert Rewriter(representatives({"ﬁ": 9}))("fine ﬁne") == "ﬁne ﬁne"


def test_idempotent_on_random_text():
    rng = random.Random(0)
    chars = "aAeé" + "аАΑοο" + "́̈​‌­ ﬁ" + "ｆｉ१क्"
    for _ in range(500):
        t = "".join(rng.choices(chars, k=rng.randint(0, 20)))
        once = plain_rewriter()(t)
        assert plain_rewriter()(once) == once
        assert plain_rewriter()(unicodedata.normalize("NFC", t)) == once


def items(spark, rows):
    return spark.createDataFrame(rows, "item_table string, item_id long, text string, raw string")


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["fine fund", "café", "", "x", "Осмотр"]
    rows = []
    for i in range(200):
        t = rng.choice(base)
        for a, b in (("a", "а"), ("fi", "ﬁ"), ("é", "é"), (" ", " "), ("x", "х")):
            if rng.random() < 0.3:
                t = t.replace(a, b)
        rows.append((rng.choice("st"), i, t if i % 40 else None, "clash"))
    rows += [("s", 900, "word " * 40_000, "c"), ("s", 901, "word " * 40_000, "c")]
    got = {tuple(r) for r in lookalike_pairs(items(spark, rows)).collect()}
    f, groups = plain_rewriter(), defaultdict(list)
    for table, i, t, _ in rows:
        if t is not None:
            groups[table, f(t)].append((i, t))
    expected = {(k[0], a, b) for k, g in groups.items() for a, x in g for b, y in g if a < b and x != y}
    assert got == expected and ("s", 900, 901) in got
    assert lookalike_pairs(items(spark, rows).limit(0)).count() == 0


def test_hot_look_is_split(spark, monkeypatch):
    from regloom.llm import lookalikes

    monkeypatch.setattr(lookalikes, "SPLIT_ROWS", 10)
    rows = [("s", i, "ab" if i % 2 else "аb", "c") for i in range(60)]
    assert lookalike_pairs(items(spark, rows)).count() == 900


def test_forms_beyond_the_limit_do_not_reach_the_driver(spark, monkeypatch):
    """The planner goes by file sizes, which do not grow with the blocks of a hot look."""
    from regloom import joins
    from regloom.llm import lookalikes

    monkeypatch.setattr(lookalikes, "SPLIT_ROWS", 4)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    rows = [("s", i, "a" + "\u200b" * i, "c") for i in range(30)]
    pairs = lookalike_pairs(items(spark, rows))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[item_table#\d+, look#\d+, block#", plan)
    assert pairs.count() == 30 * 29 // 2


def test_canonical_passes_columns_and_nulls(spark):
    rows = [("s", 1, "аbc abc abc", "r"), ("s", 2, None, "r"), ("s", 3, "abc", None)]
    out = canonical_forms(items(spark, rows), "text", output="raw").collect()
    assert [r["raw"] for r in out] == ["abc abc abc", None, "abc"]
