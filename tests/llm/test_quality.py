import numpy as np

from regloom.llm.quality import RULE_FEATURES, RuleList, common_words, induce, judge, learned, text_statistics

RULES = (("junk", (("common_share", "<=", 0.3), ("words_per_line", ">=", 3.0))), ("table", (("cell_share", ">=", 0.6), ("n_lines", ">=", 2.0))), ("list", (("marked_share", ">=", 0.6),)))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")


def test_statistics(spark):
    texts = ["One two three.\n- item\n\nlast", None, "", "a\tb\tc\n1\t2\t3", "长城很好。", "word " * 50_000]
    got = {r["doc_id"]: r for r in text_statistics(docs(spark, texts), ["word"]).collect()}
    first = got[0]
    assert (first["n_words"], first["n_lines"], first["max_word_length"]) == (5, 3, 5)
    assert abs(first["mean_word_length"] - 19 / 5) < 1e-9 and abs(first["end_share"] - 1 / 3) < 1e-9 and abs(first["marked_share"] - 1 / 3) < 1e-9
    assert got[1]["n_words"] is None and got[2]["n_words"] == 0 and got[3]["cell_share"] == 1 and got[4]["n_words"] == 4
    assert got[5]["n_words"] == 50_000 and got[5]["distinct_ratio"] < 0.001
    assert got[5]["common_share"] == 1 and got[5]["bare_words"] == 50_000 and abs(got[0]["bare_char_share"] - 10 / 24) < 1e-9 and got[4]["bare_char_share"] == 0
    assert text_statistics(docs(spark, texts).limit(0), []).count() == 0


def test_common_words_are_counted_over_all_documents(spark):
    texts = ["the lamp", "The lamp the", "the x", None, "", "y"] * 2
    assert common_words(docs(spark, texts)) == ["lamp", "the"]
    assert common_words(docs(spark, texts).limit(0)) == []


def test_induction_on_noisy_labels():
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.random((n, len(RULE_FEATURES)))
    cell, mark = RULE_FEATURES.index("cell_share"), RULE_FEATURES.index("marked_share")
    truth = np.where(x[:, mark] > 0.9, "list", np.where(x[:, cell] > 0.92, "table", "prose")).astype(object)
    noisy = truth.copy()
    flip = rng.random(n) < 0.04
    noisy[flip] = rng.choice(["list", "table", "prose"], flip.sum())
    rules = induce(x, noisy)
    fresh = rng.random((n, len(RULE_FEATURES)))
    expected = np.where(fresh[:, mark] > 0.9, "list", np.where(fresh[:, cell] > 0.92, "table", "prose"))
    assert (rules.predict(fresh) == expected).mean() > 0.97
    assert induce(x, noisy) == rules
    assert (learned(x, noisy).predict(fresh) == expected).mean() > 0.98
    assert learned(x[:0], noisy[:0]).rules == ()


def test_case_expression_equals_prediction(spark):
    texts = ["It is a good lamp and we like it.", "- a\n- b\n- c\n- d", "a;b;c\n1;2;3\n4;5;6", "qzx wvk pqr zzt kkl mmn", None, "  "]
    stats = text_statistics(docs(spark, texts), []).orderBy("doc_id")
    rules = RuleList(RULES)
    rows = stats.selectExpr("*", f"{rules.case_sql()} AS kind").collect()
    for r in rows[:4]:
        x = np.array([[r[f] for f in RULE_FEATURES]], dtype=float)
        assert rules.predict(x)[0] == r["kind"]
    assert rows[4]["kind"] is None and rows[5]["kind"] == "empty"


def test_judge_learns_and_holds_out(spark):
    prose = [f"The lamp number {i} is good and we use it every day. It was cheap, so I like it." for i in range(160)]
    lists = ["Pros\n" + "\n".join(f"- thing {i} {k}" for k in range(6)) for i in range(60)]
    tables = ["qty;price;ref\n" + "\n".join(f"{i};{k};R{k}" for k in range(5)) for i in range(60)]
    texts = prose + lists + tables
    kinds = ["prose"] * 160 + ["list"] * 60 + ["table"] * 60
    labels = spark.createDataFrame([(i, "a1", k) for i, k in enumerate(kinds) if i % 2 == 0] + [(0, "a2", "junk"), (9999, "a1", "list"), (2, "a2", None)], "doc_id long, annotator string, label string")
    got = {r["doc_id"]: r["kind"] for r in judge(docs(spark, texts), labels).collect()}
    held = [i for i in range(len(texts)) if i % 2]
    assert np.mean([got[i] == kinds[i] for i in held]) > 0.97
    assert judge(docs(spark, texts), labels.limit(0)).filter("kind <> 'prose'").count() == 0
