from collections import Counter

from regloom.llm import scan_noise
from regloom.llm.scan_noise import Vocabulary, repair, repair_scans

WORDS = "the board must report and keep every modern record before the board of Wenmar holds against support third party third-party settlement tested turnover form from claim model duties records policy v4".split()
COUNTS = {w: 400 for w in WORDS} | {"must": 5000, "the": 9000, "miist": 3, "Wenmor": 30, "in": 900, "day": 300, "to": 900, "rnodern": 1, "aga": 2, "inst": 2, "sup": 2}
V = Vocabulary(COUNTS, frozenset({"* policy v4 #"}))


def kinds(text, titles=()):
    return repair(text, V, titles)[1]


def test_faults():
    assert repair("The board must re-\nport and keep.", V) == ("The board must report and keep.", ["broken word"])
    assert repair("the board must sup¬\nport the record", V)[0] == "the board must support the record"
    assert repair("the board must sett\nlement record", V) == ("the board must settlement record", ["broken word"])
    assert repair("the b0ard rnust miist report aga inst the record^ kept", V)[0] == "the board must must report against the record kept"
    assert repair("keep\n- 7 -\nthe record", V) == ("keep the record", ["page number"])
    for number in ("Page 3 of 12", "p. 4", "P a g e  6", "Bladsy 3", "3/12", "[12]", "(iv)", "7"):  # at a page edge
        assert kinds(f"keep\n\n{number}\n\nthe record") == ["page number"], number
    assert repair("keep the rec-\n\nPage 2\n\nord before", V)[0] == "keep the record before"
    assert kinds("Directive 5 on the modern record | 3\nkeep the record") == ["running header"]
    assert kinds("ZENMAR POLICY V4.2\nkeep the record") == ["running header"]
    assert kinds("keep\nDIRECTIVE ON THE MODERN RECORD\nthe record", ["Directive on the modern record and claim"]) == ["running header"]


def test_numbers_that_are_no_page_numbers_stay():
    for text in ("kept in\n2012\nthe board", "keep\n(iv)\nthe record", "keep\n[12]\nthe record", "keep\n3/12\nthe record"):
        assert repair(text, V) == (text.replace("\n", " "), []), text
    assert repair("kept in\n\n2012\n\nthe board", V, page=3)[0] == "kept in\n\n2012\n\nthe board"
    assert repair("keep\n3\nthe record", V, page=3) == repair("keep\n[2]\nthe record", V, page=3) == ("keep the record", ["page number"])
    assert repair("keep\n(iv)\nthe record", V, scanned=True) == ("keep the record", ["page number"])
    assert repair("keep:\n(iv)\nthe record", V, scanned=True)[1] == [] == repair("kept in\n2012\nthe board", V, scanned=True)[1]
    assert repair("[2]\n7", V, scanned=True)[0] == ""
    assert repair("keep\n[2]\nthe record", V, scanned=True)[0] == "keep the record"


def test_a_single_slip_is_no_scan():
    assert repair("the board rnust report", V, scanned=False) == ("the board rnust report", [])
    assert repair("the board rnust report rnodern", V, scanned=False)[1] == ["misread characters"]
    assert repair("the board rnust report", V, scanned=True)[0] == "the board must report"


def test_a_lost_accent_is_no_misreading():
    v = Vocabulary(COUNTS | {"Gorgaper": 109, "Gorgöper": 90, "Dregaxa": 400})
    assert repair("Gorgoper and Dregoxa", v)[0] == "Gorgoper and Dregaxa"


def test_every_reported_fault_is_repaired():
    v = Vocabulary(COUNTS | {"obligation": 300, "secured": 200})
    assert repair("OBLIGAT1ON re5ord", v) == ("OBLIGATION resord", ["misread characters"])


def test_frequencies_count_by_their_ratio():
    for scale in (1, 100):
        v = Vocabulary({w: n * scale for w, n in (COUNTS | {"Wenmar": 1500, "Wenmor": 40}).items()})
        assert repair("Wenmor", v)[1] == []


def test_no_faults():
    for text in ("", "plain text", "the board\nmust report\n\n--- Page 2 ---\n\nthe record", "Duties of the board\n\nkeep", "a third-\nparty record", "SCHEDULE 12\n\nkeep", "by 4 p.m. in 2011.\nkeep", "Wenmor keeps Wenmar"):
        assert kinds(text) == [], text
    assert repair("(a) keep;\n(b) report; and\nhold", V)[0] == "(a) keep;\n(b) report; and hold"


def test_long_text_and_unicode():
    text = "the board must report " * 30_000
    assert repair(text, V)[1] == []
    assert kinds("тhе bоard must кeep ​the rec­ord") == []


def test_operator_learns_from_the_corpus(spark):
    sentence = "the board must report every settlement before the modern record"
    rows = [("t", i, "d", sentence, None, None) for i in range(300)]
    rows += [("t", 900, "d", "the board rnust report every sett-\nlement", None, None), ("t", 901, "d", None, None, None), ("t", 902, None, "", None, None), ("t", 903, "d", "Directive about the record\nthe board must report", None, None)]
    df = spark.createDataFrame(rows, "item_table string, item_id long, doc string, text string, titles string, faults string")
    titles = spark.createDataFrame([("d", "Directive about the record of boards"), ("d", None), (None, "x")], "doc string, title string")
    got = {r["item_id"]: (r["repaired"], r["faults"]) for r in repair_scans(df, titles).collect()}
    assert got[900] == ("the board must report every settlement", ["broken word", "misread characters"])
    assert got[901] == (None, []) and got[902] == ("", []) and got[0] == (sentence, [])
    assert got[903] == ("the board must report", ["running header"])
    assert repair_scans(df.limit(0), titles).count() == 0
    assert len(got) == 304 and Counter(bool(f) for _, f in got.values())[True] == 2


def test_lines_repeated_at_page_edges_are_heads(spark):
    words = "the board must report every settlement before the modern record"
    rows = [("t", i, "d", f"{words}\nStrictly confidential paper of directors\n\nPage {i}\n\nheld before", i) for i in range(1, 5)] + [("t", 9, "d", f"Strictly confidential papers of directors\n{words}", 9), ("t", 10, "e", f"Strictly confidential paper of directors\n{words}", 1)]
    rows += [("t", 20 + i, "f", words, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "item_table string, item_id long, doc string, text string, page int")
    got = {r["item_id"]: r["repaired"] for r in repair_scans(df).collect()}
    assert got[1] == f"{words} held before" and got[9] == words and got[10].startswith("Strictly")


def test_rare_words_do_not_depend_on_the_size(spark, monkeypatch):
    rows = ["the board must report every record"] * 700 + ["a settlement of Wenmarfund in Benmarfund"] * 40 + ["the settlernent Wenmorfund and Benmorfund stand"] + ["Benmorfund stands"] * 11
    rows += ["Quarter ledger annex | 3\nthe board must report"] * 9 + ["Quarter ledger annex\nthe board", "every sett-\nlement", "a sett\nlement", "the settle ment report"]
    df = spark.createDataFrame([("t", i, None, x) for i, x in enumerate(rows)], "item_table string, item_id long, doc string, text string")

    def run():
        return {rows[r["item_id"]]: (r["repaired"], r["faults"]) for r in repair_scans(df).collect()}

    small = run()
    monkeypatch.setattr(scan_noise, "SHARED", 12)  # the frequent words fit, the rare ones do not
    assert small == run()
    monkeypatch.setattr(scan_noise, "SHARED", 5)  # as in a corpus many times as large
    large = run()
    assert small == large
    assert large["the settlernent Wenmorfund and Benmorfund stand"][0] == "the settlement Wenmorfund and Benmorfund stand"
    assert large["Quarter ledger annex\nthe board"] == ("the board", ["running header"])
    assert large["every sett-\nlement"][0] == "every settlement" and large["the settle ment report"][0] == "the settlement report"


def test_rare_words_are_judged_by_their_number(spark):
    rows = ["the settlement is due"] * 40 + ["the settlernent is due"] * 6
    df = spark.createDataFrame([("t", i, None, x) for i, x in enumerate(rows)], "item_table string, item_id long, doc string, text string")
    assert all(not r["faults"] for r in repair_scans(df).collect())  # 40 is less than eight times 6
