"""Queries over whole stored texts against brute force on a small fixture."""

import re

import pytest

from regloom import queries as q
from regloom.functions import rules
from regloom.operators.clauses import page_lookup
from regloom.operators.match import token_set_ratio

TEXTS = [
    ("d", 1, "1.", "बोर्ड को जोखिम रिपोर्ट shall करनी चाहिए।\r2.1  नीति\tका पालन", "1"),
    ("d", 2, "3", "La société doit établir un contrôle strict du comité\n4.2. Überwachung\x85der Geschäfte", "2"),
    ("d", 3, "5.", "取締役会は報告しなければならない。board must report to the committee", "Unknown"),
    ("e", 1, "", "คณะกรรมการต้องรายงานความเสี่ยง" * 4, "1"),
    ("e", 2, "ต", " 　ข้อ\r\r1.2.3　ต่อ", None),
    ("f", 1, "7", None, "x"),
]
CLAUSES = [(i, *t) for i, t in enumerate(TEXTS)]
POLICIES = [
    (1, "d", 1, "Die Bank muß Überwachung regulation", "contrôle société", "1. Contrôle général regulation\r2. 3 società überwachung\t\t"),
    (2, "d", 2, "取締役会 établissement committee", "report", "方針" * 1000 + "\n10. établissement committee"),
    (3, "e", 1, "शर्तें लागू जोखिम", "", " "),
    (4, "e", 2, None, None, None),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    c = "clause_id long, doc string, sequence_no int, section string, language_from_directive string, page string"
    spark.createDataFrame(CLAUSES, c).write.parquet(f"{base}/directive_clauses.parquet")
    g = "gap_id long, doc string, sequence_no int, obligation string, language_from_directive string, corresponding_policy_text string"
    rows = spark.createDataFrame(POLICIES, g).selectExpr("*", "'1' section", "'c' obligation_category", "'r' primary_responsible_department")
    rows.write.parquet(f"{base}/gap_assessment.parquet")
    titles = spark.createDataFrame([(1, "Verfügung Nr. 5 – Größe 2011"), (2, "निर्देश Directive 7.A"), (3, None)], "seq int, title string")
    titles.write.parquet(f"{base}/directives.parquet")
    return str(base)


def run(spark, sf, name):
    return [tuple(r) for r in q.queries()[name](spark, sf).collect()]


def documents():
    docs = {}
    for _, doc, _, section, text, _ in CLAUSES:
        docs.setdefault(doc, []).append(f"{section} {text or ''}")
    return {d: "\n".join(t) for d, t in docs.items()}


def split_clauses(text):
    lines = [re.sub(r"\s+", " ", x.strip()) for x in text.replace("\r", "\n").split("\n")]
    text = "\n".join(lines)
    found = list(re.finditer(r"(?m)^\s*((?:\d+\.)+\d*)\s+(?=\S)", text))
    if not found:
        return [("Introduction", text.strip())]
    rows = [("Introduction", text[: found[0].start()].strip())]
    for m, after in zip(found, [*found[1:], None]):
        rows.append((m.group(1).rstrip("."), text[m.end() : after.start() if after else len(text)].strip()))
    return [r for r in rows if r[1]]


def split_policy(text):
    parts = iter(re.split(r"(?:^|\n+)--- Page (\d+) ---\n", text.strip()))
    next(parts)
    out = []
    for page, body in zip(parts, parts):
        body = re.sub(r"[ \t]+", " ", body.replace("\r", "\n"))
        heads = [m.start() for m in re.finditer(r"(?m)^\s*(\d+)\.\s+", body)]
        cuts = [body[i:j] for i, j in zip([0, *heads], [*heads, len(body)])]
        for k, c in enumerate(cuts):
            c = c.strip() if heads else c
            long = not heads or (k > 0 and len(c) > 1800)
            out += [(page, x.strip()) for x in ([c[i : i + 1800] for i in range(0, len(c), 1800)] if long else [c]) if x.strip()]
    return out


def chunks():
    docs = {}
    for _, doc, n, _, _, text in POLICIES:
        if (text or "").strip():
            docs.setdefault(doc, []).append(f"--- Page {n} ---\n{text}")
    return {d: split_policy("\n".join(t)) for d, t in docs.items()}


def terms(text):
    return [w for w in re.findall(r"[A-Za-z][A-Za-z-]{3,}", text.lower()) if w not in rules.STOPWORDS][:35]


def test_clause_breakdown(spark, sf):
    got = sorted((r[0], r[1], r[2], r[3]) for r in run(spark, sf, "clause_breakdown"))
    want = sorted((d, i + 1, *row) for d, t in documents().items() for i, row in enumerate(split_clauses(t)))
    assert got == want and len(got) > 6


def test_texts_reach_the_register(spark, sf):
    assert dict(run(spark, sf, "keyword_terms")) == {i: " ".join(terms(t or "")) for i, _, _, _, t, _ in CLAUSES}
    got = {r[0]: r[2] for r in run(spark, sf, "obligation_register")}
    assert "Insurers must address the requirement described in section 1.: " + " ".join(TEXTS[0][3].split()) == got[0]


def test_policy_chunks(spark, sf):
    got = sorted(run(spark, sf, "policy_chunks"))
    assert got == sorted((d, i + 1, *c) for d, cs in chunks().items() for i, c in enumerate(cs))


@pytest.mark.parametrize("name", ["hybrid_best_match", "keyword_best_match"])
def test_matching(spark, sf, name):
    got = {r[0]: r[-3:] for r in run(spark, sf, name)}
    for gap, doc, _, obligation, language, _ in POLICIES:
        search = f"{obligation or ''} {language or ''}"
        best = (0.0, 0.0, "Not located", None)
        for page, text in chunks().get(doc, []):
            share = sum(t in text.lower() for t in terms(search)) / max(len(terms(search)), 1)
            score = share * 0.68 + token_set_ratio(search[:1000], text[:1600]) / 100 * 0.32 if name.startswith("hybrid") else share
            if score > best[0]:
                best = (score, share, page, text)
        assert got[gap][0] == pytest.approx(best[1]) and got[gap][1] == best[2], gap
        assert best[3] is None or got[gap][2] == best[3]


def test_pages_of_unknown_number(spark, sf):
    pieces = {}
    for doc, at, text in sorted(run(spark, sf, "page_render")):
        pieces.setdefault(doc, []).append(text)
    got = {d: "".join(t) for d, t in pieces.items()}
    assert got["d"] == f"{TEXTS[2][3]}\n\n--- Page 1 ---\n{TEXTS[0][3]}\n\n--- Page 2 ---\n{TEXTS[1][3]}" and len(pieces["d"]) == 3
    assert got["e"] == f"{TEXTS[4][3]}\n\n--- Page 1 ---\n{TEXTS[3][3]}".strip() and got["f"] == ""
    pages = spark.createDataFrame([("d", None, "committee report"), ("d", 2, "report")], "doc string, page int, text string")
    asked = spark.createDataFrame([(1, "d", "committee"), (2, "d", "report"), (3, "d", "nothing")], "query_id long, doc string, query string")
    assert sorted(map(tuple, page_lookup(pages, asked).collect())) == [(1, "Unknown"), (2, "2"), (3, "Not located")]


def test_character_recognition_is_judged_by_document(spark, sf):
    texts = {d: [(t or "").strip() for _, doc, _, _, t, _ in CLAUSES if doc == d] for d in "def"}
    assert dict(run(spark, sf, "ocr_candidates")) == {d: len(" ".join(t)) < 80 for d, t in texts.items()} == {"d": False, "e": False, "f": True}


def test_titles(spark, sf):
    assert sorted(run(spark, sf, "safe_names"))[0][1:3] == ("Verf_gung_Nr. 5 _ Gr_e 2011", "2011")
