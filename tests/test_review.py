"""Policy chunks, matching, coverage."""

import random
import re

from regloom.functions.rules import STOPWORDS
from regloom.operators import coverage as cov
from regloom.operators.match import NO_MATCH, _lcs, hybrid_match, keyword_match, token_set_ratio
from regloom.operators.policy import chunk_policies
from regloom.plans.pipelines import review


def expected_chunks(raw, size):
    parts = re.split(r"(?:^|\n+)--- Page (\d+) ---\n", raw.strip())
    if len(parts) == 1:
        parts = ["", "Unknown", raw]
    out = []
    for page, text in zip(parts[1::2], parts[2::2], strict=True):
        t = re.sub(r"[ \t]+", " ", text.replace("\r", "\n"))
        starts = [m.start() for m in re.finditer(r"(?m)^\s*(\d+)\.\s+", t)]
        sections = [t[a:b].strip() for a, b in zip(starts, [*starts[1:], len(t)], strict=True)] if starts else []
        texts = [t[: starts[0]].strip()] if starts else [t[i : i + size].strip() for i in range(0, len(t), size)]
        for s in sections:
            texts += [s[i : i + size].strip() for i in range(0, len(s), size)] if len(s) > size else [s]
        out += [(page, x) for x in texts if x]
    if not out and raw.strip():
        out = [("Unknown", raw.strip()[:size])]
    return out


def test_chunks(spark):
    rng = random.Random(5)
    bits = ["1. ", "2. Head", "1.1 x", "\n", "\n\n", "word ", "--- Page 3 ---\n", "\n--- Page 4 ---\n", "\r", "  ", "\t", "long" * 5, "10.\n   2. x"]
    texts = ["", "  ", "plain", "--- Page 1 ---", "x\n--- Page 2 ---\nonly"] + ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(250)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "policy long, text string")
    got = {}
    for r in chunk_policies(frame, 12).orderBy("policy", "chunk_seq").collect():
        got.setdefault(r["policy"], []).append((r["page"], r["text"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == expected_chunks(t, 12), repr(t)
    assert 9999 not in got


def test_token_set_ratio():
    assert round(token_set_ratio("a b", "a c"), 3) == 66.667
    assert token_set_ratio("a b c", "b a") == 100
    assert token_set_ratio("", "a") == token_set_ratio("A", "a") == 0
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert _lcs(a, b) == row[-1]


def expected_match(obligation, wording, chunks):
    search = f"{obligation} {wording}"
    terms = [w for w in re.findall(r"[A-Za-z][A-Za-z-]{3,}", search.lower()) if w not in STOPWORDS][:35]
    best = (0.0, 0.0, "Not located", NO_MATCH)
    for page, text in chunks:
        kw = sum(t in text.lower() for t in terms) / max(len(terms), 1)
        score = kw * 0.68 + token_set_ratio(search[:1000], text[:1600]) / 100 * 0.32
        if score > best[0]:
            best = (score, kw, page, text)
    return best


def test_matching_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["board", "approval", "outsourcing", "exit", "plan", "monitor", "risk", "annual", "independent", "review", "Cloud", "data"]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(p, k, str(k), sentence(rng.randint(1, 9))) for p in ("p", "q") for k in range(1, 12)] + [("p", 12, "9", sentence(3))]
    register = [(i, rng.choice(["p", "q", "none", None]), sentence(4), sentence(6) if i % 5 else None, "c", "d") for i in range(60)] + [(60, "p", "", "", "c", "d")]
    r = spark.createDataFrame(register, "seq int, policy string, obligation string, language_from_directive string, obligation_category string, primary_responsible_department string")
    c = spark.createDataFrame(chunks, "policy string, chunk_seq int, page string, text string")
    got = {x["seq"]: x for x in hybrid_match(r, c).collect()}
    for seq, policy, obligation, wording, *_ in register:
        search = expected_match(obligation, wording or "", [(p, t) for q, _, p, t in chunks if q == policy])
        x = got[seq]
        if wording is None:  # a missing wording adds no space
            continue
        assert (round(x["score"], 9), round(x["keyword_score"], 9), x["match_page"], x["match_text"]) == (round(search[0], 9), round(search[1], 9), *search[2:])
    assert len(got) == 61
    assert keyword_match(r, c.limit(0)).filter("match_page = 'Not located'").count() == 61


def test_coverage_branches(spark):
    rows = [
        (1, 0.9, 0.9, "note", "background context", "x"), (2, 0.9, 0.9, "notify us", "", "this is not defined"), (3, 0.9, 0.9, "keep", "", "this is Not Defined"), (4, 0.56, 0.34, "a", "b", "c"),
        (5, 0.56, 0.33, "a", "b", "c"), (6, 0.27, 0.0, "a", "b", "c"), (7, 0.0, 0.18, "a", "b", "c"), (8, 0.26, 0.17, "a", "b", "c"),
    ]
    df = spark.createDataFrame([(*r[:5], r[5], "7") for r in rows], "seq int, score double, keyword_score double, obligation string, language_from_directive string, match_text string, match_page string")
    got = {r["seq"]: r for r in cov.assess(df).collect()}
    assert [got[i]["coverage_status"] for i in range(1, 9)] == [cov.NOT_APPLICABLE, cov.MISSING, cov.PARTIAL, cov.COVERED, cov.PARTIAL, cov.PARTIAL, cov.PARTIAL, cov.MISSING]
    assert [got[i]["policy_page"] for i in (1, 2, 4, 8)] == ["Not applicable", "7", "7", "Not located"]
    assert [got[i]["priority"] for i in (1, 2, 3, 4)] == ["Low", "High", "Medium", "Low"]
    assert got[8]["corresponding_policy_text"] == NO_MATCH and got[1]["corresponding_policy_text"] == cov.NO_EVIDENCE_NEEDED
    assert got[2]["policy_gap_and_recommendations"] == cov.ADVICE["negative"] and got[8]["policy_gap_and_recommendations"] == cov.ADVICE["missing"]


def test_review_pipeline(spark):
    register = spark.createDataFrame([(1, "p", "2", "Board must approve outsourcing", "The board approves outsourcing contracts", "Governance", "Board")], "seq int, policy string, section string, obligation string, language_from_directive string, obligation_category string, primary_responsible_department string")
    policies = spark.createDataFrame([("p", "--- Page 4 ---\n1. Governance\nThe board approves outsourcing contracts every year and reviews them."), ("q", "short")], "policy string, text string")
    out = review(register, policies)
    row = out["gap_assessment"].first()
    assert (row["coverage_status"], row["policy_page"]) == (cov.COVERED, "4")
    assert [r["policy"] for r in out["unreadable"].collect()] == ["q"]
    assert [r["value"] for r in out["kpis"].orderBy("ord").collect()] == [1, 1, 0, 0]
    assert [r["row_count"] for r in out["logs"].orderBy("seq").collect()] == [1, 1, 1]


def test_hybrid_and_keyword_match_over_many_small_blocks_and_shared_groups(spark, monkeypatch):
    """Policies of one block share a group, a large one is dealt out to several: every query still meets all chunks of its policy and no others."""
    from regloom import joins
    from regloom.operators import match, terms

    rng = random.Random(5)
    words = ["capital", "Report", "risk-based", "committee", "solvency", "ombud", "a.b", "quarterly", "notifies", "notify"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, p, text(rng.randint(0, 9)), text(4)) for i, p in enumerate(["big"] * 23 + ["a", "b", "c"] * 2 + ["none"])]
    held = [(p, i + 1, str(i), text(rng.randint(1, 12))) for p, n in (("big", 17), ("a", 2), ("b", 1), ("c", 3)) for i in range(n)]
    register = spark.createDataFrame(rows, "gap_id long, policy string, obligation string, language_from_directive string")
    chunks = spark.createDataFrame(held, "policy string, chunk_seq int, page string, text string")
    monkeypatch.setattr(match, "BLOCK", (5, 4))
    monkeypatch.setattr(terms, "QUERY_ROWS", 5)
    monkeypatch.setattr(terms, "TEXT_ROWS", 4)
    monkeypatch.setattr(match, "FIRST_CHUNKS", 2)
    monkeypatch.setattr(joins, "GROUP_ROWS", 10_000)
    monkeypatch.setattr(joins, "task_count", lambda spark: 1)
    stop = match.keywords.__globals__["STOPWORDS"]
    for matched, similar in ((match.keyword_match, 0.0), (match.hybrid_match, match.FUZZY_WEIGHT)):
        found = {r["gap_id"]: r for r in matched(register, chunks).collect()}
        for i, p, a, b in rows:
            search = f"{a} {b}"
            terms_of = [w for w in re.findall("[a-z][a-z-]{3,}", search.lower()) if w not in stop][: match.MAX_TERMS]
            best = (0.0, 0, "Not located")
            for q, seq, page, t in held:
                share = sum(w in t.lower() for w in terms_of) / max(len(terms_of), 1)
                score = share * match.KEYWORD_WEIGHT + match.token_set_ratio(search[: match.QUERY_CHARS], t) / 100 * similar if similar else share
                if p == q and score > best[0] + 1e-12:
                    best = (score, seq, page)
            assert abs(found[i]["score"] - best[0]) < 1e-9 and found[i]["match_page"] == best[2], (i, p)
