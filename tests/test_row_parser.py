"""The row parser against a character-by-character reader."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from regloom.joins import measured_bytes
from regloom.operators.row_parser import parse_rows, split_rows

HEADER = "Section,Language from Directive,Obligation,Priority"
UPLOADS = "upload_id string, delimiter string, header_line string, uploader string"
RAW = "raw_id long, upload_id string, raw_text string, reason string"
NA = {"", "na", "n/a", "none", "null", "nan"}


def read(text, d):
    """Fields of a record by RFC 4180, or None."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            j, parts = i + 1, []
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                parts.append(text[j:k])
                if text[k + 1 : k + 2] != '"':
                    break
                parts.append('"')
                j = k + 2
            out.append("".join(parts))
            i = k + 1
            if i < n and text[i] != d:
                return None
        else:
            k = text.find(d, i)
            k = n if k < 0 else k
            if re.search('["\r\n]', text[i:k]):
                return None
            out.append(text[i:k])
            i = k
        if i >= n:
            return out
        i += 1


def verdict(text, d, header):
    names = [h.strip() for h in read(header, d)]
    fields = read(text, d)
    if fields is None:
        return "quoting"
    if len(fields) != len(names):
        return "column count"
    for name, value in zip(names, fields, strict=True):
        value = value.strip()
        if name == "Section" and not re.fullmatch(r"[0-9]+(\.[0-9]+)*|Introduction", value):
            return "invalid Section"
        bad = value.lower() in NA or re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]", value)
        if name in ("Language from Directive", "Obligation") and bad:
            return f"invalid {name}"
    return None


def judge(spark, texts, d=",", header=HEADER):
    uploads = spark.createDataFrame([("u", d, header, None)], UPLOADS)
    raw = spark.createDataFrame([(i, "u", t, "clash") for i, t in enumerate(texts)], RAW)
    return [r for r in parse_rows(raw, uploads).orderBy("raw_id").collect()]


def test_cases(spark):
    long = "x" * 200_000
    quotes = '""' * 50_000
    cases = [
        "1.2,a text,do it,High", '1.2,"a, ""text""\nmore",do it,', '"Introduction", a , b ,', "1.2,a text,do it", "1.2,a,b,c,d", "", ",,,", '1.2,"open,b,c',
        '1.2,"a"x,b,c', '1.2,a "b",c,d', "1..2,a,b,c", "1.2.,a,b,c", "١,a,b,c", "1.2,NA,b,c", '1.2,"n/A ",b,c', "1.2,a,  ,c", "1.2,a,b\x07,c", "1.2,a�,b,c",
        "1.2,a\nb,c,d", f"1.2,{long},b,c", f'1.2,"{quotes}",b,c', '1.2,a,b,"', ' 1.2 ,"x",y,z', '1.2, "x",y,z', "1.2,a\tb,c,d", '""""', "Introduction,none of it,null value,",
    ]
    for row, text in zip(judge(spark, cases), cases, strict=True):
        assert row["reason"] == verdict(text, ",", HEADER), text[:80]
        if row["reason"] is None:
            names = HEADER.split(",")
            assert row["fields"] == dict(zip(names, [f.strip() for f in read(text, ",")], strict=True))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='1.a",;\t\n |\\', max_size=14), min_size=30, max_size=60), st.sampled_from(",;|\t"))
def test_random_records(spark, texts, d):
    header = d.join(["Obligation", " Section ", "Language from Directive"])
    for row, text in zip(judge(spark, texts, d, header), texts, strict=True):
        assert row["reason"] == verdict(text, d, header), repr(text)


def test_first_broken_field(spark):
    rows = judge(spark, ["1,,b,c", "x,y,z,w", '1,a,"b', "1,a,b,c,d", "1,a"])
    assert [r["broken_field"] for r in rows] == ["2:Language from Directive", "1:Section", "3:Obligation", "5:", "3:Obligation"]


def test_nulls_unknown_uploads_and_empty_tables(spark):
    uploads = spark.createDataFrame([("u", ",", HEADER, None)], UPLOADS)
    raw = spark.createDataFrame([(1, "u", None, None), (2, "v", "1,a,b,c", None), (3, None, "1,a,b,c", None), (4, "u", "1,a,b,c", None), (4, "u", "1,a,b,c", None)], RAW)
    got = sorted((r["raw_id"], r["reason"]) for r in parse_rows(raw, uploads).collect() if r["reason"])
    assert got == [(1, "no record"), (2, "no header"), (3, "no header")]
    good, bad = split_rows(raw, uploads)
    assert (good.count(), bad.count()) == (2, 3)
    assert parse_rows(raw.limit(0), uploads).count() == 0
    assert parse_rows(raw, uploads.limit(0)).filter("reason = 'no header'").count() == 5


def test_patterns_are_not_part_of_the_lookup(spark, monkeypatch):
    """What is joined to the records is the header; its patterns are thirty times as long."""
    from regloom.operators import row_parser

    widths, join = [], row_parser.lookup_join
    monkeypatch.setattr(row_parser, "lookup_join", lambda big, small, on: (widths.append(measured_bytes(small)), join(big, small, on))[1])
    raw = spark.createDataFrame([(1, "u", "1,a b,c d,High", None), (2, "none", "1,a,b,c", None)], RAW)
    uploads = spark.createDataFrame([("u", ",", HEADER, None)], UPLOADS)
    rows = {r["raw_id"]: r for r in parse_rows(raw, uploads).collect()}
    assert rows[1]["reason"] is None and rows[1]["fields"]["Obligation"] == "c d" and rows[2]["reason"] == "no header"
    assert widths[0] < 5 * len(HEADER)
