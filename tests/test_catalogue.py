import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from regloom.functions.text import export_name, header_label, shown
from regloom.operators import catalogue as cat
from regloom.plans.pipelines import crawl, download_log
from regloom.sources.remote import items_of

URL = "https://site.example"


def test_rest_items(spark):
    payloads = [
        (0, '{"value": []}'),
        (1, '{"d": {"results": [{"Title": " Directive 159.A.i (LT&ST) of 2012 ", "FileRef": "/docs/My file.pdf", "FileLeafRef": "My file.pdf"}, {"Title": "Circular", "FileRef": "/x.pdf"}]}}'),
        (2, '{"value": [{"Name": "Pension note", "Category1": "Retirement Fund", "FileRef": "http://a.example/n.pdf", "DocumentNo": "7"}, {"Title": "directive", "FileRef": ""}, {"Title": "Directive again", "FileRef": "/docs/My file.pdf"}]}'),
        (3, "not json"),
        (4, None),
    ]
    items = items_of(spark.createDataFrame(payloads, "seq long, json string"))
    rows = cat.from_rest_items(items, URL).orderBy("seq").collect()
    assert [r["title"] for r in rows] == ["Directive again", "Pension note"]
    first, second = rows
    assert first["source_link"] == URL + "/docs/My%20file.pdf" and first["filename"] == "My file.pdf" and first["section"] == "Directives"
    assert first["id"] == hashlib.sha1(first["source_link"].encode()).hexdigest()[:12]
    assert (second["section"], second["category"], second["description"], second["year"], second["filename"]) == ("Retirement Fund", "Retirement Fund", "7", "Unknown", "n.pdf")


def test_anchors(spark):
    html = """<a href="javascript:void(0)">Directive menu</a><A class=x HREF='/d/Dir 1.pdf'><b>Directive</b> &amp; more 2015</A><a href="{item.pdf}">FSCA</a>
      <a href="/">FSCA</a><a name="x">no link</a><a href=/e.pdf>short</a><a href="/about">About</a>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    links = cat.anchors(pages)
    assert links.count() == 6
    rows = cat.from_anchors(links.select(F.col("at").cast("long").alias("seq"), "label", "href"), URL).orderBy("seq").collect()
    assert [(r["title"], r["filename"], r["year"]) for r in rows] == [("Directive & more 2015", "Dir 1.pdf", "2015"), ("FSCA.pdf", "FSCA.pdf", "Unknown"), ("e.pdf", "e.pdf", "Unknown")]


def test_category_counts(spark):
    text = "Category1 : Insurer ‎(12)\nCategory1: Fund (3)\nCategory1 : Insurer (14)"
    got = {r["category"]: r["n"] for r in cat.category_counts(spark.createDataFrame([(1, text), (2, None)], "page_id int, text string")).collect()}
    assert got == {"Insurer": 14, "Fund": 3}


def rows(spark, *items):
    data = [(i, f"id{k}", f"t{i}", "S", "C", y, link, f"f{k}.pdf", c, d, "", p, "x") for i, k, y, link, c, d, p in items]
    return spark.createDataFrame(data, "seq long, id string, title string, section string, category string, year string, source_link string, filename string, cached boolean, downloaded boolean, description string, local_path string, source_type string")


def test_dedupe_keeps_last_value_at_first_place(spark):
    df = rows(spark, (1, "a", "2001", "l1", False, False, None), (2, "b", "2002", "", False, False, "p"), (3, "a", "2003", "l1", True, True, None), (4, "b", "2004", None, False, False, "p"))
    got = [(r["seq"], r["title"], r["year"]) for r in cat.dedupe(df).orderBy("seq").collect()]
    assert got == [(1, "t3", "2003"), (2, "t4", "2004")]
    assert cat.dedupe(df.limit(0)).count() == 0


def test_filters_metadata_and_layers(spark):
    df = rows(spark, (1, "a", "2001", "l1", False, True, None), (2, "b", "Unknown", "l2", True, False, None))
    assert cat.filter_catalogue(df, "C", "2001").count() == 1 and cat.filter_catalogue(df, "All", None).count() == 2
    got = [(r["kind"], r["value"]) for r in cat.metadata(df).orderBy("kind", "ord").collect()]
    assert got == [("section", "All"), ("section", "S"), ("year", "All"), ("year", "Unknown"), ("year", "2001")]
    assert tuple(cat.catalogue_kpis(df).first()) == (2, 1, 1, 1)
    out = crawl([df.limit(0), df.filter("seq = 2"), df], "S")
    assert [r["seq"] for r in out["records"].collect()] == [2]
    shown = cat.display_table(df, 1).collect()
    assert [(r["doc_no"], r["file"]) for r in shown] == [(1, "fa.pdf")]


def test_downloads(spark):
    df = rows(spark, (1, "a", "1", "l1", False, False, None), (2, "b", "1", "l2", False, False, "/ref/b.pdf"), (3, "c", "1", "l3", False, False, "/gone.pdf"))
    asked = spark.createDataFrame([(1, "idb"), (2, "nope"), (3, "ida"), (4, "idb"), (5, "idc")], "pos long, id string")
    library = spark.createDataFrame([("fa.pdf",)], "name string")
    there = spark.createDataFrame([("/ref/b.pdf",)], "path string")
    plan = cat.plan_downloads(asked, df, library, there)
    assert [r["action"] for r in plan.orderBy("pos").collect()] == ["copy", "unknown", "cached", "copy", "download"]
    assert [r["status"] for r in download_log(plan).orderBy("seq").collect()] == ["Completed", "Failed", "Cached", "Completed", "Pending"]
    done = cat.mark_downloaded(df, plan.filter("action = 'copy'").select("id"))
    assert {r["seq"]: (r["cached"], r["downloaded"]) for r in done.collect()} == {1: (False, False), 2: (True, True), 3: (False, False)}


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a b.pdf"), (2, "a  b.pdf"), (3, "x"), (4, "x"), (5, ""), (6, "a/b?.pdf")], "seq long, filename string")
    got = [r["unique_name"] for r in cat.unique_names(df, spark.createDataFrame([("x",)], "name string")).orderBy("seq").collect()]
    assert got == ["a b.pdf", "a b_2.pdf", "x_2", "x_3", "file", "a_b_.pdf"]


def test_unique_names_equal_the_loop(spark):
    rng = random.Random(11)
    pool = ["a.pdf", "a.pdf", "a_2.pdf", "a_3.pdf", "a_2_2.pdf", "b", "b_2", "c.txt", "a b.pdf", "a?b.pdf", "d_02.pdf", "d.pdf", "_2", ".x"]
    rows = [(i, rng.choice(pool)) for i in range(400)] + [(500 + i, "hot.pdf") for i in range(300)]
    held = ["a_4.pdf", "c.txt", "c_2.txt", "z.pdf"]
    taken, want = set(held), {}
    for seq, name in rows:
        clean = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9._() -]+", "_", name).strip()) or "file"
        root, end = re.fullmatch(r"(?s)(.+?)(\.[^.]*)?", clean).groups() if not clean.startswith(".") else (clean, "")
        pick, n = clean, 2
        while pick in taken:
            pick, n = f"{root}_{n}{end or ''}", n + 1
        taken.add(pick)
        want[seq] = pick
    names = spark.createDataFrame(rows, "seq long, filename string")
    got = cat.unique_names(names, spark.createDataFrame([(x,) for x in held], "name string")).collect()
    assert {r["seq"]: r["unique_name"] for r in got} == want
    assert cat.unique_names(names.limit(0)).count() == 0


def test_display_and_selection(spark):
    df = spark.createDataFrame([("a_b_c", None, 3), ("x", "y", None)], "label string, text string, n int")
    assert [tuple(r) for r in df.select(header_label(F.col("label")), shown(F.col("text")), shown(F.col("n")), export_name(F.col("label"), ".csv")).collect()] == [("a b c", "", "3", "a_b_c.csv"), ("x", "y", "", "x.csv")]
    with pytest.raises(ValueError):
        cat.selected(df.limit(0))
    assert cat.selected(df).count() == 2
    assert cat.category_total(spark.createDataFrame([("a", 3), ("b", 4)], "category string, n int")).first()[0] == 7
    rows = cat.metadata(spark.createDataFrame([("s", "2010")], "section string, year string"), "https://x.example").collect()
    assert ("source_url", 0, "https://x.example") in [tuple(r) for r in rows]
