import csv
import json
from pathlib import Path

import pytest

from regloom.operators import catalogue as cat
from regloom.operators import register as reg
from regloom.plans.pipelines import crawl
from regloom.session import materialise, release
from regloom.sources import documents, registers, remote, sinks
from regloom.sources.remote import items_of
from regloom.streaming.ingest import start_register_stream


@pytest.fixture
def register(spark):
    rows = [(1, "1.1", ' padded "text",\nline ', "o", "c", "d", "s", "High", "Yes"), (2, "2", "", "NA", None, "d2", "s", "Low", "No")]
    return spark.createDataFrame(rows, "seq int, section string, language_from_directive string, obligation string, obligation_category string, primary_responsible_department string, support_function string, priority string, actionable string")


def test_csv_round_trip(spark, register, tmp_path):
    sinks.write_csv(register, str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("*.csv"))
    rows = list(csv.reader(part.open(newline="")))
    assert rows[0] == list(reg.REGISTER) and rows[1][1] == ' padded "text",\nline ' and rows[2][1] == ""
    back = registers.load_register(spark, str(part)).collect()
    assert back[0]["Language from Directive"] == ' padded "text",\nline ' and back[1]["Obligation"] == ""


def test_xlsx_round_trip(spark, register, tmp_path):
    path = tmp_path / "book.xlsx"
    sinks.write_xlsx({"Obligations": register.drop("seq"), "Counts": register.groupBy("priority").count()}, str(path))
    back = registers.load_register(spark, str(path)).collect()
    assert [r["Section"] for r in back] == ["1.1", "2"] and back[0]["Language from Directive"] == ' padded "text",\nline '
    with pytest.raises(ValueError):
        registers.load_register(spark, "x.xls")
    with pytest.raises(ValueError):
        sinks.write_xlsx({"o": register}, str(path), max_rows=1)


def test_json_and_sheets(spark, register, tmp_path):
    sinks.write_json(register, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.txt") for x in p.read_text().splitlines()]
    assert {x["Section"] for x in lines} == {"1.1", "2"} and any(x["Obligation Category"] is None for x in lines)
    sinks.write_sheets({"Text Breakdown": register}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "Text_Breakdown")).count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"one\fone more text " * 9)
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / ".hidden.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    listed = documents.list_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["size_bytes"]) for r in listed] == [("a.PDF", 1), ("b.pdf", 162)]
    pages = documents.read_pages(spark, str(tmp_path), decoder=lambda b: b.decode().split("\f")).collect()
    assert [r["page"] for r in sorted(pages, key=lambda r: r["page"])] == list(range(1, 11))
    broken = documents.read_pages(spark, str(tmp_path), decoder=lambda b: 1 / 0).first()
    assert broken["error"].startswith("ZeroDivisionError") and broken["page"] is None


def test_decoder_order():
    fail = lambda b: 1 / 0
    assert documents.decode(b"", (fail, lambda b: ["x" * 90]), fail) == ["x" * 90]
    assert documents.decode(b"", (lambda b: ["short"],), lambda b: ["seen"]) == ["seen"]
    assert documents.decode(b"", (lambda b: ["short"],), fail) == ["short"]
    with pytest.raises(ZeroDivisionError):
        documents.decode(b"", (fail,), None)


def test_payload_files_and_list_source(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"value": [{"Title": "a"}, {"Title": "b"}]}')
    (tmp_path / "2.json").write_text('{"value": [{"Title": "c"}]}')
    got = [(r["seq"], r["Title"]) for r in remote.read_payloads(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [(0, "a"), (1, "b"), (1 << 32, "c")]
    spark.dataSource.register(remote.ListItems)
    assert spark.read.format("list_items").option("endpoints", "http://127.0.0.1:9/x").option("timeout", "1").load().count() == 0


def test_failed_endpoints_and_empty_sources_are_logged(spark):
    errors = remote.list_errors("http://127.0.0.1:9/x|http://127.0.0.1:9/y", 1)
    assert [e for e, _ in errors] == ["http://127.0.0.1:9/x", "http://127.0.0.1:9/y"]
    empty = spark.createDataFrame([], "seq int, " + ", ".join(f"{c} {'boolean' if c in ('cached', 'downloaded') else 'string'}" for c in cat.COLUMNS))
    rows = [tuple(r) for r in crawl([empty, empty], errors=errors)["logs"].orderBy("seq").collect()]
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == [(1, "List Scan", "Failed", 0), (2, "List Scan", "Failed", 0), (3, "Results", "Failed", 0), (4, "Filter", "Completed", 0)]
    assert rows[0][3].startswith("http://127.0.0.1:9/x: ")


def test_stream(spark, tmp_path):
    drop = tmp_path / "in"
    drop.mkdir()
    doc = {"doc": "d", "pages": [{"page": 1, "text": "1. The board must report."}]}
    (drop / "1.json").write_text(json.dumps(doc) + "\n" + json.dumps({"doc": "e", "pages": [{"page": 1, "text": "plain"}]}))
    run = lambda: start_register_stream(spark, str(drop), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (drop / "2.json").write_text(json.dumps({"doc": "f", "pages": [{"page": 1, "text": "1. a\n2. b"}]}))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = sorted((r["doc"], r["section"], r["actionable"]) for r in rows)
    # the page mark before the first clause is the introduction
    assert got == [("d", "1", "Yes"), ("d", "Introduction", "No"), ("e", "Introduction", "No"), ("f", "1", "No"), ("f", "2", "No"), ("f", "Introduction", "No")]


def test_items_of_large_payloads_keep_their_own_keys(spark):
    payload = json.dumps({"value": [{"Title": f"t{i}"} for i in range(6000)]})
    items = items_of(spark.createDataFrame([(0, payload), (1, payload)], "seq long, json string"))
    assert items.select("seq").distinct().count() == 12_000


def test_written_tables_are_released(spark):
    table = materialise(spark.range(5), "five")
    path = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert table.count() == 5 and path.exists()
    release(spark)
    assert not path.exists()
