"""Register files: CSV, and XLSX read with the standard library."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regloom.operators.register import normalise_register

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quotes are doubled inside quoted fields and line breaks may stand in them."""
    return (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    )


def _cells(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in si.iterfind(".//m:t", _NS)) for si in root.iterfind("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = book.find("m:sheets/m:sheet", _NS).get(f"{{{_NS['r']}}}id")
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(x.get("Target") for x in links if x.get("Id") == first)
        sheet = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows = []
    for row in sheet.iterfind(".//m:row", _NS):
        out: list[str | None] = []
        for cell in row.iterfind("m:c", _NS):
            letters = re.match(r"[A-Z]+", cell.get("r", "")) or None
            at = len(out)
            if letters:
                at = 0
                for ch in letters.group():
                    at = at * 26 + ord(ch) - 64
                at -= 1
            out.extend([None] * (at + 1 - len(out)))
            kind, v = cell.get("t"), cell.find("m:v", _NS)
            if kind == "s" and v is not None:
                out[at] = strings[int(v.text)]
            elif kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in cell.iterfind(".//m:t", _NS))
            else:
                out[at] = None if v is None else v.text
        rows.append(out)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of one workbook, its first row as header, all columns as strings.

    A workbook is one upload of bounded size; it is fetched through Spark's file access, so any file system works.
    """
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = _cells(data)
    header = [str(h) for h in rows[0]] if rows else []
    body = [[*r[: len(header)], *[None] * (len(header) - len(r))] for r in rows[1:]]
    return spark.createDataFrame(body, T.StructType([T.StructField(h, T.StringType()) for h in header]))


def load_register(spark: SparkSession, path: str) -> DataFrame:
    """A register by its suffix, reduced to the required columns. ``.xls`` is refused: there is no public reader for it here."""
    suffix = path.lower().rsplit(".", 1)[-1]
    if suffix == "csv":
        return normalise_register(read_csv(spark, path))
    if suffix == "xlsx":
        return normalise_register(read_xlsx(spark, path))
    raise ValueError("Registers must be .csv or .xlsx files")
