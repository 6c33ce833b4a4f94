"""Exports: CSV with exact strings, one folder per sheet, JSON records, XLSX workbooks."""

from __future__ import annotations

import zipfile
from collections.abc import Mapping
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.operators.register import public_names


def write_csv(df: DataFrame, path: str, order: str | None = "seq", single_file: bool = False) -> None:
    """A file a partition, in order, or a single one. Header, doubled quotes, white space and empty strings kept. The order column is not written."""
    rows = df.orderBy(order) if order in df.columns else df
    rows = public_names(rows.drop(*([order] if order in df.columns else [])))
    if single_file:
        rows = rows.coalesce(1)
    writer = rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_sheets(sheets: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per sheet under ``path``."""
    for name, df in sheets.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name.replace(' ', '_')}")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record a line, nulls included."""
    public_names(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _column(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def write_xlsx(sheets: Mapping[str, DataFrame], path: str, max_rows: int = 1_048_575) -> None:
    """A workbook for readers on one machine; rows stream to the driver sheet by sheet.

    A sheet cannot hold more than ``max_rows`` rows; a larger frame is refused, not cut.
    """
    names = list(sheets)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(Path(path), "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, n in enumerate(names):
            df = public_names(sheets[n])
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>'.encode())
                out.write(_row(1, df.columns))
                for k, row in enumerate(df.toLocalIterator(), 2):
                    if k - 1 > max_rows:
                        raise ValueError(f"sheet {n} has more than {max_rows} rows")
                    out.write(_row(k, row))
                out.write(b"</sheetData></worksheet>")


def _row(number: int, values) -> bytes:
    cells = []
    for i, v in enumerate(values):
        at = f"{_column(i)}{number}"
        if v is None:
            continue
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            cells.append(f'<c r="{at}"><v>{v}</v></c>')
        else:
            text = "".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) >= 32)
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()
