"""Documents: text pages, and binary files through pluggable decoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a document -> texts of its pages
Decoder = Callable[[bytes], list[str]]


def mupdf_pages(data: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return [page.get_text("text") or "" for page in doc]


def pypdf_pages(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(BytesIO(data)).pages]


def ocr_pages(data: bytes) -> list[str]:
    """Pages rendered at twice their size and recognised."""
    import fitz
    import pytesseract
    from PIL import Image

    out = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        for page in doc:
            pixels = page.get_pixmap(matrix=fitz.Matrix(2, 2), alpha=False)
            out.append(pytesseract.image_to_string(Image.open(BytesIO(pixels.tobytes("png")))) or "")
    return out


def too_little_text(pages: list[str]) -> bool:
    return len(" ".join(p.strip() for p in pages)) < 80


def decode(data: bytes, decoders: tuple[Decoder, ...] = (mupdf_pages, pypdf_pages), recognise: Decoder | None = ocr_pages) -> list[str]:
    """Pages by the first decoder that works (what a failed one left is discarded); recognised if there is too little text.

    If recognition fails the decoded pages stay. If no decoder works the last error is raised.
    """
    pages, error = None, None
    for d in decoders:
        try:
            pages = d(data)
            break
        except Exception as e:  # noqa: BLE001 - any decoder may fail in its own way
            error = e
    if pages is None:
        if recognise is None:
            raise error
        pages = []
    if recognise is not None and too_little_text(pages):
        try:
            return recognise(data)
        except Exception as e:  # noqa: BLE001
            if not pages and error is not None:
                raise error from e
    return pages


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf",)) -> DataFrame:
    """(name, path, size_bytes) of the files of a folder, by suffix and name; the contents are not read.

    Files whose name begins with a dot are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "path", F.col("length").alias("size_bytes"))
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1))
    rank = F.array_position(F.array(*[F.lit(s) for s in suffixes]), suffix)
    return named.filter((rank > 0) & ~F.col("name").startswith(".")).orderBy(rank, "name")


def read_pages(spark: SparkSession, path: str, pattern: str = "*.pdf", decoder: Callable[[bytes], list[str]] = decode) -> DataFrame:
    """(doc, page, text, error): pages of every matching file; a file that cannot be decoded gives one row with the error."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, number, text, error = [], [], [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = [(i, t, None) for i, t in enumerate(decoder(data), 1)]
                except Exception as e:  # noqa: BLE001
                    found = [(None, None, f"{type(e).__name__}: {e}")]
                for i, t, e in found:
                    doc.append(name)
                    number.append(i)
                    text.append(t)
                    error.append(e)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.string()), pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["doc", "page", "text", "error"]
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("doc"), "content").mapInArrow(pages, "doc string, page int, text string, error string")
