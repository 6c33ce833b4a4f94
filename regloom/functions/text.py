"""Small text functions whose results agree with Python's string methods."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from urllib.parse import quote, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python sees it: Unicode white space and the four separators.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def strip_left(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+", "")


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def safe_filename(c: Column) -> Column:
    """Characters outside a safe set become underscores; never empty."""
    clean = collapse(strip(F.regexp_replace(c, r"[^A-Za-z0-9._() -]+", "_")))
    return F.coalesce(blank_to_null(clean), F.lit("file"))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)\z", 1)


def stem(c: Column) -> Column:
    """File name without its last suffix, spaces as underscores."""
    return F.replace(F.regexp_replace(c, r"(?<=.)\.[^.]*\z", ""), F.lit(" "), F.lit("_"))


def export_name(upload: Column, suffix: str) -> Column:
    """Name of the file that results from an upload."""
    return F.concat(stem(upload), F.lit(suffix))


def header_label(c: Column) -> Column:
    """A field name as it is shown: underscores as spaces."""
    return F.replace(c, F.lit("_"), F.lit(" "))


def shown(c: Column) -> Column:
    """A value as it is shown: text, nothing for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def short_id(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


@F.pandas_udf(T.StringType())
def resolved_url(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(base, reference) -> absolute URL, the path percent-quoted."""
    for base, ref in parts:
        yield pd.Series([None if r is None else r if r.startswith("http") else urljoin(b, quote(r, safe="/:()%&?=.,-_'")) for b, r in zip(base, ref, strict=True)])


@F.pandas_udf(T.StringType())
def joined_url(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(base, href) -> absolute URL, nothing quoted."""
    for base, ref in parts:
        yield pd.Series([None if r is None else urljoin(b, r) for b, r in zip(base, ref, strict=True)])


@F.pandas_udf(T.StringType())
def url_file(urls: pd.Series) -> pd.Series:
    """Last segment of the path of a URL."""
    return urls.map(lambda u: None if u is None else urlparse(u).path.rstrip("/").rsplit("/", 1)[-1])


@F.pandas_udf(T.StringType())
def html_unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t))


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: tags out, entities decoded, ends stripped."""
    return strip(html_unescaped(F.regexp_replace(c, r"<[^>]+>", " ")))
