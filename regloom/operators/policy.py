"""Policy text to reviewable chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regloom.functions.text import SPACE, strip
from regloom.operators.running import running
from regloom.session import materialise

MAX_CHARS = 1800
#: Rows of a policy that one task orders.
BLOCK_ROWS = 1024
#: A policy with less text than this cannot be reviewed.
READABLE_CHARS = 50

_PAGE = r"(?U)(?:\A|\n+)--- Page (\d+) ---\n"
_HEADING = rf"(?Umd)^{SPACE}*(\d+)\.{SPACE}+"
_START = "\u0001"


def _slices(text: Column, size: int) -> Column:
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: strip(F.substring(text, i + 1, F.lit(size)))))


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def chunk_policies(policies: DataFrame, max_chars: int = MAX_CHARS, order: Sequence[str] = (), block: Column | None = None) -> DataFrame:
    """(policy, chunk_seq, page, text) from (policy, text), or from policies that come in rows of whole pages, put in order by the columns ``order``.

    Text is split at page marks (what stands before the first is discarded; without marks the page is
    unknown), each page at top-level numbered headings. The text before the first heading stays whole; a section longer than
    ``max_chars`` is sliced, and so is a page without headings. If nothing comes out of a filled text, its first
    ``max_chars`` characters are the only chunk. Null and blank policies have no chunks. A row of a policy in several must start with a
    page mark and have text; rows are chunked one by one and the numbers run on over their blocks. Without ``order`` nothing is shuffled.
    """
    # what is read more than once is a column, or an element of an array, of its own, so that it is computed once
    rows = policies.select("policy", *order, F.coalesce("text", F.lit("")).alias("__raw")).withColumn("__whole", strip(F.col("__raw")))
    rows = rows.withColumns({"__numbers": F.regexp_extract_all("__whole", F.lit(_PAGE), F.lit(1)), "__bodies": F.split("__whole", _PAGE, -1)})
    numbers, bodies = F.col("__numbers"), F.col("__bodies")
    marked = F.zip_with(numbers, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda p, t: F.struct(p.alias("page"), t.alias("text")))
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit("Unknown").alias("page"), F.col("__raw").alias("text")))).otherwise(marked)

    def cleaned(page: Column) -> Column:
        return F.struct(page["page"].alias("page"), F.regexp_replace(F.replace(page["text"], F.lit("\r"), F.lit("\n")), r"[ \t]+", " ").alias("clean"))

    def parted(page: Column) -> Column:
        return F.struct(page["page"].alias("page"), page["clean"].alias("clean"), F.split(F.regexp_replace(page["clean"], _HEADING, _START + "$0"), _START, -1).alias("parts"))

    def chunks(page: Column) -> Column:
        parts = page["parts"]
        intro = F.array(strip(F.element_at(parts, 1)))
        sections = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), strip)
        cut = F.flatten(F.transform(sections, lambda s: F.when(F.length(s) > max_chars, _slices(s, max_chars)).otherwise(F.array(s))))
        texts = F.when(F.size(parts) == 1, _slices(page["clean"], max_chars)).otherwise(F.concat(intro, cut))
        return F.struct(page["page"].alias("page"), _filled(texts).alias("texts"))

    def paged(found: Column) -> Column:
        return F.transform(found["texts"], lambda t: F.struct(found["page"].alias("page"), t.alias("text")))

    steps = F.transform(F.transform(F.transform(pages, cleaned), parted), chunks)
    rows = rows.withColumn("__found", F.flatten(F.transform(steps, paged)))
    found, whole = F.col("__found"), F.col("__whole")
    fallback = F.array(F.struct(F.lit("Unknown").alias("page"), F.substring(whole, 1, max_chars).alias("text")))
    cut = rows.select("policy", *order, F.when(F.size(found) > 0, found).when(whole != "", fallback).otherwise(found).alias("rows"))
    if order:
        block = F.floor(F.col(order[0]) / BLOCK_ROWS) if block is None else block
        # written, so that the running numbers and the chunks come from one cutting of the texts
        cut = running(materialise(cut, "cut"), "policy", order, block, total={"before": F.size("rows")})
    else:
        cut = cut.withColumn("before", F.lit(0))
    exploded = cut.select("policy", "before", F.posexplode("rows").alias("at", "chunk"))
    return exploded.select("policy", (F.col("before") + F.col("at") + 1).cast("int").alias("chunk_seq"), F.col("chunk.page").alias("page"), F.col("chunk.text").alias("text"))


def readable(policies: DataFrame) -> DataFrame:
    """Adds ``readable``: enough text to review."""
    return policies.withColumn("readable", F.length(strip(F.coalesce("text", F.lit("")))) >= READABLE_CHARS)
