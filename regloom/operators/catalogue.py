"""The directive catalogue: normalising remote items and anchors, deduplication, filters, downloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regloom.functions.rules import KNOWN_CATEGORIES, directive_number, section_of, year_of
from regloom.functions.text import base_name, blank_to_null, collapse, first_filled, html_text, joined_url, resolved_url, safe_filename, short_id, strip, url_file
from regloom.joins import lookup_join
from regloom.operators.running import running
from regloom.session import materialise

COLUMNS = ("id", "title", "section", "category", "year", "source_link", "filename", "cached", "downloaded", "description", "local_path", "source_type")

# What a link must hold to be admitted.
ADMITTED = r"(?i)directive|\.pdf|LTST|FSCA|FSB"
# Titles known by the number in a file's name.
KNOWN_TITLES = (("101", "Directive 101.A.i (LT&ST) - Directors and Managing Executive"), ("159", "Directive 159.A.i (LT&ST) - Outsourcing"))
REFERENCE_NOTE = "Reference directive available for offline/demo crawl workflow."
#: A download with fewer bytes is rejected.
MIN_BYTES = 100


def records(rows: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Catalogue rows from (seq, title, source_link, filename, section, category, year, description, local_path, source_type).

    The id is the first twelve hexadecimal digits of the SHA-1 of the local path, the link or the title. A file of
    the library (column ``name``) makes the row cached and downloaded.
    """
    name = safe_filename(first_filled(F.col("filename"), F.concat("title", F.lit(".pdf"))))
    built = rows.select(
        "seq",
        short_id(first_filled(F.col("local_path"), F.col("source_link"), F.col("title"))).alias("id"),
        F.coalesce(blank_to_null(strip(F.col("title"))), name).alias("title"),
        first_filled(F.col("section"), F.lit("Directives")).alias("section"),
        first_filled(F.col("category"), F.col("section"), F.lit("Directives")).alias("category"),
        first_filled(F.col("year"), F.lit("Unknown")).alias("year"),
        "source_link",
        name.alias("filename"),
        F.coalesce("description", F.lit("")).alias("description"),
        "local_path",
        "source_type",
    )
    if library is None:
        flagged = built.withColumn("cached", F.lit(False))
    else:
        names = library.select(F.col("name").alias("filename")).distinct().withColumn("cached", F.lit(True))
        flagged = lookup_join(built, names, ["filename"]).withColumn("cached", F.coalesce("cached", F.lit(False)))
    return flagged.withColumn("downloaded", F.col("cached")).select("seq", *COLUMNS)


def from_rest_items(items: DataFrame, base_url: str, library: DataFrame | None = None) -> DataFrame:
    """Catalogue rows from list items; columns are the alternative field names, all optional, plus ``seq``.

    Admitted are items that mention a directive or have a known category, and that name a file.
    """
    have = set(items.columns)
    pick = lambda *names: strip(F.coalesce(first_filled(*[F.col(f"`{n}`").cast("string") for n in names if n in have]), F.lit(""))) if have & set(names) else F.lit("")
    ref = pick("FileRef", "FileDirRef")
    fields = items.select(
        "seq",
        pick("Title", "FileLeafRef", "Name").alias("title"),
        ref.alias("file_ref"),
        strip(F.coalesce(first_filled(*([F.col("FileLeafRef")] if "FileLeafRef" in have else []), base_name(F.regexp_replace(ref, r"/+\z", ""))), F.lit(""))).alias("file_leaf"),
        pick("Category1", "Category", "Category0").alias("given"),
        pick("Year", "_x0059_ear").alias("given_year"),
        pick("Document_x0020_no", "DocumentNo").alias("doc_no"),
        pick("Document_x0020_Type", "Document Type").alias("doc_type"),
    )
    hay = F.concat_ws(" ", "title", "file_ref", "file_leaf", "given", "doc_no", "doc_type")
    known = F.col("given").isin(*KNOWN_CATEGORIES)
    admitted = fields.withColumn("hay", hay).filter((F.lower("hay").contains("directive") | known) & ((F.col("file_ref") != "") | (F.col("file_leaf") != "")))
    linked = admitted.withColumn("source_link", resolved_url(F.lit(base_url), F.col("file_ref")))
    name = safe_filename(first_filled(F.col("file_leaf"), url_file("source_link"), F.concat(short_id(F.col("source_link")), F.lit(".pdf"))))
    section = F.when(known, F.col("given")).otherwise(section_of(F.col("hay")))
    rows = linked.select(
        "seq",
        first_filled(F.col("title"), name).alias("title"),
        "source_link",
        name.alias("filename"),
        section.alias("section"),
        first_filled(F.col("given"), section).alias("category"),
        first_filled(F.col("given_year"), year_of(F.col("hay"))).alias("year"),
        first_filled(F.col("doc_no"), F.col("doc_type")).alias("description"),
        F.lit(None).cast("string").alias("local_path"),
        F.lit("SharePoint REST").alias("source_type"),
    )
    return dedupe(records(rows, library))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, at, label, href): links of HTML pages (page_id, html) in order."""
    link = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>"
    whole = F.regexp_extract_all("html", F.lit(link), F.lit(0))
    found = pages.select("page_id", F.posexplode(whole).alias("at", "tag"))
    href = first_filled(*[F.regexp_extract("tag", link, i) for i in (1, 2, 3)])
    return found.select("page_id", "at", collapse(html_text(F.regexp_extract("tag", link, 4))).alias("label"), F.coalesce(href, F.lit("")).alias("href"))


def from_anchors(links: DataFrame, page_url: str, library: DataFrame | None = None) -> DataFrame:
    """Catalogue rows from (seq, label, href)."""
    hay = F.concat_ws(" ", "label", "href")
    low = F.lower("href")
    admitted = links.filter(hay.rlike(ADMITTED) & ~low.startswith("javascript") & ~low.contains("{item"))
    linked = admitted.withColumn("source_link", joined_url(F.lit(page_url), F.col("href"))).withColumn("hay", hay)
    name = safe_filename(first_filled(url_file("source_link"), F.concat("label", F.lit(".pdf"))))
    rows = linked.withColumn("filename", name).filter(F.col("filename") != "file").select(
        "seq",
        F.when(F.length("label") > 5, F.col("label")).otherwise(F.col("filename")).alias("title"),
        "source_link",
        "filename",
        section_of(F.col("hay")).alias("section"),
        section_of(F.col("hay")).alias("category"),
        year_of(F.col("hay")).alias("year"),
        F.lit("").alias("description"),
        F.lit(None).cast("string").alias("local_path"),
        F.lit("Public HTML").alias("source_type"),
    )
    return dedupe(records(rows, library))


def from_files(files: DataFrame, page_url: str, library: DataFrame | None = None) -> DataFrame:
    """Catalogue rows from (seq, name, path) of reference files."""
    known = F.lit(None).cast("string")
    for key, title in reversed(KNOWN_TITLES):
        known = F.when(F.col("name").contains(key), title).otherwise(known)
    title = F.coalesce(known, F.regexp_replace("name", r"(?<=.)\.[^.]*\z", ""))
    words = F.concat_ws(" ", title, F.col("name"), directive_number(F.col("name")))
    rows = files.select(
        "seq",
        title.alias("title"),
        F.lit(page_url).alias("source_link"),
        F.col("name").alias("filename"),
        section_of(words).alias("section"),
        section_of(words).alias("category"),
        year_of(words).alias("year"),
        F.lit(REFERENCE_NOTE).alias("description"),
        F.col("path").alias("local_path"),
        F.lit("Reference file").alias("source_type"),
    )
    return records(rows, library)


def layered(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that has any; decided inside the plan by the smallest rank present."""
    ranked = None
    for rank, s in enumerate(sources):
        s = s.withColumn("rank", F.lit(rank))
        ranked = s if ranked is None else ranked.unionByName(s)
    first = ranked.agg(F.min("rank").alias("rank"))
    return ranked.join(F.broadcast(first), "rank").drop("rank")  # one row


def category_counts(pages: DataFrame) -> DataFrame:
    """(category, n) scraped from page text (page_id, text): ``Category1 : name (n)``; the last of a name wins."""
    pattern = r"Category1\s*:\s*(.*?)\s*[\x{200e}\x{200f}]*\((\d+)\)"
    names, sizes = (F.regexp_extract_all("text", F.lit(pattern), F.lit(i)) for i in (1, 2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(names.alias("category"), sizes.alias("n"))).alias("at", "x"))
    last = F.max_by(F.col("x.n"), F.struct("page_id", "at"))
    return rows.groupBy(strip(F.col("x.category")).alias("category")).agg(last.cast("int").alias("n"))


def dedupe(catalogue: DataFrame) -> DataFrame:
    """One row per link (or path, file name, id): the last value at the place of the first.

    Aggregation instead of a window: partial results are combined before the exchange, so a link seen in a
    third of all rows is no hot task.
    """
    key = first_filled(F.col("source_link"), F.col("local_path"), F.col("filename"), F.col("id"))
    rest = [c for c in catalogue.columns if c != "seq"]
    last = F.max_by(F.struct(*rest), F.col("seq"))
    return catalogue.groupBy(key.alias("key")).agg(last.alias("row"), F.min("seq").alias("seq")).select("seq", "row.*").select("seq", *rest)


def filter_catalogue(catalogue: DataFrame, section: str | None = None, year: str | None = None) -> DataFrame:
    """Rows of a section (or category) and a year; ``All`` or nothing means any."""
    if section and section != "All":
        catalogue = catalogue.filter((F.col("section") == section) | (F.col("category") == section))
    if year and year != "All":
        catalogue = catalogue.filter(F.col("year") == year)
    return catalogue


def category_total(counts: DataFrame) -> DataFrame:
    """(total): documents of all scraped categories."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def selected(ids: DataFrame) -> DataFrame:
    """The requested ids; an empty request is refused."""
    if ids.isEmpty():
        raise ValueError("Select at least one directive to download.")
    return ids


def metadata(catalogue: DataFrame, source_url: str | None = None) -> DataFrame:
    """(kind, ord, value): ``All`` and the sections ascending, ``All`` and the years descending as text, and the address of the source if it is given."""
    def listed(kind: str, column: str, descending: bool) -> DataFrame:
        values = catalogue.filter(F.col(column) != "").select(F.col(column).alias("value")).distinct()
        order = F.desc("value") if descending else F.asc("value")
        ranked = values.withColumn("ord", F.row_number().over(Window.orderBy(order)))  # distinct sections or years, a handful
        every = catalogue.sparkSession.range(1).select(F.lit("All").alias("value"), F.lit(0).alias("ord"))
        return every.unionByName(ranked).select(F.lit(kind).alias("kind"), "ord", "value")

    rows = listed("section", "section", False).unionByName(listed("year", "year", True))
    if source_url is None:
        return rows
    url = catalogue.sparkSession.range(1).select(F.lit("source_url").alias("kind"), F.lit(0).alias("ord"), F.lit(source_url).alias("value"))
    return rows.unionByName(url)


def catalogue_kpis(catalogue: DataFrame) -> DataFrame:
    """(total, sections, downloaded, cached) in one aggregation."""
    return catalogue.agg(
        F.count("*").alias("total"),
        F.count_distinct("section").alias("sections"),
        F.count_if(F.col("downloaded")).alias("downloaded"),
        F.count_if(F.col("cached")).alias("cached"),
    )


def display_table(catalogue: DataFrame, rows: int | None = 25) -> DataFrame:
    """The first ``rows`` rows by seq, or all, as shown to a reader: numbered, with defaults."""
    shown = catalogue if rows is None else catalogue.orderBy("seq").limit(rows)
    numbered = running(shown.withColumn("all", F.lit(1)), "all", ["seq"], F.floor(F.col("seq") / 4096), total={"before": F.lit(1)})
    return numbered.select(
        (F.col("before") + 1).cast("int").alias("doc_no"),
        "title",
        "section",
        "year",
        first_filled(F.when(F.col("downloaded"), F.col("filename")), F.lit("Not downloaded")).alias("file"),
        first_filled(F.col("source_type"), F.lit("FSCA")).alias("source"),
    )


def plan_downloads(requested: DataFrame, catalogue: DataFrame, library: DataFrame, reference: DataFrame) -> DataFrame:
    """(pos, id, action, filename, source) for each requested id, in request order and with repetitions.

    ``requested``: pos, id; ``library``: name; ``reference``: path of files that exist. Actions: ``unknown``, ``cached``
    (already in the library), ``copy`` (from a reference file), ``download``.
    """
    by_id = catalogue.groupBy("id").agg(F.max_by(F.struct("title", "source_link", "filename", "local_path"), F.col("seq")).alias("r"))
    rows = requested.join(by_id, "id", "left")
    filename = safe_filename(first_filled(F.col("r.filename"), F.concat("id", F.lit(".pdf"))))
    named = rows.select("pos", "id", F.col("r").isNull().alias("unknown"), "r.source_link", "r.local_path", filename.alias("filename"))
    held = lookup_join(named, library.select(F.col("name").alias("filename")).distinct().withColumn("held", F.lit(True)), ["filename"])
    there = lookup_join(held, reference.select(F.col("path").alias("local_path")).distinct().withColumn("there", F.lit(True)), ["local_path"])
    action = F.when(F.col("unknown"), "unknown").when(F.col("held"), "cached").when(F.col("there"), "copy").otherwise("download")
    return there.select(
        "pos",
        "id",
        action.alias("action"),
        F.when(~F.col("unknown"), F.col("filename")).alias("filename"),
        F.when(action == "copy", F.col("local_path")).when(action == "download", F.col("source_link")).alias("source"),
    )


def accept_download(size: Column, content_type: Column, filename: Column) -> Column:
    """Whether fetched bytes are a document: large enough, and a PDF by type or by name."""
    return (size >= MIN_BYTES) & (F.lower(F.coalesce(content_type, F.lit(""))).contains("pdf") | F.lower(filename).endswith(".pdf"))


def mark_downloaded(catalogue: DataFrame, downloaded: DataFrame) -> DataFrame:
    """Catalogue with the rows whose id was downloaded flagged."""
    hit = downloaded.select("id").distinct().withColumn("hit", F.lit(True))
    joined = catalogue.join(hit, "id", "left")
    flag = lambda c: (F.col(c) | F.coalesce("hit", F.lit(False))).alias(c)
    return joined.select("seq", *[flag(c) if c in ("cached", "downloaded") else F.col(c) for c in COLUMNS])


def unique_names(names: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(seq, filename, unique_name): a safe name that exists gets ``_2``, ``_3`` ... before its suffix, the first that does not exist.

    ``names`` (seq, filename) are named in order of seq; names in ``taken`` (name) exist from the start. Names can only meet if they are equal up to
    trailing numbers. Where such a family holds one name alone, its rows are counted over blocks; a family of several names
    is read in order as a stream that remembers the names given by themselves and a counter for each.
    """
    safe = names.select("seq", safe_filename(F.col("filename")).alias("filename"))
    if taken is not None:
        safe = safe.unionByName(taken.select(F.lit(-1).cast("long").alias("seq"), safe_filename(F.col("name")).alias("filename")).distinct())
    suffix = F.regexp_extract("filename", r"(?<=.)(\.[^.]*)\z", 1)
    rows = safe.withColumn("suffix", suffix).withColumn("root", F.expr("substring(filename, 1, length(filename) - length(suffix))"))
    rows = rows.withColumn("family", F.concat(F.regexp_replace("root", r"(?:_\d+)+\z", ""), "suffix"))
    mixed = rows.groupBy("family").agg((F.min("filename") != F.max("filename")).alias("mixed"))
    marked = lookup_join(rows, materialise(mixed.filter("mixed"), "families"), ["family"])
    alone = running(marked.filter("mixed is null"), "filename", ["seq"], F.floor(F.col("seq") / 4096), total={"before": F.lit(1)})
    numbered = F.when(F.col("before") == 0, F.col("filename")).otherwise(F.concat("root", F.lit("_"), (F.col("before") + 1).cast("string"), "suffix"))
    simple = alone.filter("seq >= 0").select("seq", "filename", numbered.alias("unique_name"))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, given, following = None, set(), {}
        for b in batches:
            out = []
            for key, seq, name, root, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != family:
                    family, given, following = key, set(), {}

                def exists(x: str) -> bool:
                    stem, _, number = x[: len(x) - len(end)].rpartition("_")  # noqa: B023
                    return x in given or number.isdecimal() and number[0] != "0" and 2 <= int(number) < following.get(stem, 2)  # noqa: B023

                pick = name
                if exists(name) and seq >= 0:
                    n = following.get(root, 2)
                    while f"{root}_{n}{end}" in given:
                        n += 1
                    pick, following[root] = f"{root}_{n}{end}", n + 1
                else:
                    given.add(name)
                out.append(pick)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.string())], names=["seq", "filename", "unique_name"])

    several = marked.filter("mixed").select("family", F.col("seq").cast("long"), "filename", "root", "suffix")
    ordered = several.repartition("family").sortWithinPartitions("family", "seq").mapInArrow(in_order, "seq long, filename string, unique_name string")
    return simple.withColumn("seq", F.col("seq").cast("long")).unionByName(ordered.filter("seq >= 0"))
