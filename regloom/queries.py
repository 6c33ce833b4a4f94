"""Queries over the whole test tables for the operators outside the training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regloom.functions import rules
from regloom.functions.text import export_name, first_filled, header_label, safe_filename, shown, strip
from regloom.joins import spread
from regloom.operators import catalogue as cat
from regloom.operators import coverage as cov
from regloom.operators import register as reg
from regloom.operators.clauses import clauses, needs_ocr, page_lookup, render_pages
from regloom.operators.match import FUZZY_WEIGHT, KEYWORD_WEIGHT, hybrid_match, keyword_match, keyword_score, similarity
from regloom.operators.policy import chunk_policies
from regloom.operators.process_log import append, counted
from regloom.operators.row_parser import parse_rows
from regloom.plans.pipelines import download_log

BASE_URL = "https://notices.regulator.example"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: Column) -> Column:
    """The text as it is stored."""
    return F.coalesce(c, F.lit(""))


# --- rows that fail to parse -------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(table(spark, sf_dir, "register_raw"), table(spark, sf_dir, "register_uploads"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of uploaded registers that fail to parse."""
    return _judged(spark, sf_dir).filter(F.col("reason").isNotNull()).select("raw_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("records"))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records with the required fields, missing values as empty strings."""
    f = F.col("fields")
    names = {v: k for k, v in reg.NAMES.items()}
    valid = _judged(spark, sf_dir).filter(F.col("reason").isNull())
    return valid.select("raw_id", *[F.when(f[c].isin(*reg.NA_VALUES), "").otherwise(f[c]).alias(names[c]) for c in reg.REQUIRED])


# --- documents, clauses, register --------------------------------------------------------------------------------------


def _clause_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause rows as (clause_id, doc, section, wording)."""
    return spread(table(spark, sf_dir, "directive_clauses")).select("clause_id", "doc", "section", whole(F.col("language_from_directive")).alias("wording"))


#: Order of the clauses of a directive, and the block of a clause.
_ORDER = ["sequence_no", "clause_id"]


def _block() -> Column:
    return F.floor(F.col("sequence_no") / 256)


def _document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, sequence_no, clause_id, text): the clauses of a directive as the lines of one document."""
    return spread(table(spark, sf_dir, "directive_clauses")).select("doc", *_ORDER, F.concat("section", F.lit(" "), whole(F.col("language_from_directive"))).alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, sequence_no, clause_id, text): clause texts by their numeric page; each clause without one is a page of unknown number (null)."""
    rows = table(spark, sf_dir, "directive_clauses").select("doc", F.expr("try_cast(page as int)").alias("page"), *_ORDER, whole(F.col("language_from_directive")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct(*_ORDER, "text")))  # one page of a document
    first = F.min(F.struct(*_ORDER))
    numbered = rows.filter("page is not null").groupBy("doc", "page").agg(first.alias("first"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return rows.filter("page is null").unionByName(numbered.select("doc", "page", "first.*", "text"))


def page_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page by page; pages of unknown number come first."""
    return render_pages(_pages(spark, sf_dir), _ORDER)


def clause_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(_document_pieces(spark, sf_dir), _ORDER, _block(), "\n")


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.obligations(_clause_rows(spark, sf_dir), ["clause_id", "doc"])


def obligation_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _register(spark, sf_dir).drop("doc", "language_from_directive")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_register(spark, sf_dir), "obligation_category", "category", F.col("clause_id"))


def department_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_register(spark, sf_dir), "primary_responsible_department", "department", F.col("clause_id"))


def priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_register(spark, sf_dir), "priority", "priority", F.col("clause_id"))


def actionable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_register(spark, sf_dir), "actionable", "actionable", F.col("clause_id"))


def register_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.register_kpis(_register(spark, sf_dir))


def register_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.filter_register(_register(spark, sf_dir), "Governance", "Board / Senior Management").select("clause_id", "priority", "actionable")


def register_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.options(table(spark, sf_dir, "gap_assessment"), "obligation_category", F.col("gap_id"))


def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which directives hold too little text over all their clauses."""
    rows = table(spark, sf_dir, "directive_clauses")
    pages = rows.select("doc", F.col("sequence_no").alias("page"), whole(F.col("language_from_directive")).alias("text"))
    return needs_ocr(pages)


def page_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "gap_assessment").select(F.col("gap_id").alias("query_id"), "doc", whole(F.col("obligation")).alias("query"))
    return page_lookup(_pages(spark, sf_dir).select("doc", "page", "text"), asked)


# --- policies, matching, coverage --------------------------------------------------------------------------------------


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(policy, sequence_no, gap_id, text): the passages cited for a directive as one policy, a page for each that has text."""
    rows = spread(table(spark, sf_dir, "gap_assessment")).select(F.col("doc").alias("policy"), "sequence_no", "gap_id", whole(F.col("corresponding_policy_text")).alias("t"))
    page = F.concat(F.lit("--- Page "), F.col("sequence_no").cast("string"), F.lit(" ---\n"), "t")
    return rows.filter(strip(F.col("t")) != "").select("policy", "sequence_no", "gap_id", page.alias("text"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_policies(_policies(spark, sf_dir), order=["sequence_no", "gap_id"], block=_block())


def _review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "gap_assessment")
    return rows.select(
        "gap_id", F.col("doc").alias("policy"), "section", whole(F.col("obligation")).alias("obligation"), whole(F.col("language_from_directive")).alias("language_from_directive"), "obligation_category", "primary_responsible_department"
    )


def policy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clause_rows(spark, sf_dir)
    return rows.select("clause_id", F.array_join(F.slice(rules.keywords(F.col("wording")), 1, 35), " ").alias("terms"))


def keyword_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = keyword_match(_review_rows(spark, sf_dir), _chunks(spark, sf_dir))
    return matched.select("gap_id", F.round("keyword_score", 9).alias("keyword_score"), "match_page", "match_text")


def hybrid_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = hybrid_match(_review_rows(spark, sf_dir), _chunks(spark, sf_dir))
    return matched.select("gap_id", F.round("score", 9).alias("score"), F.round("keyword_score", 9).alias("keyword_score"), "match_page", "match_text")


def title_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of a match, between each title and the next one of its section."""
    rows = table(spark, sf_dir, "directives").select("seq", "section", whole(F.col("title")).alias("a"))
    pairs = rows.withColumn("b", F.lead("a").over(Window.partitionBy("section").orderBy("seq"))).filter("b is not null")
    scored = pairs.select("seq", similarity(F.col("a"), F.col("b")).alias("s"), keyword_score(F.col("a"), F.col("b")).alias("k"))
    return scored.select("seq", F.round("s", 9).alias("similarity"), F.round("k", 9).alias("keyword_score"), F.round(F.col("k") * KEYWORD_WEIGHT + F.col("s") * FUZZY_WEIGHT, 9).alias("score"))


_ASSESSED = ("gap_id", "coverage_status", "policy_gap_and_recommendations", "policy_page", "corresponding_policy_text", "priority")


def gap_assessment_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = keyword_match(_review_rows(spark, sf_dir), _chunks(spark, sf_dir))
    return cov.assess(matched).select(*_ASSESSED)


def gap_assessment_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = hybrid_match(_review_rows(spark, sf_dir), _chunks(spark, sf_dir))
    return cov.assess(matched).select(*_ASSESSED)


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gap_assessment")


def gap_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_assessed(spark, sf_dir), "coverage_status", "coverage_status", F.col("gap_id"))


def gap_priority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.value_counts(_assessed(spark, sf_dir), "priority", "priority", F.col("gap_id"))


def gap_category_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.pair_counts(_assessed(spark, sf_dir), "obligation_category", "coverage_status")


def gap_department_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.pair_counts(_assessed(spark, sf_dir), "primary_responsible_department", "coverage_status")


def gap_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.gap_kpis(_assessed(spark, sf_dir))


# --- catalogue ---------------------------------------------------------------------------------------------------------


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "directives")
    return rows.select("seq", *cat.COLUMNS)


def catalogue_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows built again from what a list endpoint would deliver."""
    rows = table(spark, sf_dir, "directives")
    items = rows.select(
        "seq",
        whole(F.col("title")).alias("Title"),
        F.col("source_link").alias("FileRef"),
        F.col("filename").alias("FileLeafRef"),
        F.when(F.col("seq") % 3 != 0, F.col("category")).alias("Category1"),
        F.when(F.col("year") != "Unknown", F.col("year")).alias("Year"),
        F.col("description").alias("Document_x0020_no"),
    )
    return cat.from_rest_items(items, BASE_URL).select("seq", "id", "title", "section", "category", "year", "source_link", "filename", "description")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "directives")
    tag = F.concat(F.lit('<li><a class="doc" href="'), "source_link", F.lit('"><b>'), whole(F.col("title")), F.lit("</b></a></li>"))
    return rows.select(F.col("seq").alias("page_id"), tag.alias("html"))


def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cat.anchors(_html(spark, sf_dir)).select(F.col("page_id").alias("seq"), "label", "href")
    return cat.from_anchors(links, BASE_URL).select("seq", "id", "title", "section", "year", "source_link", "filename")


def category_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "directives")
    text = F.concat(F.lit("Category1 : "), "category", F.lit(" ("), (F.col("seq") % 1000).cast("string"), F.lit(")"))
    return cat.category_counts(rows.select(F.col("seq").alias("page_id"), text.alias("text")))


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "directives").filter(F.col("local_path").isNotNull())
    files = rows.select("seq", F.col("filename").alias("name"), F.col("local_path").alias("path"))
    return cat.from_files(files, BASE_URL).select("seq", "id", "title", "section", "year", "filename", "local_path")


def catalogue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.dedupe(_catalogue(spark, sf_dir))


def layered_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir)
    kinds = [rows.filter(F.col("source_type") == k) for k in ("Nothing", "Public HTML", "Reference file")]
    return cat.layered(*kinds).select("seq", "id", "source_type")


def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.filter_catalogue(_catalogue(spark, sf_dir), "Retirement Fund", "Unknown").select("seq", "id", "section", "category", "year")


def catalogue_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.metadata(_catalogue(spark, sf_dir))


def catalogue_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.catalogue_kpis(_catalogue(spark, sf_dir))


def catalogue_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows, as the page shows them."""
    return cat.display_table(_catalogue(spark, sf_dir))


def _download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir)
    asked = rows.select(F.col("seq").alias("pos"), F.when(F.col("seq") % 11 == 0, F.reverse("id")).otherwise(F.col("id")).alias("id"))
    held = rows.filter("downloaded").select(F.col("filename").alias("name"))
    there = rows.filter("local_path is not null and not downloaded").select(F.col("local_path").alias("path"))
    return cat.plan_downloads(asked, rows, held, there)


def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _download_plan(spark, sf_dir)


def download_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return download_log(_download_plan(spark, sf_dir))


def download_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of fetched bytes, with the length of the link standing in for their size."""
    rows = table(spark, sf_dir, "directives")
    kind = F.when(F.col("seq") % 2 == 0, "application/pdf").otherwise("text/html")
    name = F.when(F.col("seq") % 3 == 0, F.lit("page.html")).otherwise(F.col("filename"))
    return rows.select("seq", cat.accept_download(F.length("source_link") + F.col("seq") % 60, kind, name).alias("accepted"))


def mark_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir)
    done = rows.filter("source_type = 'Public HTML'").select("id")
    return cat.mark_downloaded(rows, done).select("seq", "id", "cached", "downloaded")


def process_log_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue(spark, sf_dir)
    return append(
        counted(rows, "Results", "Completed", "Catalogue rows"),
        counted(cat.filter_catalogue(rows, "Retirement Fund"), "Filter", "Completed", "Applied filters: section=Retirement Fund, year=All"),
    )


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that repeat, some of which end in a number themselves; the downloaded directives of even number are there already."""
    rows = table(spark, sf_dir, "directives")
    number = F.when(F.col("seq") % 7 == 0, "_2").when(F.col("seq") % 11 == 0, "_3").otherwise("")
    name = F.concat("section", number, F.when(F.col("year") == "Unknown", "").otherwise(".pdf"))
    held = rows.filter("downloaded and seq % 2 = 0").select(F.concat("category", F.lit("_4.pdf")).alias("name"))
    return cat.unique_names(rows.select("seq", name.alias("filename")), held)


def category_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.category_total(category_scrape(spark, sf_dir))


def library_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference files against a library that holds those already downloaded."""
    rows = table(spark, sf_dir, "directives")
    files = rows.filter(F.col("local_path").isNotNull()).select("seq", F.col("filename").alias("name"), F.col("local_path").alias("path"))
    return cat.from_files(files, BASE_URL, rows.filter("downloaded").select(F.col("filename").alias("name"))).select("seq", "filename", "cached", "downloaded")


def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items whose links are absolute, rooted or relative."""
    rows = table(spark, sf_dir, "directives")
    path = F.concat("id", F.lit("_"), F.col("seq").cast("string"), F.lit(".pdf"))
    ref = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("/files/"), path)).when(F.col("seq") % 3 == 1, path).otherwise(F.concat(F.lit("https://other.example/"), path))
    items = rows.select("seq", F.lit("Directive").alias("Title"), ref.alias("FileRef"))
    return cat.from_rest_items(items, BASE_URL + "/lists/all").select("seq", "source_link", "filename")


def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of the register extracted from each directive's file."""
    return table(spark, sf_dir, "directives").select("seq", export_name(F.col("filename"), "_obligation_extraction.csv").alias("name"))


def gap_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.filter_status(_assessed(spark, sf_dir), cov.PARTIAL).select("gap_id", "coverage_status", "priority")


def gap_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the review as a page shows them: label of the column, text of the value."""
    names = ("support_function", "policy_page", "corresponding_policy_text", "priority")
    cells = F.array(*[F.struct(header_label(F.lit(n)).alias("label"), shown(F.col(n)).alias("value")) for n in names])
    return _assessed(spark, sf_dir).select("gap_id", F.explode(cells).alias("cell")).select("gap_id", "cell.*")


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "directives")
    return rows.select("seq", safe_filename(whole(F.col("title"))).alias("name"), rules.year_of(whole(F.col("title"))).alias("year"), rules.directive_number(whole(F.col("title"))).alias("number"))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered for display, with the library's defaults."""
    rows = table(spark, sf_dir, "directives")
    n = F.row_number().over(Window.partitionBy("section").orderBy("seq"))
    return rows.select("seq", "section", n.alias("doc_no"), first_filled(F.when(F.col("downloaded"), F.col("filename")), F.lit("Not downloaded")).alias("file"))


QUERIES = (
    p1_found, p1_reasons, p1_rows, page_render, clause_breakdown, obligation_register, category_counts, department_counts, priority_counts,
    actionable_counts, register_kpis, register_filter, register_options, ocr_candidates, page_lookups, policy_chunks, keyword_terms,
    keyword_best_match, hybrid_best_match, gap_assessment_keyword, gap_assessment_full, gap_status_counts, gap_priority_counts,
    gap_category_status, gap_department_status, gap_kpis, catalogue_normalise, anchor_extract, category_scrape, reference_files,
    catalogue_dedupe, layered_catalogue, catalogue_filter, catalogue_metadata, catalogue_kpis, catalogue_table, download_plan,
    download_messages, download_accept, mark_downloaded, process_log_union, unique_names, safe_names, document_numbers,
    title_match_score, category_total, library_flags, relative_links, export_names, gap_status_filter, gap_display,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}

