"""The three pipelines as dictionaries of lazy frames: crawl, extract, gap review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regloom.operators import catalogue as cat
from regloom.operators.clauses import clauses, render_pages
from regloom.operators.coverage import assess, gap_kpis
from regloom.operators.match import hybrid_match
from regloom.operators.policy import chunk_policies, readable
from regloom.operators.process_log import append, counted, failed_endpoints, found as counted_or_failed, log
from regloom.operators.register import obligations, pair_counts, register_kpis, value_counts


NOTHING_FOUND = "No directives were found in any source."


def crawl(sources: list[DataFrame], section: str | None = None, year: str | None = None, errors: Sequence[tuple[str, str]] = (), pages: DataFrame | None = None, source_url: str | None = None) -> dict[str, DataFrame]:
    """Catalogue of the first source with rows, filtered; ``sources`` are catalogue frames in order of preference.

    ``errors`` are the list endpoints that failed (``sources.remote.list_errors``), a log row each. ``pages`` (page_id, text) are public pages whose
    category counts are scraped.
    """
    found = cat.layered(*sources)
    shown = cat.filter_catalogue(found, section, year)
    message = f"Applied filters: section={section or 'All'}, year={year or 'All'}"
    scraped = {} if pages is None else {"category_counts": cat.category_counts(pages)}
    return scraped | {
        "catalogue": found,
        "records": shown,
        "metadata": cat.metadata(found, source_url),
        "kpis": cat.catalogue_kpis(shown),
        "logs": append(
            failed_endpoints(found.sparkSession, errors),
            counted_or_failed(found, "Results", "Catalogue rows", NOTHING_FOUND),
            counted(shown, "Filter", "Completed", message),
        ),
    }


def extract(pages: DataFrame) -> dict[str, DataFrame]:
    """Register of many documents at once from (doc, page, text).

    Every frame starts from ``obligations``; persist or write it first if several are wanted.
    """
    breakdown = clauses(render_pages(pages))
    rows = obligations(breakdown)
    order = F.struct("doc", "seq")
    return {
        "text_breakdown": breakdown,
        "obligations": rows,
        "category": value_counts(rows, "obligation_category", "category", order),
        "department": value_counts(rows, "primary_responsible_department", "department", order),
        "priority": value_counts(rows, "priority", "priority", order),
        "actionable": value_counts(rows, "actionable", "actionable", order),
        "kpis": register_kpis(rows),
        "logs": append(
            counted(pages.select("doc").distinct(), "Select PDF", "Completed", "Loaded documents"),
            counted(breakdown, "Breakdown", "Completed", "Generated clause-wise text breakdown"),
            counted(rows, "Extraction", "Completed", "Generated obligation register"),
        ),
    }


def review(register: DataFrame, policies: DataFrame, existing_priority: str | None = None) -> dict[str, DataFrame]:
    """Assessment of register rows (policy, seq, section, obligation, language_from_directive ...) against the policy they name.

    Policies with too little text are set aside in ``unreadable``.
    """
    checked = readable(policies)
    chunks = chunk_policies(checked.filter("readable").drop("readable"))
    assessed = assess(hybrid_match(register, chunks), existing_priority)
    order = F.struct("policy", "seq")
    return {
        "gap_assessment": assessed,
        "unreadable": checked.filter("not readable").select("policy"),
        "status": value_counts(assessed, "coverage_status", "coverage_status", order),
        "category": pair_counts(assessed, "obligation_category", "coverage_status"),
        "department": pair_counts(assessed, "primary_responsible_department", "coverage_status"),
        "priority": value_counts(assessed, "priority", "priority", order),
        "kpis": gap_kpis(assessed),
        "logs": append(
            counted(register, "Select Inputs", "Completed", "Validated obligation register and policy"),
            counted(assessed, "Gap Analysis", "Completed", "Mapped obligations to policy text using section-level evidence"),
            counted(assessed, "Results", "Completed", "Generated policy gap assessment outputs"),
        ),
    }


def download_log(plan: DataFrame) -> DataFrame:
    """Log rows of a download plan, in request order."""
    action = F.col("action")
    status = F.when(action == "unknown", "Failed").when(action == "cached", "Cached").when(action == "copy", "Completed").otherwise("Pending")
    message = (
        F.when(action == "unknown", F.concat(F.lit("Unknown directive id: "), "id"))
        .when(action == "cached", F.concat(F.lit("Already available: "), "filename"))
        .when(action == "copy", F.concat(F.lit("Copied reference directive into crawler library: "), "filename"))
        .otherwise(F.concat(F.lit("To be downloaded: "), "filename"))
    )
    return plan.select(
        F.col("pos").cast("int").alias("seq"), F.lit("Download").alias("stage"), status.alias("status"), message.alias("message"), F.when(action.isin("cached", "copy"), 1).otherwise(0).cast("long").alias("row_count")
    )


__all__ = ["crawl", "download_log", "extract", "log", "review"]
