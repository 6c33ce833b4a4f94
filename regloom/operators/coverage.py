"""Coverage decision, recommendation and priority of each register row, and the counts of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regloom.functions.rules import escalates, is_informational, is_negative
from regloom.operators.match import NO_MATCH
from regloom.operators.register import unpivot_kpis

COVERED, PARTIAL, MISSING, NOT_APPLICABLE = "Completely Covered", "Partially Covered", "Completely Missing", "Not Applicable / Informational"
COVERED_SCORE, COVERED_KEYWORDS, PARTIAL_SCORE, PARTIAL_KEYWORDS = 0.56, 0.34, 0.27, 0.18

# Texts of the review.
NO_EVIDENCE_NEEDED = "No policy evidence required because the directive item is informational/background only."
ADVICE = {
    "covered": "No gap identified. No policy update is required based on the matched policy evidence.",
    "partial": (
        "Policy partially addresses the topic but does not fully evidence the regulatory requirement. "
        "Update the policy to explicitly cover the missing obligation elements, owner, control evidence, and review frequency."
    ),
    "negative": (
        "Policy evidence indicates this requirement is not currently defined or mandatory. "
        "Add a specific policy clause to address the obligation and assign ownership for implementation and evidence retention."
    ),
    "missing": (
        "No directly supporting policy text was identified. Add a new policy clause addressing this obligation, including ownership, controls, monitoring, and evidence requirements."
    ),
    "informational": (
        "This directive section is background or contextual and does not create a direct policy action; "
        "no policy amendment is required unless management wants to reference it for completeness."
    ),
}


def coverage_status(score: Column, keyword_score: Column, informational: Column, negative: Column, escalating: Column) -> Column:
    """Informational first, then negative evidence, then the thresholds (all inclusive)."""
    return (
        F.when(informational, NOT_APPLICABLE)
        .when(negative & escalating, MISSING)
        .when(negative, PARTIAL)
        .when((score >= COVERED_SCORE) & (keyword_score >= COVERED_KEYWORDS), COVERED)
        .when((score >= PARTIAL_SCORE) | (keyword_score >= PARTIAL_KEYWORDS), PARTIAL)
        .otherwise(MISSING)
    )


def recommendation(status: Column, negative: Column) -> Column:
    return (
        F.when(status == COVERED, ADVICE["covered"])
        .when(status == PARTIAL, ADVICE["partial"])
        .when((status == MISSING) & negative, ADVICE["negative"])
        .when(status == MISSING, ADVICE["missing"])
        .otherwise(ADVICE["informational"])
    )


def gap_priority(status: Column, existing: Column | None = None) -> Column:
    """High for missing, Medium for partial; otherwise the priority at hand or Low."""
    kept = F.lit("Low") if existing is None else F.coalesce(F.nullif(existing, F.lit("")), F.lit("Low"))
    return F.when(status == MISSING, "High").when(status == PARTIAL, "Medium").otherwise(kept)


def assess(matched: DataFrame, existing_priority: str | None = None) -> DataFrame:
    """Register rows with a match (score, keyword_score, match_page, match_text) to assessed rows."""
    flags = matched.withColumns(
        {
            "informational": is_informational(F.col("obligation"), F.col("language_from_directive")),
            "negative": is_negative(F.col("match_text")),
            "escalating": escalates(F.col("obligation"), F.col("language_from_directive")),
        }
    )
    status, negative = F.col("coverage_status"), F.col("negative")
    rows = flags.withColumn("coverage_status", coverage_status(F.col("score"), F.col("keyword_score"), F.col("informational"), negative, F.col("escalating")))
    hidden = (status == MISSING) & ~negative
    masked = lambda absent, instead, found: F.when(hidden, absent).when(status == NOT_APPLICABLE, instead).otherwise(found)
    return rows.withColumns(
        {
            "policy_gap_and_recommendations": recommendation(status, negative),
            "policy_page": masked("Not located", "Not applicable", F.col("match_page")),
            "corresponding_policy_text": masked(NO_MATCH, NO_EVIDENCE_NEEDED, F.col("match_text")),
            "priority": gap_priority(status, F.col(existing_priority) if existing_priority else None),
        }
    ).drop("match_page", "match_text", "score", "keyword_score", "informational", "negative", "escalating")


def gap_kpis(assessed: DataFrame) -> DataFrame:
    """(ord, label, value): rows and rows by status."""
    one = assessed.agg(
        F.count("*").alias("a"), *[F.count_if(F.col("coverage_status") == s).alias(k) for k, s in (("b", COVERED), ("c", PARTIAL), ("d", MISSING))]
    )
    return unpivot_kpis(one, (("a", "Total Obligations"), ("b", COVERED), ("c", PARTIAL), ("d", MISSING)))


def filter_status(assessed: DataFrame, status: str | None = None) -> DataFrame:
    """Rows of one coverage status; ``All`` or nothing means any."""
    return assessed if not status or status == "All" else assessed.filter(F.col("coverage_status") == status)
