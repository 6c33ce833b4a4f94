"""The obligation register: rows derived from clauses, its counts and key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regloom.functions import rules

#: Columns a register must have, in the order errors list them.
REQUIRED = ("Section", "Language from Directive", "Obligation", "Obligation Category", "Primary Responsible Department", "Support Function")
REGISTER = (*REQUIRED, "Priority", "Actionable")

# Cells that count as missing when a register is read.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NAMES = {
    "section": "Section",
    "language_from_directive": "Language from Directive",
    "obligation": "Obligation",
    "obligation_category": "Obligation Category",
    "primary_responsible_department": "Primary Responsible Department",
    "support_function": "Support Function",
    "priority": "Priority",
    "actionable": "Actionable",
    "coverage_status": "Coverage Status",
    "policy_gap_and_recommendations": "Policy Gap and Recommendations",
    "policy_page": "Policy Page",
    "corresponding_policy_text": "Corresponding Policy Text",
}


def obligations(clauses: DataFrame, keys: Sequence[str] = ("doc", "seq")) -> DataFrame:
    """One register row per clause (``keys``, section, wording), without an exchange."""
    kept = clauses.select(*keys, "section", "wording", F.lower("wording").alias("low"), rules.shortened(F.col("wording")).alias("short"))
    lowered = kept.withColumn("short_low", F.lower("short"))
    low = F.col("low")
    return lowered.select(
        *keys,
        "section",
        F.col("wording").alias("language_from_directive"),
        rules.obligation_text(F.col("section"), F.col("short"), F.col("short_low")).alias("obligation"),
        rules.category(low).alias("obligation_category"),
        rules.department(low).alias("primary_responsible_department"),
        rules.support_function(low).alias("support_function"),
        rules.priority(low).alias("priority"),
        F.when(rules.is_actionable(low), "Yes").otherwise("No").alias("actionable"),
    )


def public_names(df: DataFrame) -> DataFrame:
    """The spaced column names of the exported tables."""
    return df.select(*[F.col(c).alias(NAMES.get(c, c)) for c in df.columns])


def normalise_register(frame: DataFrame) -> DataFrame:
    """Strip header names, require and project the required columns, missing values to empty strings.

    ValueError names the missing columns in order.
    """
    stripped = frame.toDF(*[c.strip() for c in frame.columns])
    missing = [c for c in REQUIRED if c not in stripped.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    keep = lambda c: F.when(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").isin(*NA_VALUES), "").otherwise(F.col(f"`{c}`").cast("string"))
    return stripped.select(*[keep(c).alias(c) for c in REQUIRED])


def value_counts(df: DataFrame, column: str, name: str, order: Column | None = None) -> DataFrame:
    """(name, Count), most frequent first; equal counts in the order of first appearance by ``order``."""
    first = F.min(order) if order is not None else F.min(column)
    counted = df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count"), first.alias("first_seen"))
    return counted.orderBy(F.desc("count"), "first_seen").drop("first_seen")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes of the groups that occur, keys ascending."""
    return df.groupBy(a, b).agg(F.count("*").alias("count")).orderBy(a, b)


def register_kpis(register: DataFrame) -> DataFrame:
    """(ord, label, value): sections, actionable rows, categories and departments in one aggregation."""
    one = register.agg(
        F.count("*").alias("a"),
        F.count_if(F.col("actionable") == "Yes").alias("b"),
        F.count_distinct("obligation_category").alias("c"),
        F.count_distinct("primary_responsible_department").alias("d"),
    )
    return unpivot_kpis(one, (("a", "Total Sections"), ("b", "Actionable Obligations"), ("c", "Categories"), ("d", "Departments")))


def unpivot_kpis(one: DataFrame, labels: Sequence[tuple[str, str]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(label).alias("label"), F.col(c).cast("long").alias("value")) for i, (c, label) in enumerate(labels)])
    return one.select(F.explode(entries).alias("k")).select("k.*")


def filter_register(register: DataFrame, category: str | None = None, department: str | None = None) -> DataFrame:
    """Rows of a category and a department; ``All`` or nothing means any."""
    if category and category != "All":
        register = register.filter(F.col("obligation_category") == category)
    if department and department != "All":
        register = register.filter(F.col("primary_responsible_department") == department)
    return register


def options(df: DataFrame, column: str, order: Column) -> DataFrame:
    """(ord, value): ``All`` and the filled distinct values in the order of first appearance."""
    found = df.filter(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.min(order).alias("ord"))
    every = df.sparkSession.range(1).select(F.lit("All").alias("value"), F.lit(-1).cast("long").alias("ord"))
    return every.unionByName(found.withColumn("ord", F.col("ord").cast("long"))).orderBy("ord", "value")
