"""The pN_ queries of this package; each reads its whole tables with the production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regloom.joins import lookup_join
from regloom.llm.leakage import leaked_passages
from regloom.llm.lookalikes import canonical_forms, lookalike_groups, lookalike_pairs
from regloom.llm.mixing import mix
from regloom.llm.neardup import NearDuplicates
from regloom.llm.quality import judge
from regloom.llm.scan_noise import repair_scans
from regloom.llm.sentences import sentences
from regloom.llm.splitter import split_oversized
from regloom.llm.tables import clause_items, regulation_items, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be split: the second piece exists."""
    return split_oversized(regulation_items(spark, sf_dir)).filter("n_pieces > 1 and piece_no = 1").select("item_table", "item_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(regulation_items(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(regulation_items(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_groups(regulation_items(spark, sf_dir))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_forms(regulation_items(spark, sf_dir), "text").select("item_table", "item_id", "canonical")


def duplicate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "directives").select(F.lit("directives").alias("item_table"), F.col("seq").alias("item_id"), F.col("title").alias("text"))
    clauses = table(spark, sf_dir, "directive_clauses").filter("lang = 'en'")
    return titles.unionByName(
        clauses.select(F.lit("directive_clauses").alias("item_table"), F.col("clause_id").alias("item_id"), F.col("language_from_directive").alias("text"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(duplicate_items(spark, sf_dir)).row_pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(duplicate_items(spark, sf_dir)).groups()


def unscanned_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses whose directive was not read from a scan."""
    scanned = table(spark, sf_dir, "directives").filter("source_type = 'Scanned archive'").select(F.col("id").alias("doc")).distinct()
    clauses = table(spark, sf_dir, "directive_clauses").select("clause_id", "doc", "language_from_directive")
    kept = lookup_join(clauses, scanned, ["doc"], "left_anti")
    return kept.select(F.lit("directive_clauses").alias("item_table"), F.col("clause_id").alias("item_id"), F.col("language_from_directive").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(unscanned_clauses(spark, sf_dir)).select(F.col("item_id").alias("clause_id"), "sent_end")


def p5_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(clause_items(spark, sf_dir))


def scan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause and policy texts with their document and page; the policy reviewed for a directive is a document of its own."""
    clauses = table(spark, sf_dir, "directive_clauses").select(
        F.lit("directive_clauses").alias("item_table"), F.col("clause_id").alias("item_id"), "doc", F.expr("try_cast(page as int)").alias("page"), F.col("language_from_directive").alias("text")
    )
    policies = table(spark, sf_dir, "gap_assessment").select(
        F.lit("gap_assessment").alias("item_table"),
        F.col("gap_id").alias("item_id"),
        F.concat(F.lit("policy of "), "doc").alias("doc"),
        F.expr("try_cast(policy_page as int)").alias("page"),
        F.col("corresponding_policy_text").alias("text"),
    )
    return clauses.unionByName(policies)


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = F.coalesce(F.col("source_type") == "Scanned archive", F.lit(False))
    titles = table(spark, sf_dir, "directives").select(F.col("id").alias("doc"), "title", scanned.alias("scanned"))
    return repair_scans(scan_items(spark, sf_dir), titles)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).filter(F.size("faults") > 0).select("item_table", "item_id")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("item_table", "item_id", "repaired", F.array_join("faults", ",").alias("faults"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_no")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the share of the item's passages in the document and the longest run of words."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual token shares of every listed source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))
    return judged.filter(F.col("kind").isin("list", "table", "junk")).select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p2_found, p2_pieces, p3_found, p3_groups, p3_canonical, p4_found, p4_groups, p5_found, p5_sentences,
        p6_found, p6_repaired, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_statistics,
    )
    return {f.__name__: f for f in every}
