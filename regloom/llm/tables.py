"""Reading the test tables as items: (item_table, item_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clause_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "directive_clauses").select(
        F.lit("directive_clauses").alias("item_table"), F.col("clause_id").alias("item_id"), F.col("language_from_directive").alias("text")
    )


def policy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gap_assessment").select(
        F.lit("gap_assessment").alias("item_table"), F.col("gap_id").alias("item_id"), F.col("corresponding_policy_text").alias("text")
    )


def regulation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause texts and policy texts together."""
    return clause_items(spark, sf_dir).unionByName(policy_items(spark, sf_dir))
