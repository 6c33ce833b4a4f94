"""Process log rows: (seq, stage, status, message, row_count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq int, stage string, status string, message string, row_count long"


def log(spark: SparkSession, entries: Sequence[tuple[str, str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(i + 1, *e) for i, e in enumerate(entries)], SCHEMA)


def append(*logs: DataFrame) -> DataFrame:
    """Logs one after the other, numbered through; logs have a few rows."""
    joined = None
    for i, part in enumerate(logs):
        part = part.withColumn("part", F.lit(i))
        joined = part if joined is None else joined.unionByName(part)
    return joined.withColumn("seq", F.row_number().over(Window.orderBy("part", "seq"))).drop("part")


def failed_endpoints(spark: SparkSession, errors: Sequence[tuple[str, str]]) -> DataFrame:
    """A log row for every list endpoint that failed, from (endpoint, error)."""
    return log(spark, [("List Scan", "Failed", f"{endpoint}: {error}", 0) for endpoint, error in errors])


def found(rows: DataFrame, stage: str, message: str, otherwise: str) -> DataFrame:
    """As ``counted``, with status Failed and the other message if the frame is empty."""
    some = F.col("row_count") > 0
    status, text = F.when(some, "Completed").otherwise("Failed"), F.when(some, message).otherwise(otherwise)
    return counted(rows, stage, "", "").withColumns({"status": status, "message": text})


def counted(rows: DataFrame, stage: str, status: str, message: str) -> DataFrame:
    """A log row with the number of rows of a frame, computed with the rest of the plan."""
    return rows.agg(F.count("*").alias("row_count")).select(
        F.lit(1).alias("seq"), F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(message).alias("message"), "row_count"
    )
