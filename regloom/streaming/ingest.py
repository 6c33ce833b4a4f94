"""Documents that arrive as files become register rows, incrementally.

The same column expressions run on a stream. Pages of one document arrive in one JSON line ``{"doc", "pages": [{"page",
"text"}]}``, so each document is complete in its micro-batch and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regloom.operators.clauses import clauses, render_pages
from regloom.operators.register import obligations

DOCUMENT = "doc string, pages array<struct<page:int,text:string>>"


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of (doc, pages) from JSON lines dropped into a folder."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def register_batch(batch: DataFrame) -> DataFrame:
    """Register rows of a batch of documents; a document that comes twice in a batch counts once, its last pages winning."""
    pages = batch.select("doc", F.posexplode("pages").alias("at", "p")).groupBy("doc", F.col("p.page").alias("page")).agg(F.max_by("p.text", "at").alias("text"))
    return obligations(clauses(render_pages(pages)))


def start_register_stream(spark: SparkSession, path: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the register rows of new documents to ``target``; each batch has a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        register_batch(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = document_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def category_stream(documents: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Running counts by category and window of arrival from a stream with ``arrived_at``, ``wording``; late rows are dropped after ``watermark``."""
    from regloom.functions.rules import category

    rows = documents.withWatermark("arrived_at", watermark).withColumn("category", category(F.lower("wording")))
    return rows.groupBy(F.window("arrived_at", window), "category").agg(F.count("*").alias("rows"))
