"""Remote catalogue sources: captured JSON payloads, and a data source for live list endpoints."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

# Fields asked of the list and the alternative names they come under.
SELECTED = ("Id", "Title", "FileRef", "FileLeafRef", "Category", "Category1", "Year", "Document_x0020_no", "Document_x0020_Type", "Modified", "Created")
ALTERNATIVES = (*SELECTED, "Name", "FileDirRef", "Category0", "_x0059_ear", "DocumentNo", "Document Type")
TOP = 5000

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ALTERNATIVES])
PAYLOAD = T.StructType(
    [T.StructField("value", T.ArrayType(ITEM)), T.StructField("d", T.StructType([T.StructField("results", T.ArrayType(ITEM))]))]
)


def items_of(payloads: DataFrame) -> DataFrame:
    """(seq, fields...) from rows of (seq, json): ``value``, or else ``d.results``."""
    parsed = payloads.select("seq", F.from_json("json", PAYLOAD).alias("p"))
    rows = F.when(F.size("p.value") > 0, F.col("p.value")).otherwise(F.col("p.d.results"))
    exploded = parsed.select("seq", F.posexplode(rows).alias("at", "item"))
    return exploded.select((F.col("seq") * (1 << 32) + F.col("at")).alias("seq"), "item.*")  # no payload has as many items


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured payload files, one JSON document a file; files in the order of their names."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"))
    return items_of(files.select((F.rank().over(_by_path()) - 1).cast("long").alias("seq"), "json"))


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # one row a captured file, a handful


class _ListReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.endpoints = [e for e in options.get("endpoints", "").split("|") if e]
        self.timeout = float(options.get("timeout", "45"))
        self.top = int(options.get("top", str(TOP)))

    def read(self, partition) -> Iterator[tuple]:
        """Items of the first endpoint that has any; an endpoint that fails is passed over (see ``list_errors``)."""
        for i, item in enumerate(self.items([])):
            yield (i, *[None if item.get(n) is None else str(item.get(n)) for n in ALTERNATIVES])

    def items(self, errors: list[tuple[str, str]]) -> list[dict]:
        """The same items as they were delivered; (endpoint, error) of failed endpoints go to ``errors``."""
        for endpoint in self.endpoints:
            query = urllib.parse.urlencode({"$select": ",".join(SELECTED), "$top": str(self.top)})
            request = urllib.request.Request(f"{endpoint}?{query}", headers={"Accept": "application/json;odata=nometadata"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as response:
                    payload = json.load(response)
            except (OSError, ValueError) as e:
                errors.append((endpoint, f"{type(e).__name__}: {e}"))
                continue
            items = payload.get("value") or (payload.get("d") or {}).get("results") or []
            if items:
                return items
        return []


def list_errors(endpoints: str, timeout: float = 45) -> list[tuple[str, str]]:
    """(endpoint, error) of the endpoints, separated by ``|``, that fail before one has items; asks each for one item."""
    errors: list[tuple[str, str]] = []
    _ListReader({"endpoints": endpoints, "timeout": str(timeout), "top": "1"}).items(errors)
    return errors


class ListItems(DataSource):
    """``spark.read.format("list_items").option("endpoints", "url1|url2").load()``; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "list_items"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("seq", T.LongType()), *ITEM.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ListReader(self.options)
