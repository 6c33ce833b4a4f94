"""Running values along a document without a task that holds the document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regloom.joins import task_count


def running(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    block: Column,
    total: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    later: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds to each row, by ``key`` along ``order``: sums of the rows before it (``total``), the last value that is not null
    before it (``last``), and whether a condition holds for some row after it (``later``).

    ``block`` numbers runs of neighbouring rows in ascending order. A window goes over the sums of the blocks, another one over the
    rows of one block, so a key that holds a third of all rows is spread over its blocks.
    """
    total, last, later = total or {}, last or {}, later or {}
    values = {**total, **last, **later}
    own = rows.withColumns({"__block": block, **{f"__{n}": c for n, c in values.items()}})
    at = [F.col(c) for c in order]
    edge = own.groupBy(key, "__block").agg(
        *[F.sum(f"__{n}").alias(n) for n in total],
        *[F.max(F.when(F.col(f"__{n}").isNotNull(), F.struct(*at, F.col(f"__{n}").alias("__value"))))["__value"].alias(n) for n in last],
        *[F.max(f"__{n}").alias(n) for n in later],
    )
    by_block = Window.partitionBy(key).orderBy("__block")
    before, after = by_block.rowsBetween(Window.unboundedPreceding, -1), by_block.rowsBetween(1, Window.unboundedFollowing)
    edge = edge.select(
        key,
        "__block",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__edge_{n}") for n in total],
        *[F.last(n, ignorenulls=True).over(before).alias(f"__edge_{n}") for n in last],
        *[F.coalesce(F.max(n).over(after), F.lit(False)).alias(f"__edge_{n}") for n in later],
    )
    inside = Window.partitionBy(key, "__block").orderBy(*at)
    before, after = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    # what follows may be much work on few bytes: as many tasks as the session has
    dealt = own.repartition(task_count(rows.sparkSession), key, "__block")
    return dealt.join(edge, [key, "__block"]).select(
        *rows.columns,
        *[(F.col(f"__edge_{n}") + F.coalesce(F.sum(f"__{n}").over(before), F.lit(0))).alias(n) for n in total],
        *[F.coalesce(F.last(f"__{n}", ignorenulls=True).over(before), F.col(f"__edge_{n}")).alias(n) for n in last],
        *[(F.col(f"__edge_{n}") | F.coalesce(F.max(f"__{n}").over(after), F.lit(False))).alias(n) for n in later],
    )
