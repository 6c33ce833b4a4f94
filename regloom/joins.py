"""Join helpers for skewed keys and for lookups whose size must be proven before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regloom.session import materialise

#: Largest lookup side, in bytes of its rows as counted, that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Bytes a row takes besides its strings, arrays and maps.
ROW_BYTES = 64


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take, counted in one pass over them; the plan of ``df`` runs once for it."""
    width = F.lit(ROW_BYTES)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    return df.select(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int | None = None,
    salts: int = 16,
) -> DataFrame:
    """Join rows to a lookup table that is unique on ``on``.

    The rows of the lookup are measured; up to ``limit`` bytes it is broadcast. Beyond it every lookup row is replicated ``salts`` times
    and the big side gets a salt by the hash of its row, so that a key holding a third of all rows is
    spread over ``salts`` tasks; with one salt (keys that are unique on both sides) it is a plain join. The planner, which goes by the size of files,
    is kept from broadcasting what was measured to be too large. All ways return the same rows.
    """
    if measured_bytes(small) <= (BROADCAST_BYTES if limit is None else limit):
        return big.join(F.broadcast(small), on, how)
    if salts == 1:
        return big.join(small.hint("merge"), on, how)
    taken = {c.lower() for c in [*big.columns, *small.columns]}
    salt = "salt"
    while salt in taken:
        salt = "_" + salt
    rest = [F.col(f"`{c}`") for c in big.columns]
    left = big.withColumn(salt, F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, salt], how).drop(salt)


#: Column that names the block of pairs in ``blocked``.
PAIR = "__pair"
#: Column that names the group of a pair of blocks in ``blocked``.
GROUP = "__group"
#: Rows of small keys that make one group.
GROUP_ROWS = 2048


def blocked(left: DataFrame, right: DataFrame, key: str, left_by: list[str], right_by: list[str], left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns ``PAIR`` and ``GROUP``, so that every pair of rows of a key meets in a group.

    The rows of a key are dealt out, by the hash of ``left_by`` and ``right_by``, into blocks of about ``left_rows`` and ``right_rows``;
    a pair of blocks is a group of its own, and keys of one block a side share groups, so a group may hold several keys.
    Rows whose key the other side lacks are left out.
    """
    count = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    blocks = lambda name, rows: F.ceil(F.col(name) / rows).cast("int")
    sizes = count(left, "__left").join(count(right, "__right"), key)
    sizes = materialise(sizes.select(key, blocks("__left", left_rows).alias("__l"), blocks("__right", right_rows).alias("__r"), (F.col("__left") + F.col("__right")).alias("__rows")), "blocks")
    l, r = F.col("__l"), F.col("__r")
    place = lambda columns, n: F.pmod(F.xxhash64(*columns), n).cast("int")
    a = lookup_join(left, sizes, [key], "inner").withColumn("__at", place(left_by, l)).withColumn(PAIR, F.explode(F.sequence(F.col("__at") * r, F.col("__at") * r + r - 1)))
    b = lookup_join(right, sizes, [key], "inner").withColumn("__at", place(right_by, r)).withColumn(PAIR, F.explode(F.transform(F.sequence(F.lit(0), l - 1), lambda i: i * r + F.col("__at"))))
    # few bytes, much work: as many tasks as the session has, whatever the size of the rows
    n = task_count(left.sparkSession)
    shared = max(4 * n, sizes.filter("__l * __r = 1").agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0] // GROUP_ROWS)
    group = F.when(l * r == 1, F.pmod(F.xxhash64(key), F.lit(shared))).otherwise(F.xxhash64(key, PAIR)).alias(GROUP)
    return tuple(x.select("*", group).drop("__l", "__r", "__at", "__rows").repartition(n, GROUP) for x in (a, b))


def task_count(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan that is read by fewer tasks than there are cores, dealt out to all of them; larger scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
