from pyspark.sql import functions as F

from regloom.joins import lookup_join


def test_salted_join_equals_broadcast_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"), F.lit(0).alias("salt"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner"):
        a = sorted(map(tuple, lookup_join(big, small, ["k"], how).select("k", "v", "w").collect()), key=str)
        b = sorted(map(tuple, lookup_join(big, small, ["k"], how, limit=0, salts=5).select("k", "v", "w").collect()), key=str)
        assert a == b


def test_lookup_beyond_the_limit_is_not_broadcast_by_the_planner(spark):
    """The planner goes by file sizes; a lookup that was measured to be too large must not reach the driver that way."""
    big, small = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    for salts in (1, 4):
        plan = lookup_join(big, small, ["k"], limit=0, salts=salts)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
