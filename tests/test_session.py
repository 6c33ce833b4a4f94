"""What the shared folder and the local disks hold after a table was written."""

import os

from pyspark.sql import functions as F

from regloom.session import discard, materialise


def _shuffle_files(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.startswith("shuffle_") and f.endswith(".data") for d in root for _, _, files in os.walk(d) for f in files)


def test_shuffle_files_go_with_the_write_and_a_discarded_table_with_its_folder(spark):
    before = _shuffle_files(spark)
    table = materialise(spark.range(20_000).repartition(4).groupBy((F.col("id") % 5_000).alias("k")).count(), "test")
    assert table.count() == 5_000
    written = _shuffle_files(spark) - before
    assert written <= 1, written  # at most that of the count just made
    path = table._regloom_path.removeprefix("file:")
    assert os.path.isdir(path)
    discard(table)
    assert not os.path.exists(path)
