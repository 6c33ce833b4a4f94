"""Session defaults, the shared checkpoint folder and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword arguments use ``__`` for dots."""
    b = SparkSession.builder.master(master).appName("regloom")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions)}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on executors and set a checkpoint folder; idempotent per context.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session
    that names none gets a temporary one.
    """
    sc = spark.sparkContext
    if getattr(sc, "_regloom_ready", False):
        return spark
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="regloom-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    if not _is_local(spark):
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="regloom-package-")) / "regloom.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join("regloom", p.relative_to(root)))
        sc.addPyFile(str(target))
    sc._regloom_ready = True
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _run_folder(spark: SparkSession) -> str:
    """Folder of this application under the shared checkpoint folder."""
    prepare(spark)
    sc = spark.sparkContext
    return f"{sc._jsc.sc().getCheckpointDir().get()}/regloom-{sc.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Deletes the shuffle files of a query as soon as it has ended, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors. ``release`` deletes what was written, ``discard`` one table.

    The shuffle files of the write are deleted with it, as nothing reads them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._regloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` returned, once nothing lazy reads it any more."""
    _delete(df.sparkSession, df._regloom_path)


def release(spark: SparkSession) -> None:
    """Delete all tables this application has written by ``materialise``; results that were not yet computed from them are lost."""
    _delete(spark, _run_folder(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
