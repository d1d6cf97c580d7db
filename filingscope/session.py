"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "filingscope",
                driver_memory: str = "8g") -> SparkSession:
    """A session tuned for these workloads.

    ``shuffle_partitions`` and ``driver_memory`` only apply to a ``local`` master; on a cluster the submitted
    configuration decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if master and master.startswith("local"):
        b = (b.config("spark.driver.memory", driver_memory)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    b = (
        b.config("spark.sql.ui.retainedExecutions", "200")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # gone with the last reference to their frame
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only a ``local`` session (tests) that has none gets a private folder; on a cluster the setting is required.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        sc_dir = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not sc_dir and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = sc_dir or tempfile.mkdtemp(prefix="filingscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "filingscope-scratch", f"{label}-{uuid.uuid4().hex[:12]}")


def landed(df: DataFrame, label: str = "", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, a fresh folder of the shared location if not given, and read it from there.

    Unlike a checkpoint it is compressed, and a later pass reads only the columns it needs.  The folder stays until
    ``discard``; the shuffle files of the steps before it go.
    """
    path = path or scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    sweep(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a frame that ``landed`` returned; nothing may read it afterwards."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete_path(df.sparkSession, folder)


def sweep(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished steps.

    Its cleaner does so when the driver's JVM has collected what stands for them, which a small heap's worth of
    plans may put off to the end of the job.
    """
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote and needs no more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
