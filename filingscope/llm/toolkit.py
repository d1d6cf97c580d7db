"""Helpers shared by the operators: bounded Arrow slices, lineage cuts in the shared folder, text keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.session import ensure_checkpoint_dir, sweep  # noqa: F401  (the operators take sweep from here)

#: Text bytes handed to numpy at once; a longer single text makes a slice of its own.
SLICE_BYTES = 2_000_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut`` returned; nothing may read it afterwards."""
    spark = df.sparkSession
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(col: Column) -> Column:
    """16 bytes that stand for a whole text: equal texts share it (null keeps null)."""
    return F.unhex(F.md5(col))


def trim() -> None:
    """Hand freed memory back: a Python worker lives on after its task, and in the pipeline after its stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; every row is kept once."""
    col = batch.column(column)
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(col).to_pylist()):
        n = n or 0
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 16
    if start < batch.num_rows:
        yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
               column: str = "text", limit: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``fn`` returns a batch in the order of ``schema``, or None for no rows.

    ``done`` runs at the end of each task, to let go of what ``fn`` keeps: workers live on.
    """

    def run(batches):
        import pyarrow.compute  # noqa: F401  (loads pa.compute in the worker)

        try:
            for batch in batches:
                for part in slices(batch, column, limit):
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            if done:
                done()
            trim()

    return df.mapInArrow(run, schema)
