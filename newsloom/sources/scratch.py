"""A folder every executor can reach, for files a job writes and reads back."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows on its way to or from a Python worker, and the setting that says so.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about 4 MB (and a row at least).

    A worker holds a batch several times over, as bytes, as Python objects and as what
    is made of them; at Spark's 64 MB that grows with the table up to gigabytes for an
    executor. A lower setting of the user's stays.
    """
    before = spark.conf.get(_BATCH)
    if not before.rstrip("bB").isdecimal() or not 0 < int(before.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this process holds but no longer uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def then_given_back(function):
    """``function``; when it ends, its worker, which waits for tasks of other stages,
    keeps no more than it needs."""
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()
    return run


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    Only a local session without that setting falls back to a temporary
    folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        root = tempfile.mkdtemp(prefix="newsloom-")
    return f"{root.rstrip('/')}/{name}-{uuid4().hex}"


#: Bytes of a row group of scratch files. A task holds a whole one, writing and reading.
ROW_GROUP_BYTES = 16 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new scratch folder and read back: computed once, with no
    lineage left.

    Tables with texts, terms or vectors are stored, not cached: what doesn't fit the
    cache goes to disk as Java objects, and each task that writes or reads those holds
    up to a hundred batches of 4 MB that no memory manager knows of.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    # the size is looked at from the first row on, else only after a hundred, however long they are
    sizes = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size.row.check.min": 1}
    df.write.options(**sizes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
