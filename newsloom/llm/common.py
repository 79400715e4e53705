"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.shipping import ship_package
from newsloom.sources.scratch import scratch_folder, then_given_back

#: Rows turned into Python objects at once inside a task.
SLICE_ROWS = 256
#: Bytes of text in such a slice.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder written by ``saved_at``, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a batch on its way to and from Python: whole texts, held on both sides.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH_ROWS rows for the jobs inside; the session's setting comes back.

    At Spark's default of 10,000 rows a task holds tens of megabytes of text several
    times over. Jobs of other threads of the session may see the lower number meanwhile.
    """
    before = spark.conf.get(_BATCH)
    lower = not 0 < int(before) <= BATCH_ROWS
    if lower:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        if lower:
            spark.conf.set(_BATCH, before)


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on every executor."""
    ship_package(df.sparkSession)
    return df.mapInArrow(then_given_back(function), schema)


def few_rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """Rows that the driver holds as a table whose size is known, so that a join sends
    it out; no Python worker is started to make it."""
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of texts and byte strings in each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Small cuts of the incoming batches, so few texts are Python objects at once: at
    most ``rows`` rows and ``size`` bytes of text, but for a single longer row."""
    for batch in batches:
        ends = np.cumsum(_row_bytes(batch))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def tiled(rows: DataFrame, keys: list[str], member: str, limit: int, name: str, counted: DataFrame | None = None) -> DataFrame:
    """Split the groups of ``keys`` that hold more than ``limit`` rows.

    Such a group is cut into m chunks by a hash of ``member``; a row goes to the
    m tiles (lo, hi) that hold its chunk, so that any two rows of the group meet
    in exactly one tile if their chunks differ, and in tile (c, c) otherwise.
    Adds ``chunk``, ``lo``, ``hi``; no group of (keys, lo, hi) holds more than
    about ``2 * limit`` rows. ``counted``: the same rows, their keys alone.
    """
    hot = saved(
        (counted or rows).groupBy(*keys).count().filter(F.col("count") > limit)
        .select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("chunks")),
        name,
    )
    out = rows.join(hot, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    out = out.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), member), "chunks").cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.struct(F.least("chunk", other).alias("lo"), F.greatest("chunk", other).alias("hi")),
    )
    return out.withColumn("tile", F.explode(tiles)).select(*[c for c in rows.columns], "chunk", "tile.lo", "tile.hi")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that join what the edges (a, b) join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Ordered:
    """Rows dealt to partitions by ascending id, without moving anything yet.

    ``parts`` ranges start at ids of the table (quantiles of the id column alone);
    ``part_of`` gives the range of a row, ``starts`` whether its id starts one.
    A null id comes first.
    """

    def __init__(self, df: DataFrame, id_column: str):
        number = F.coalesce(F.col(id_column).cast("double"), F.lit(float("-inf")))
        wanted = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ids = df.select(F.coalesce(F.col(id_column).cast("double"), F.lit(-1e308)).alias("id"))
        cuts = ids.approxQuantile("id", [k / wanted for k in range(wanted)], 1 / (8 * wanted))
        least = ids.agg(F.min("id")).first()[0]
        self.cuts = sorted({c for c in [least, *cuts] if c is not None})
        self.parts = max(1, len(self.cuts))
        self.number = F.greatest(number, F.lit(-1e308))

    def part_of(self, df: DataFrame) -> DataFrame:
        """``df`` with ``part`` (int) and ``starts`` (boolean)."""
        from pyspark.ml.feature import Bucketizer

        if len(self.cuts) < 2:
            return df.withColumn("part", F.lit(0)).withColumn("starts", F.lit(True))
        splits = [-float("inf"), *self.cuts[1:], float("inf")]
        numbered = df.withColumn("__number", self.number)
        dealt = Bucketizer(splits=splits, inputCol="__number", outputCol="__part", handleInvalid="keep").transform(numbered)
        cuts = F.array(*[F.lit(c) for c in self.cuts])
        dealt = dealt.withColumn("part", F.col("__part").cast("int"))
        return dealt.withColumn("starts", F.element_at(cuts, F.col("part") + 1) == F.col("__number")).drop("__number", "__part")
