"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import delete_folder, saved_at

#: A hub's edges are spread over so many join keys.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with the ``m`` of their ``u``; hubs are salted."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for every node of the edges (a, b: long).

    ``component`` is the smallest node that the edges reach. Every round hangs
    neighbours on the smallest node seen so far, first from larger neighbours,
    then from smaller ones, until nothing changes; the number of rounds grows
    with the logarithm of the longest chain. Each round is written and read back,
    so plans stay short and lost executors cost one round at most. Null ends and
    loops are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    links = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    seen, folder = None, None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _with_least(large, least).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select("u", "m")).distinct()
        )
        before = folder
        links, folder = saved_at(small, "components")
        found = links.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s"),
        ).first()
        state = (found["n"], found["x"], found["s"])
        if before:
            delete_folder(spark, before)
        if state == seen or found["n"] == 0:
            break
        seen = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct()
    )
