"""Stratified folds, source-aware folds and the held-out split.

Membership is decided on the (id, class) columns alone; texts never move.
Rows of a class are ordered by a seeded digest of their id, and a row's rank
in that order decides its place.  Ranks are computed without a window over a
whole class: the digest's first hex digits form buckets, bucket sizes are
summed up in a small table, and only the rank inside a bucket needs a sort.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.operators.schema import _q
from newsloom.sources.scratch import stored

#: Sources with at least this part of a class are dealt to group folds one by one.
PACKS = 4096


def shuffle_key(id_col: str, seed: int = K.SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _q(id_col).cast("string")))


def _keyed(df: DataFrame, id_col: str, label_col: str, seed: int, digits: int) -> DataFrame:
    return (
        df.select(_q(id_col).alias(id_col), _q(label_col).alias(label_col))
        .withColumn("_key", shuffle_key(id_col, seed))
        .withColumn("_bucket", F.substring("_key", 1, digits))
    )


def _buckets(keyed: DataFrame, label_col: str) -> DataFrame:
    """Rows per class and digest bucket; the plan's exchange serves ranks and quotas."""
    return keyed.groupBy(label_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))


def ranked(
    df: DataFrame, id_col: str, label_col: str, seed: int = K.SEED, bucket_digits: int = 3
) -> DataFrame:
    """(id, label, rank, before, class_size): 0-based rank in the class, number
    of rows in smaller classes' labels, and size of the class.

    The bucket table has at most ``16 ** bucket_digits`` rows per class.
    """
    keyed = _keyed(df, id_col, label_col, seed, bucket_digits)
    sizes = _buckets(keyed, label_col)
    earlier = Window.orderBy(label_col, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_class = Window.partitionBy(label_col)
    table = (
        sizes.withColumn("_global", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("class_size", F.sum("_n").over(of_class))
        .withColumn("before", F.min("_global").over(of_class))
    )
    inside = F.row_number().over(Window.partitionBy(label_col, "_bucket").orderBy("_key", id_col))
    return (
        keyed.withColumn("_inside", inside)
        .join(F.broadcast(table.drop("_n")), [label_col, "_bucket"])
        .select(
            id_col,
            label_col,
            (F.col("_global") - F.col("before") + F.col("_inside") - 1).alias("rank"),
            "before",
            "class_size",
        )
    )


def stratified_folds(
    df: DataFrame, id_col: str, label_col: str, n_folds: int = K.N_FOLDS, seed: int = K.SEED
) -> DataFrame:
    """(id, label, fold): class counts and fold sizes differ by at most one."""
    r = ranked(df, id_col, label_col, seed)
    return r.select(
        id_col, label_col, F.pmod(F.col("before") + F.col("rank"), F.lit(n_folds)).cast("int").alias("fold")
    )


def train_test_split(
    df: DataFrame,
    id_col: str,
    label_col: str,
    test_share: float = K.TEST_SHARE,
    seed: int = K.SEED,
) -> DataFrame:
    """(id, label, is_test): ``ceil(share * n)`` test rows, shared out to the
    classes by largest remainder (ties to the smaller label)."""
    r = ranked(df, id_col, label_col, seed)
    classes = _buckets(_keyed(df, id_col, label_col, seed, 3), label_col).groupBy(label_col).agg(F.sum("_n").alias("_n"))
    everything, by_rest = Window.partitionBy(F.lit(0)), Window.orderBy(F.desc("_rest"), label_col)
    quotas = (
        classes.withColumn("_total", F.sum("_n").over(everything))
        .withColumn("_n_test", F.ceil(F.col("_total") * F.lit(test_share)))
        .withColumn("_exact", F.col("_n") * F.col("_n_test") / F.col("_total"))
        .withColumn("_quota", F.floor("_exact"))
        .withColumn("_rest", F.round(F.col("_exact") - F.col("_quota"), 9))
        .withColumn("_left", F.col("_n_test") - F.sum("_quota").over(everything))
        .withColumn(
            "_quota", F.col("_quota") + F.when(F.row_number().over(by_rest) <= F.col("_left"), 1).otherwise(0)
        )
        .select(label_col, "_quota")
    )
    return r.join(F.broadcast(quotas), label_col).select(
        id_col, label_col, (F.col("rank") < F.col("_quota")).alias("is_test")
    )


def _dealt(items: dict[str, list[int]], n_folds: int) -> dict[str, int]:
    """Fold of each item, by its rows per class.

    Items come in order of the deviation of their class counts, then of their size,
    largest first, then by a digest. Each goes where the folds' shares of the classes
    then deviate least, summed over the classes; ties go to the fold with fewest rows,
    then to the first. Deviations are roots of whole numbers, so ties are true ties.
    """
    n_classes = len(next(iter(items.values()), []))
    totals = [sum(counts[c] for counts in items.values()) for c in range(n_classes)]
    squares, sums = [0] * n_classes, [0] * n_classes
    rows = [[0] * n_classes for _ in range(n_folds)]
    out = {}

    def order(item: str):
        counts = items[item]
        size = sum(counts)
        return size * size - n_classes * sum(n * n for n in counts), -size, hashlib.md5(item.encode()).hexdigest(), item

    for item in sorted(items, key=order):
        counts = items[item]

        def deviation(fold: int):
            score = 0.0
            for c, n in enumerate(counts):
                apart = n_folds * (squares[c] + 2 * n * rows[fold][c] + n * n) - (sums[c] + n) ** 2
                score += math.sqrt(apart) / totals[c]
            return score, sum(rows[fold]), fold

        fold = out[item] = min(map(deviation, range(n_folds)))[2]
        for c, n in enumerate(counts):
            squares[c] += 2 * n * rows[fold][c] + n * n
            sums[c] += n
            rows[fold][c] += n
    return out


def group_folds(
    df: DataFrame, source_col: str, label_col: str, n_folds: int = K.N_FOLDS, packs: int = PACKS
) -> DataFrame:
    """(source, fold): a source is in one fold, class shares balanced greedily.

    A source that holds 1/``packs`` of a class or more is dealt by itself. Smaller
    ones ride together in ``packs`` packs by a digest of their name, and a pack is
    dealt like a source. So the greedy choice sees at most ``packs * (classes + 1)``
    items, however many sources there are; ``df`` is read once, and sources never
    move but for being counted. Rows without a source get no fold; an empty table
    gives no rows.
    """
    per = (
        df.where(_q(source_col).isNotNull())
        .groupBy(_q(source_col).cast("string").alias("source"), _q(label_col).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per = stored(per, "sources")
    totals = {r["label"]: r["total"] for r in per.groupBy("label").agg(F.sum("n").alias("total")).collect()}
    classes = sorted(totals, key=lambda c: (c is None, c))
    n_of = [F.sum(F.when(F.col("label").eqNullSafe(F.lit(c)), F.col("n")).otherwise(0)) for c in classes]
    big = functools.reduce(
        operator.or_, [F.col(f"_{k}") * packs >= totals[c] for k, c in enumerate(classes)], F.lit(False)
    )
    pack = F.pmod(F.conv(F.substring(F.md5("source"), 1, 8), 16, 10).cast("long"), F.lit(packs)).cast("string")
    sources = (
        per.groupBy("source")
        .agg(*[n.alias(f"_{k}") for k, n in enumerate(n_of)], F.count(F.lit(1)).alias("_n"))
        .withColumn("_item", F.when(big, F.concat(F.lit("s"), "source")).otherwise(F.concat(F.lit("p"), pack)))
    )
    # at most packs * (classes + 1) rows
    counted = sources.groupBy("_item").agg(F.sum("_n"), *[F.sum(f"_{k}") for k in range(len(classes))]).collect()
    folds = _dealt({item: counts for item, _, *counts in counted}, n_folds)
    dealt = df.sparkSession.createDataFrame(list(folds.items()), "_item string, fold int")
    return sources.join(F.broadcast(dealt), "_item").select("source", "fold")


def assign_group_folds(df: DataFrame, folds: DataFrame, source_col: str) -> DataFrame:
    """Each row with its source's fold; AQE splits a source that fills a
    partition when the fold table is too large to be sent to every task."""
    return df.join(folds.withColumnRenamed("source", source_col), source_col)
