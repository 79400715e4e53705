"""Order, top-k, first occurrence, caps and set operations on links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.operators.schema import _q


def freshest_first(df: DataFrame, time_col: str, *ties: str) -> DataFrame:
    """Newest first, rows without a time last."""
    return df.orderBy(F.desc_nulls_last(time_col), *ties)


def first_seen(df: DataFrame, key: str, time_col: str, *ties: str) -> DataFrame:
    """One row per key: the newest, ties by the given columns.

    A struct maximum instead of a window: copies of a key are folded before
    the shuffle, so a key that fills a third of the table stays cheap.
    """
    rest = [c for c in (*ties, *df.columns) if c not in (key, time_col)]
    rest = list(dict.fromkeys(rest))
    best = df.groupBy(key).agg(F.max(F.struct(*[_q(c) for c in (time_col, *rest)])).alias("_best"))
    return best.select(key, "_best.*")


def first_per_class(
    df: DataFrame, class_col: str, id_col: str, text_col: str, chars: int = K.EXAMPLE_CHARS
) -> DataFrame:
    """First row of each class by id, its text cut for display.

    Finds the ids in a narrow pass, then fetches only those texts.
    """
    firsts = df.where(_q(class_col).isNotNull()).groupBy(class_col).agg(F.min(id_col).alias(id_col))
    return df.join(firsts, [class_col, id_col]).select(
        class_col, id_col, F.left(_q(text_col), F.lit(chars)).alias("example")
    )


def cap_per_source(
    df: DataFrame, source_col: str, order: list[str], cap: int = K.SOURCE_CAP, salts: int = 64
) -> DataFrame:
    """The first ``cap`` rows of each source.

    Two rounds: each salt of a source keeps its first ``cap`` rows, then the
    at most ``salts * cap`` survivors compete.  A huge source is spread over
    ``salts`` tasks in the first round.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    keys = [F.asc(o) for o in order]
    first = F.row_number().over(Window.partitionBy(source_col, "_salt").orderBy(*keys))
    final = F.row_number().over(Window.partitionBy(source_col).orderBy(*keys))
    return (
        df.withColumn("_salt", salt)
        .withColumn("_r", first)
        .where(F.col("_r") <= cap)
        .withColumn("_r", final)
        .where(F.col("_r") <= cap)
        .drop("_salt", "_r")
    )


def union_links(*frames: DataFrame, key: str = "url") -> DataFrame:
    """Union of link sets without repeats."""
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.unionByName(f.select(key))
    return out.dropDuplicates([key])


def unseen(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key was not seen before."""
    return df.join(seen.select(key), key, "left_anti")


def best_model(results: DataFrame, score: str, name: str = "Model") -> DataFrame:
    """Model of the highest score; ties go to the first name."""
    return results.orderBy(F.desc(_q(score)), _q(name)).limit(1)
