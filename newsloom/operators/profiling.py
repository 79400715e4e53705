"""Corpus profile: counts, distributions and text-length statistics.

Statistics that need order (quartiles, histogram, whiskers) are computed from
a (class, length, count) table.  It comes out of one partial aggregate and has
as many rows as there are distinct lengths, so the big table is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X
from newsloom.operators import schema as S
from newsloom.operators.filters import nonempty_mask


def count_nonempty(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.agg(F.count_if(nonempty_mask(df, text_col)).alias("n_nonempty"))


def has_text(
    df: DataFrame, text_col: str = "text", min_ratio: float = K.MIN_TEXT_RATIO
) -> DataFrame:
    """One row: does the share of filled texts reach the ratio."""
    usable = F.count_if(nonempty_mask(df, text_col))
    n = F.count(F.lit(1))
    return df.agg(
        F.coalesce(F.try_divide(usable, n) >= min_ratio, F.lit(False)).alias("has_text")
    )


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(S._q(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Share of each class among labelled rows; the total is a one-row side."""
    counts = label_distribution(df.where(S._q(label_col).isNotNull()), label_col)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", (F.col("n") / F.col("total")).alias("share"))


def word_count_stats(df: DataFrame, count_col: str = "word_count") -> DataFrame:
    x = X.to_number(S._q(count_col))
    return df.agg(
        F.min(x).alias("min_words"), F.max(x).alias("max_words"), F.avg(x).alias("mean_words")
    )


def source_summary(df: DataFrame, source_col: str = "outlet_name") -> DataFrame:
    """Distinct non-null sources and their rows."""
    return (
        df.where(S._q(source_col).isNotNull())
        .groupBy(S._q(source_col).cast("string").alias("source"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def profile_report(df: DataFrame) -> DataFrame:
    """Scalar part of the profile, one row.

    The table is first folded to one row per source, so that the distinct
    count needs no second copy of the data.
    """
    found = S.detect_standard_columns(df)
    text, source, words = found["text"], found["outlet_name"], found["word_count"]
    key = S._q(source).cast("string") if source else F.lit(None).cast("string")
    wc = X.to_number(S._q(words)) if words else F.lit(None).cast("double")
    per_source = df.groupBy(key.alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(nonempty_mask(df, text or "")).alias("n_text"),
        F.min(wc).alias("lo"),
        F.max(wc).alias("hi"),
        F.sum(wc).alias("total"),
        F.count(wc).alias("n_wc"),
    )
    missing_meta = [c for c in K.METADATA_REQUIRED if not found[c]]
    missing_full = [c for c in K.FULLTEXT_REQUIRED if not found[c]]
    n_text = F.coalesce(F.sum("n_text"), F.lit(0))
    return per_source.agg(
        F.when(n_text > 0, K.MODE_FULLTEXT).otherwise(K.MODE_METADATA).alias("dataset_mode"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(text is not None).alias("has_text_column"),
        (n_text > 0).alias("has_usable_text"),
        n_text.alias("non_empty_text_rows"),
        F.lit(", ".join(missing_meta)).alias("missing_metadata_columns"),
        F.lit(", ".join(missing_full)).alias("missing_fulltext_columns"),
        F.count("source").alias("n_sources"),
        F.min("lo").alias("min_words"),
        F.max("hi").alias("max_words"),
        F.try_divide(F.sum("total"), F.sum("n_wc")).alias("mean_words"),
    )


# ---------------------------------------------------------------------------
# text length


def length_counts(df: DataFrame, text_col: str = "text", by: str | None = None) -> DataFrame:
    """(class, n_words, n) table all length statistics are computed from."""
    keys = ([S._q(by).alias(by)] if by else []) + [X.word_count(S._q(text_col)).alias("n_words")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _quartile(p: float):
    return F.percentile("n_words", F.lit(p), F.col("n"))


def length_describe(counts: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max."""
    x, n = F.col("n_words").cast("double"), F.col("n")
    total, mean = F.sum(n), F.sum(x * n) / F.sum(n)
    moments = counts.agg(
        total.alias("count"),
        mean.alias("mean"),
        F.min("n_words").alias("min"),
        _quartile(0.25).alias("q25"),
        _quartile(0.5).alias("q50"),
        _quartile(0.75).alias("q75"),
        F.max("n_words").alias("max"),
    )
    spread = counts.join(F.broadcast(moments)).agg(
        F.sqrt(
            F.try_divide(
                F.sum(n * F.pow(x - F.col("mean"), 2)), F.max("count") - 1
            )
        ).alias("std")
    )
    return moments.join(F.broadcast(spread))


def length_histogram(counts: DataFrame, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between smallest and largest; the largest value falls
    into the last bin.  Empty bins have no row."""
    bounds = counts.agg(F.min("n_words").alias("lo"), F.max("n_words").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor((F.col("n_words") - F.col("lo")) / width), F.lit(bins - 1))
    return (
        counts.join(F.broadcast(bounds))
        .groupBy(F.when(width > 0, slot).otherwise(F.lit(0)).alias("bin"))
        .agg(F.sum("n").alias("n"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))
    )


def length_box(counts: DataFrame, by: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 times their distance, outliers per class."""
    box = counts.groupBy(by).agg(
        _quartile(0.25).alias("q25"), _quartile(0.5).alias("q50"), _quartile(0.75).alias("q75")
    )
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("n_words").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        counts.join(box, by)
        .groupBy(by, "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, F.col("n_words"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("n_words"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
        )
    )


# ---------------------------------------------------------------------------
# terms, collection, columns


def top_terms(df: DataFrame, text_col: str = "text", k: int = K.TOP_TERMS, stop_words=K.STOP_WORDS) -> DataFrame:
    """The k most frequent terms; ties are broken by the term."""
    return (
        df.select(F.explode(X.tokens(text_col, stop_words)).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "term")
        .limit(k)
    )


def collection_stats(df: DataFrame, outlet_col: str, kept, words_col: str) -> DataFrame:
    """Pages, kept and skipped pages, words and success rate per outlet, with a
    total row (outlet null)."""
    n_words = F.when(kept, F.col(words_col))
    per_outlet = df.groupBy(S._q(outlet_col).alias("outlet_name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kept).alias("k"),
        F.coalesce(F.sum(n_words), F.lit(0)).alias("w"),
    )
    return (
        per_outlet.rollup("outlet_name")
        .agg(
            F.sum("n").alias("n_pages"),
            F.sum("k").alias("n_kept"),
            F.sum(F.col("n") - F.col("k")).alias("n_skipped"),
            F.sum("w").alias("total_words"),
        )
        .withColumn("mean_words", F.coalesce(F.try_divide(F.col("total_words"), F.col("n_kept")), F.lit(0.0)))
        .withColumn("success_rate", F.try_divide(F.col("n_kept"), F.col("n_pages")))
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Column, type and filled values, one scan for all columns."""
    counted = df.agg(*[F.count(S._q(c)).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_n"))
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            S._q(name).alias("non_null"),
            F.col("_n").alias("n_rows"),
        )
        for name, dtype in df.dtypes
    ]
    return counted.select(F.inline(F.array(*rows)))
