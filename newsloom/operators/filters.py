"""Row filters and the data-set validation that goes with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X
from newsloom.operators.schema import _q, require_columns


def nonempty_mask(df: DataFrame, text_col: str = "text") -> Column:
    """Boolean column; all false where the column does not exist."""
    return X.is_nonempty(_q(text_col)) if text_col in df.columns else F.lit(False)


def remove_empty_text(df: DataFrame, text_col: str = "text", check: bool = True) -> DataFrame:
    """Drop rows without text.

    With ``check`` a job that stops at the first usable row runs, and an error
    is raised if there is none.
    """
    kept = df.where(nonempty_mask(df, text_col))
    if check and kept.select(F.lit(1)).isEmpty():
        raise ValueError("No row has any text: nothing is left after the empty ones go.")
    return kept


def removed_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows, rows kept and rows removed by the text filter, one aggregate."""
    keep = nonempty_mask(df, text_col)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(~keep).alias("n_removed"),
    )


def min_words_for(outlet: Column) -> Column:
    """Smallest accepted article of an outlet; null for unknown outlets."""
    out = None
    for key, (_, _, n) in K.OUTLETS.items():
        out = F.when(outlet == key, F.lit(n)) if out is None else out.when(outlet == key, F.lit(n))
    return out


def min_words_by_source(
    df: DataFrame, source_col: str = "outlet_name", text_col: str = "text"
) -> DataFrame:
    """Keep articles with at least their outlet's number of words.

    Ten thresholds are a constant expression, so no join is planned and the
    filter runs inside the scan stage.
    """
    # through inline: counted once, and not before the rows were dealt to the tasks
    counted = F.inline(F.array(F.struct(X.word_count(_q(text_col)).alias("word_count"))))
    rows = df.select(*[_q(c) for c in df.columns if c != "word_count"], counted)
    kept = rows.where(F.col("word_count") >= min_words_for(_q(source_col)))
    return kept.select(*[_q(c) for c in df.columns]) if "word_count" in df.columns else kept


def label_summary(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Per label: rows, usable rows, rows without outlet.  At most a few rows
    leave the partial aggregate of each task, whatever the table's size."""
    usable = nonempty_mask(df, text_col)
    blank_outlet = (
        ~X.is_nonempty(_q("outlet_name")) if "outlet_name" in df.columns else F.lit(False)
    )
    return df.groupBy(_q(label_col).alias("label")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(usable).alias("n_usable"),
        F.count_if(usable & blank_outlet).alias("n_blank_outlet"),
    )


def validation_report(
    df: DataFrame, text_col: str = "text", label_col: str = "label"
) -> DataFrame:
    """Everything the validation rules look at, as one row."""
    require_columns(df, [text_col, label_col])
    used = F.col("n_usable") > 0
    return (
        label_summary(df, text_col, label_col)
        .agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("n_usable"), F.lit(0)).alias("n_usable"),
            F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n_usable"))), F.lit(0)).alias(
                "n_null_labels"
            ),
            F.count_if(used & F.col("label").isNotNull()).alias("n_classes"),
            F.coalesce(F.sum("n_blank_outlet"), F.lit(0)).alias("n_blank_outlet"),
        )
        .withColumn("n_removed", F.col("n_rows") - F.col("n_usable"))
    )


def validate_text_dataset(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    min_samples: int = K.MIN_SAMPLES,
    require_binary_labels: bool = True,
) -> DataFrame:
    """Raise on an unusable corpus, else return it stripped and without blanks."""
    r = validation_report(df, text_col, label_col).first()
    if r["n_rows"] == 0:
        raise ValueError("The corpus is empty: it has no rows.")
    if r["n_usable"] / r["n_rows"] < K.MIN_TEXT_RATIO:
        raise ValueError(f"Only {r['n_usable']} of {r['n_rows']} rows have text.")
    if r["n_usable"] < min_samples:
        raise ValueError(
            f"{r['n_usable']} rows with text are fewer than the {min_samples} that are needed."
        )
    if r["n_null_labels"]:
        raise ValueError(f"{r['n_null_labels']} rows with text have no label.")
    if r["n_classes"] < 2:
        raise ValueError("There is only one class to tell apart.")
    if require_binary_labels and r["n_classes"] != 2:
        raise ValueError(f"Two classes are needed, {r['n_classes']} are there.")
    return df.where(nonempty_mask(df, text_col)).withColumn(
        text_col, X.normalize_string(_q(text_col))
    )


# ---------------------------------------------------------------------------
# paragraph rules


def keep_paragraphs(blocks: Column | str, min_words: int = 0, min_chars: int = 0) -> Column:
    """Paragraphs with at least that many words and more characters."""
    return F.filter(
        X._col(blocks), lambda p: (X.word_count(p) >= min_words) & (F.length(p) > min_chars)
    )


def is_boilerplate(outlet: str, t: Column) -> Column:
    """Paragraphs an outlet's rules throw away, by their wording."""
    return X.let(F.lower(t), lambda low: _is_boilerplate(outlet, t, low))


def _is_boilerplate(outlet: str, t: Column, low: Column) -> Column:
    if outlet == "CounterPunch":
        return X.starts_with_any(X.strip(low), K.DISCLAIMER_PREFIXES)
    if outlet == "Salon":
        return X.contains_any(low, K.SALON_PHRASES)
    if outlet == "MotherJones":
        return X.starts_with_any(low, K.MOTHERJONES_PREFIXES) | X.contains_any(low, K.MOTHERJONES_PHRASES)
    if outlet == "American_Spectator":
        return low.rlike(K.SPECTATOR_PROMO_PATTERN) | X.starts_with_any(low, K.SPECTATOR_PREFIXES)
    if outlet == "FoxNews":
        return (
            X.contains_any(t, K.FOX_MARKS)
            | X.starts_with_any(t, K.FOX_PREFIXES)
            | X.contains_any(low, K.FOX_CAPTION_WORDS)
            | X.contains_any(low, K.FOX_JUNK_PHRASES)
            | (X.uppercase_ratio(t) > K.FOX_UPPERCASE_LIMIT)
        )
    if outlet == "DailyCaller":
        return X.contains_any(low, K.DAILYCALLER_PHRASES)
    return F.lit(False)


def is_author_bio(t: Column) -> Column:
    """Closing author note: an address to write to, or a director of something."""
    return X.let(
        F.lower(t),
        lambda low: X.contains_any(low, K.SPECTATOR_BIO_PHRASES)
        | (F.contains(low, F.lit("is a")) & F.contains(low, F.lit("director"))),
    )


def drop_boilerplate(blocks: Column | str, outlets: Iterable[str] = tuple(K.OUTLETS)) -> Column:
    """Paragraphs that none of the named outlets' wording rules hit."""

    def keep(p: Column) -> Column:
        def hit(low: Column) -> Column:
            out = F.lit(False)
            for o in outlets:
                out = out | _is_boilerplate(o, p, low)
            return out

        return ~X.let(F.lower(p), hit)

    return F.filter(X._col(blocks), keep)
