"""TF-IDF: vocabulary and weights from training rows, applied to any row.

Fitting is one aggregation by term.  A task codes the terms of a batch of rows as
numbers and counts occurrences and documents of each, so both frequencies come out
of the same ``groupBy`` without a shuffle by document.  Applying is row-local: terms
are looked up a batch at a time among at most ``max_features``.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions import text as X
from newsloom.sources.scratch import stored, then_given_back


def terms_of(text_col: Column | str, stop_words=K.STOP_WORDS) -> Column:
    """Unigrams and bigrams after stop-word removal."""
    return X.with_bigrams(X.tokens(text_col, stop_words))


def with_terms(df: DataFrame, text_col: str = "text", stop_words=K.STOP_WORDS) -> DataFrame:
    """Add the ``terms`` array that fitting and applying both start from."""
    return df.withColumn("terms", terms_of(text_col, stop_words))


#: Rows of counts that a task adds up before it hands them on.
COUNTED_ROWS = 1 << 17
#: Vocabularies chosen at the same time.
FOLDS_AT_ONCE = 5
_COUNTS = "folds long, term string, tf long, df long"


def _added_up(tables: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(tables).group_by(["folds", "term"]).aggregate([("tf", "sum"), ("df", "sum")])
    return rows.rename_columns({"tf_sum": "tf", "df_sum": "df"}).select(["folds", "term", "tf", "df"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term among rows with the same ``folds``, as far
    as a task sees them; terms may come again."""
    kept: list[pa.Table] = []
    for batch in batches:
        rows, flat = _flat(batch.column("terms"))
        coded = flat.dictionary_encode()
        groups, group = np.unique(batch.column("folds").to_numpy(), return_inverse=True)
        n_terms = len(coded.dictionary)
        if not n_terms:
            continue
        pairs, n = np.unique(rows * n_terms + coded.indices.to_numpy(), return_counts=True)
        place = group[pairs // n_terms] * n_terms + pairs % n_terms
        size = groups.size * n_terms
        tf, df = np.bincount(place, weights=n, minlength=size), np.bincount(place, minlength=size)
        seen = np.flatnonzero(df)
        kept.append(pa.table({
            "folds": pa.array(groups[seen // n_terms], pa.int64()), "term": coded.dictionary.take(pa.array(seen % n_terms)),
            "tf": pa.array(tf[seen].astype(np.int64)), "df": pa.array(df[seen].astype(np.int64)),
        }))
        if sum(t.num_rows for t in kept) > COUNTED_ROWS:
            kept = [_added_up(kept)]
            if kept[0].num_rows > COUNTED_ROWS // 2:
                yield from kept.pop().to_batches(1 << 16)
    if kept:
        yield from _added_up(kept).to_batches(1 << 16)


def term_frequencies(df: DataFrame) -> DataFrame:
    """(term, tf, df): occurrences and documents of each term."""
    counted = df.select(F.lit(0).cast("long").alias("folds"), "terms").mapInArrow(then_given_back(_counts), _COUNTS)
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


@dataclass(frozen=True)
class Limits:
    min_df: int
    max_df: int

    @classmethod
    def for_corpus(cls, n_docs: int) -> "Limits":
        """Document-frequency limits; tiny corpora have none."""
        if n_docs < K.TFIDF_SMALL_CORPUS:
            return cls(1, n_docs)
        return cls(K.TFIDF_MIN_DF, int(K.TFIDF_MAX_DF * n_docs))


def vocabulary(
    frequencies: DataFrame, limits: Limits, max_features: int = K.TFIDF_MAX_FEATURES, tf: str = "tf", df: str = "df"
) -> DataFrame:
    """(term, tf, df) of the most frequent admissible terms; ties are settled by the term.

    Terms are counted per frequency; that small table says at which frequency the
    list is full.  Terms above it are all in, and only those of exactly that
    frequency are put in order for the places that are left.  ``frequencies`` is
    read up to three times: pass a stored table.
    """
    fit = frequencies.select("term", F.col(tf).alias("tf"), F.col(df).alias("df")).where(
        F.col("df").between(limits.min_df, limits.max_df)
    )
    higher = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1)
    per = fit.groupBy("tf").agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    cut = per.where((F.col("above") < max_features) & (F.col("above") + F.col("n") > max_features)).first()
    if cut is None:  # everything fits
        return fit
    tied = fit.where(F.col("tf") == cut["tf"]).orderBy("term").limit(max_features - cut["above"])
    return fit.where(F.col("tf") > cut["tf"]).unionByName(tied)


def corpus_vocabulary(rows: DataFrame, n_docs: int, max_features: int = K.TFIDF_MAX_FEATURES) -> DataFrame:
    """The vocabulary of rows with ``terms``; terms are counted once and written, but
    for those outside the document-frequency limits."""
    limits = Limits.for_corpus(n_docs)
    counted = term_frequencies(rows).where(F.col("df").between(limits.min_df, limits.max_df))
    return vocabulary(stored(counted, "term-frequencies"), limits, max_features)


def idf(n_docs: int, df: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


@dataclass(frozen=True)
class TfidfModel:
    """At most ``max_features`` terms with their weights, in term order."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    n_docs: int

    def transform(self, df: DataFrame, output: str = "tfidf") -> DataFrame:
        """Add the L2-normalised vector of each row's ``terms``."""
        return df.withColumn(output, F.arrow_udf(_vectors(self.terms, self.weights), VectorUDT())("terms"))


def _vectors(terms: tuple[str, ...], weights: tuple[float, ...]):
    """Term arrays to sparse vectors of length one, a batch at a time."""
    width, weight = len(terms), np.array(weights)
    packed = pa.array(terms, pa.string())

    def run(column: pa.Array) -> pa.Array:
        rows, found = _places(column, packed)
        # a row's places in order, and how often each comes
        keys, n = np.unique(rows * width + found, return_counts=True)
        rows, found = keys // width, keys % width
        sizes = np.bincount(rows, minlength=len(column))
        values = n * weight[found]
        norm = np.sqrt(np.bincount(rows, weights=values * values, minlength=len(column)))
        edge = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        null = column.is_null()
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(len(column), np.int8)),  # sparse
                pa.array(np.full(len(column), width, np.int32)),
                pa.ListArray.from_arrays(edge, pa.array(found.astype(np.int32))),
                pa.ListArray.from_arrays(edge, pa.array(values / norm[rows])),
            ],
            ["type", "size", "indices", "values"],
            mask=null if null.true_count else None,
        )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of each term of an array column, and the terms."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _places(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in ``terms`` of every listed term of an array column."""
    rows, flat = _flat(column)
    place = pc.index_in(flat, value_set=terms)
    known = place.is_valid().to_numpy(zero_copy_only=False)
    return rows[known], place.drop_null().to_numpy().astype(np.int64)


def _model(rows: DataFrame, n: int) -> TfidfModel:
    terms = sorted((r["term"], r["df"]) for r in rows.collect())
    if not terms:
        raise ValueError("No terms remain after pruning.")
    return TfidfModel(tuple(t for t, _ in terms), tuple(log((1 + n) / (1 + df)) + 1 for _, df in terms), n)


def fit(train: DataFrame, n_docs: int | None = None, max_features: int = K.TFIDF_MAX_FEATURES) -> TfidfModel:
    """Learn terms and weights from rows with a ``terms`` array.

    Only the final vocabulary (at most ``max_features`` rows) reaches the driver.
    """
    n = train.count() if n_docs is None else n_docs
    return _model(corpus_vocabulary(train, n, max_features), n)


def fit_folds(
    rows: DataFrame, in_test: dict[int, Column], sizes: dict[int, int], max_features: int = K.TFIDF_MAX_FEATURES
) -> dict[int, TfidfModel]:
    """The model of every fold, learnt from the rows that are not in its test part.

    Terms are counted once for all folds: ``folds`` says, a bit each, which ones learn
    from a row, and each has its own pair of sums in the same aggregation.  ``sizes``: training rows of each fold.
    """
    limits = {k: Limits.for_corpus(n) for k, n in sizes.items()}
    bits = {k: 1 << place for place, k in enumerate(in_test)}
    folds = reduce(Column.__add__, [F.when(~c, F.lit(bits[k])).otherwise(0) for k, c in in_test.items()]).cast("long")
    learns = {k: F.col("folds").bitwiseAND(bit) != 0 for k, bit in bits.items()}
    sums = [F.sum(F.when(learns[k], F.col("tf"))).alias(f"tf_{k}") for k in in_test]
    sums += [F.coalesce(F.sum(F.when(learns[k], F.col("df"))), F.lit(0)).alias(f"df_{k}") for k in in_test]
    kept = [F.col(f"df_{k}").between(limits[k].min_df, limits[k].max_df) for k in in_test]
    terms = rows.select(folds.alias("folds"), "terms").mapInArrow(then_given_back(_counts), _COUNTS).groupBy("term").agg(*sums)
    counted = stored(terms.where(reduce(Column.__or__, kept)), "term-frequencies")

    def learned(k: int) -> TfidfModel:
        return _model(vocabulary(counted, limits[k], max_features, f"tf_{k}", f"df_{k}"), sizes[k])

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:  # short jobs on one small table
        return dict(zip(in_test, pool.map(inheritable_thread_target(rows.sparkSession)(learned), in_test)))


def long_form(df: DataFrame, model: TfidfModel, id_col: str, vector: str = "tfidf") -> DataFrame:
    """(id, term, weight) of the non-zero entries of a vector column."""
    parts = F.unwrap_udt(vector)
    entries = F.arrays_zip(
        parts["indices"].alias("i"), parts["values"].alias("weight")
    )
    names = df.sparkSession.createDataFrame(
        list(enumerate(model.terms)), "i int, term string"
    )  # bounded by the vocabulary size
    return (
        df.select(id_col, F.inline(entries))
        .toDF(id_col, "i", "weight")
        .join(F.broadcast(names), "i")
        .select(id_col, "term", "weight")
    )
