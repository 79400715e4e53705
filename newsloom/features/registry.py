"""Feature sets by name.

A feature set is split in two: ``prepare`` adds whatever a document's own text
determines, once for all folds; ``fit`` learns from training rows only and
returns a function that adds the ``features`` vector to any prepared rows.  Sets
that start from TF-IDF take its model, so folds can share the counting of terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.features import embeddings, linguistic, nmf, scaling, sentiment, tfidf
from newsloom.sources.scratch import stored

Apply = Callable[[DataFrame], DataFrame]
EXTRA_COLUMNS = linguistic.POS_COLUMNS + sentiment.SENTIMENT_COLUMNS + linguistic.READABILITY_COLUMNS


@dataclass(frozen=True)
class FeatureSet:
    """``prepare(df, id_col)`` and ``fit(train, id_col, n_train, terms)``; ``terms`` is a
    fitted TF-IDF model, or None for a set that has none or learns its own. A set whose
    fit takes many passes may have ``fit_tasks``, which takes each of these by task and
    learns for all tasks in the same passes."""

    prepare: Callable[[DataFrame, str], DataFrame]
    fit: Callable[..., Apply]
    uses_terms: bool = True
    fit_tasks: Callable[..., dict[int, Apply]] | None = None


def _prepare_terms(df: DataFrame, id_col: str) -> DataFrame:
    return tfidf.with_terms(df).drop("text")


Terms = tfidf.TfidfModel | None


def _fit_tfidf(train: DataFrame, id_col: str, n_train: int, terms: Terms = None) -> Apply:
    model = terms or tfidf.fit(train, n_train)
    return lambda df: model.transform(df, "features")


def with_extra_columns(df: DataFrame, id_col: str) -> DataFrame:
    """POS ratios, sentiment and readability of each text."""
    scored = linguistic.with_readability(linguistic.with_pos_ratios(df))
    return sentiment.with_sentiment(scored, "text", max_chars=None)


def _prepare_full(df: DataFrame, id_col: str) -> DataFrame:
    return tfidf.with_terms(with_extra_columns(df, id_col)).drop("text")


def _fit_full(train: DataFrame, id_col: str, n_train: int, terms: Terms = None) -> Apply:
    model = terms or tfidf.fit(train, n_train)
    scaler = scaling.fit_scaler(train, EXTRA_COLUMNS)

    def apply(df: DataFrame) -> DataFrame:
        scaled = scaling.scale(model.transform(df, "tfidf"), scaler)
        return scaling.assemble(scaled, ["tfidf", *EXTRA_COLUMNS])

    return apply


def fit_tfidf_nmf_tasks(max_iter: int = K.NMF_MAX_ITER, k: int = K.NMF_COMPONENTS):
    def fit(trains: dict[int, DataFrame], id_col: str, sizes: dict[int, int], terms: dict[int, Terms]) -> dict[int, Apply]:
        fitted = {task: terms.get(task) or tfidf.fit(train, sizes[task]) for task, train in trains.items()}
        parts = [fitted[task].transform(train, "tfidf").select(F.lit(task).alias("task"), "tfidf") for task, train in trains.items()]
        vectors = stored(reduce(DataFrame.unionByName, parts), "vectors")
        widths = {task: len(model.terms) for task, model in fitted.items()}
        topics = nmf.fit_tasks(vectors, "tfidf", widths, k=k, max_iter=max_iter)

        def applied(task: int) -> Apply:
            return lambda df: scaling.assemble(
                topics[task].with_weights(fitted[task].transform(df, "tfidf")), ["tfidf", "topics"]
            )

        return {task: applied(task) for task in trains}

    return fit


def fit_tfidf_nmf(max_iter: int = K.NMF_MAX_ITER, k: int = K.NMF_COMPONENTS):
    def fit(train: DataFrame, id_col: str, n_train: int, terms: Terms = None) -> Apply:
        return fit_tfidf_nmf_tasks(max_iter, k)({0: train}, id_col, {0: n_train}, {0: terms})[0]

    return fit


def _prepare_embeddings(chunked: bool):
    def prepare(df: DataFrame, id_col: str) -> DataFrame:
        vectors = df.withColumn("features", array_to_vector(embeddings.embedding("text", chunked=chunked)))
        return vectors.drop("text")

    return prepare


def _no_fit(train: DataFrame, id_col: str, n_train: int, terms: Terms = None) -> Apply:
    return lambda df: df


FEATURE_SETS: dict[str, FeatureSet] = {
    "tfidf": FeatureSet(_prepare_terms, _fit_tfidf),
    "tfidf_nmf": FeatureSet(_prepare_terms, fit_tfidf_nmf(), fit_tasks=fit_tfidf_nmf_tasks()),
    "full": FeatureSet(_prepare_full, _fit_full),
    "embeddings": FeatureSet(_prepare_embeddings(False), _no_fit, False),
    "chunked": FeatureSet(_prepare_embeddings(True), _no_fit, False),
}
