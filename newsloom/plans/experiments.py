"""Cross-validation, held-out test and the experiment loop.

Membership in folds is decided on ids and classes alone and joined to the texts
once; what a text alone determines is computed once per experiment.  All folds and
classifiers of all experiments are trained together: each training step reads the
vectors once.  Tables with texts, terms or vectors are written, not cached, and so are
predictions: a result never trains or scores again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.features import tfidf
from newsloom.features.registry import FEATURE_SETS, FeatureSet
from newsloom.operators import metrics, models, splits
from newsloom.plans.tables import split_input
from newsloom.sources.scratch import stored

PREDICTION_COLUMNS = ("model", "stage", "classifier", "fold", "label", "prediction")
#: Folds whose features are learnt together.
FOLDS_AT_ONCE = 2


def with_folds(df: DataFrame, id_col: str, grouped: bool, source_col: str = "source") -> DataFrame:
    """Rows with their fold, by class or by source."""
    if grouped:
        if source_col not in df.columns:
            raise ValueError("Grouped folds need a source column.")
        return splits.assign_group_folds(df, splits.group_folds(df, source_col, "label"), source_col)
    return df.join(splits.stratified_folds(df, id_col, "label").drop("label"), id_col)


def _at_once(spark: SparkSession, work: Callable, items: list, n: int) -> list:
    """Submit jobs for several items from ``n`` threads."""
    with ThreadPoolExecutor(n) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def _training_sizes(prepared: DataFrame, folds: dict[int, Column]) -> dict[int, int]:
    """Training rows of each fold."""
    counts = prepared.agg(*[F.count_if(~c).alias(str(k)) for k, c in folds.items()]).first()
    sizes = {k: counts[str(k)] for k in folds}
    if not all(sizes.values()):
        raise ValueError("There are no training rows.")
    return sizes


@dataclass(frozen=True)
class _Stage:
    """What a model is tested on: prepared rows, and the test rows of each fold."""

    name: str
    stage: str
    prepared: DataFrame
    folds: dict[int, Column]
    features: FeatureSet


def _vectors(stages: list[_Stage], id_col: str, parallelism: int) -> dict[tuple[int, int], DataFrame]:
    """Vectors of all rows, by place of the stage and fold, under what the fold's training
    rows teach, written out. Terms are counted once for all folds of a stage; what takes
    many passes is learned for all folds of a feature set's stages at once."""
    sizes = [_training_sizes(s.prepared, s.folds) for s in stages]
    terms = [tfidf.fit_folds(s.prepared, s.folds, n) if s.features.uses_terms else {} for s, n in zip(stages, sizes)]
    keys = [(at, fold) for at, s in enumerate(stages) for fold in s.folds]
    train = {(at, fold): stages[at].prepared.where(~stages[at].folds[fold]) for at, fold in keys}
    applied = {}
    for features in dict.fromkeys(s.features for s in stages if s.features.fit_tasks):
        own = dict(enumerate(key for key in keys if stages[key[0]].features is features))
        of = lambda values: {task: values[at].get(fold) for task, (at, fold) in own.items()}
        together = features.fit_tasks({task: train[key] for task, key in own.items()}, id_col, of(sizes), of(terms))
        applied |= {own[task]: apply for task, apply in together.items()}

    def vectors_of(key: tuple[int, int]) -> DataFrame:
        at, fold = key
        s = stages[at]
        apply = applied.get(key) or s.features.fit(train[key], id_col, sizes[at][fold], terms[at].get(fold))
        rows = apply(s.prepared.withColumn("in_test", s.folds[fold]))
        return stored(rows.select(F.lit(keys.index(key)).alias("task"), id_col, "label", "in_test", "features"), "vectors")

    return dict(zip(keys, _at_once(stages[0].prepared.sparkSession, vectors_of, keys, parallelism)))


def _predictions(
    stages: list[_Stage], id_col: str, classifiers: Iterable[str], parallelism: int = 1
) -> list[DataFrame]:
    """Predictions of each stage for the test rows of its folds. The classifiers of all
    folds of all stages are trained together, in one pass a step."""
    names, vectors = list(classifiers), _vectors(stages, id_col, parallelism)
    tasks = {key: task for task, key in enumerate(vectors)}
    train = reduce(DataFrame.unionByName, [v.where("NOT in_test") for v in vectors.values()])
    fitted = models.fit_tasks(train.select("task", "label", "features"), tasks.values(), names)
    out = []
    for at, s in enumerate(stages):
        parts = []
        for fold in s.folds:
            test = vectors[at, fold].where("in_test").select(id_col, "label", "features")
            for classifier in names:
                scored = fitted[tasks[at, fold], classifier].transform(test)
                parts.append(scored.select(
                    F.lit(s.name).alias("model"), F.lit(s.stage).alias("stage"), F.lit(classifier).alias("classifier"),
                    F.lit(fold).alias("fold"), id_col, "label", F.col("prediction").cast("int").alias("prediction"),
                ))
        out.append(stored(reduce(DataFrame.unionByName, parts), "predictions"))
    return out


def _cross_validation(df: DataFrame, name: str, features: FeatureSet, id_col: str, grouped: bool) -> _Stage:
    source = ["source"] if "source" in df.columns else []
    slim = df.select(id_col, "label", *source).persist(StorageLevel.MEMORY_AND_DISK)
    folds = with_folds(slim, id_col, grouped).select(id_col, "label", "fold")
    texts = split_input(df.select(id_col, "text").join(folds, id_col))
    prepared = stored(features.prepare(texts, id_col), "prepared")
    slim.unpersist()
    return _Stage(name, "CV", prepared, {fold: F.col("fold") == fold for fold in range(K.N_FOLDS)}, features)


def _held_out(df: DataFrame, name: str, features: FeatureSet, id_col: str) -> _Stage:
    prepared = stored(features.prepare(split_input(df.select(id_col, "text", "label", "is_test")), id_col), "prepared")
    return _Stage(name, "TEST", prepared, {0: F.col("is_test")}, features)


def cross_validate(
    df: DataFrame,
    name: str,
    features: FeatureSet,
    id_col: str,
    grouped: bool = False,
    classifiers: Iterable[str] = tuple(models.MODELS),
    parallelism: int = FOLDS_AT_ONCE,
) -> DataFrame:
    """Out-of-fold predictions of every training row."""
    return _predictions([_cross_validation(df, name, features, id_col, grouped)], id_col, classifiers, parallelism)[0]


def held_out(
    df: DataFrame,
    name: str,
    features: FeatureSet,
    id_col: str,
    classifiers: Iterable[str] = tuple(models.MODELS),
) -> DataFrame:
    """Predictions for rows with ``is_test``, learnt from the others."""
    return held_out_of(df, {name: features}, id_col, classifiers)


def held_out_of(
    df: DataFrame, sets: dict[str, FeatureSet], id_col: str, classifiers: Iterable[str] = tuple(models.MODELS)
) -> DataFrame:
    """``held_out`` of several feature sets by name, trained in the same steps."""
    stages = [_held_out(df, name, features, id_col) for name, features in sets.items()]
    return reduce(DataFrame.unionByName, _predictions(stages, id_col, classifiers))


def marked_for_test(texts: DataFrame, keys: DataFrame, id_col: str) -> DataFrame:
    """Texts with label and ``is_test``; the split is made on the keys (id, label)
    and joined to the texts once."""
    return texts.select(id_col, "text").join(splits.train_test_split(keys, id_col, "label"), id_col)


def fold_rows(predictions: DataFrame) -> DataFrame:
    """One line per model and fold, the way reports list them."""
    first = F.col("classifier") == "LR"
    hit = (F.col("label") == F.col("prediction")).cast("int")
    side = lambda c: F.count_if(first & (F.col("label") == c))
    per_fold = predictions.groupBy("model", "fold").agg(
        F.avg(F.when(first, hit)).alias("LR Accuracy"),
        F.avg(F.when(F.col("classifier") == "SVC", hit)).alias("SVC Accuracy"),
        F.count_if(first).alias("Test Size"),
        side(0).alias("Test Left"),
        side(1).alias("Test Right"),
    )
    totals = per_fold.groupBy("model").agg(
        F.sum("Test Size").alias("_n"), F.sum("Test Left").alias("_l"), F.sum("Test Right").alias("_r")
    )
    return per_fold.join(totals, "model").select(
        F.col("model").alias("Model"),
        (F.col("fold") + 1).alias("Fold"),
        "LR Accuracy",
        "SVC Accuracy",
        (F.col("_n") - F.col("Test Size")).alias("Train Size"),
        "Test Size",
        (F.col("_l") - F.col("Test Left")).alias("Train Left"),
        (F.col("_r") - F.col("Test Right")).alias("Train Right"),
        "Test Left",
        "Test Right",
    )


def grouped_fold_rows(predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """Fold lines with the sources on either side."""
    named = metrics.join_sources(sources).select(
        (F.col("fold") + 1).alias("Fold"),
        F.col("train_sources").alias("Train Sources"),
        F.col("test_sources").alias("Test Sources"),
    )
    return fold_rows(predictions).join(named, "Fold")


def test_rows(predictions: DataFrame) -> DataFrame:
    """Model with the held-out accuracy of each classifier."""
    hit = (F.col("label") == F.col("prediction")).cast("int")
    score = lambda c: F.avg(F.when(F.col("classifier") == c, hit))
    return predictions.where(F.col("stage") == "TEST").groupBy(F.col("model").alias("Model")).agg(
        score("LR").alias("LR Test Acc"), score("SVC").alias("SVC Test Acc")
    )


def run_experiments(
    corpus: DataFrame,
    experiments: Iterable[tuple[str, str | FeatureSet]],
    id_col: str = "doc_id",
    grouped: bool = False,
    held_out_split: bool = True,
) -> DataFrame:
    """Predictions of all experiments: folds over the training rows, then the
    held-out rows; all are trained in the same steps.  ``corpus`` holds id, text, label
    and, if grouped, source."""
    keys = corpus.select(id_col, "label", *(["source"] if grouped else [])).persist(StorageLevel.MEMORY_AND_DISK)
    split = splits.train_test_split(keys, id_col, "label")
    if grouped:
        split = split.join(keys.select(id_col, "source"), id_col)
    marked = corpus.select(id_col, "text").join(split, id_col)
    stages = []
    for name, which in experiments:
        features = FEATURE_SETS[which] if isinstance(which, str) else which
        train = marked.where(~F.col("is_test")).drop("is_test")
        stages.append(_cross_validation(train, name, features, id_col, grouped))
        if held_out_split:
            stages.append(_held_out(marked, name, features, id_col))
    keys.unpersist()
    return reduce(DataFrame.unionByName, _predictions(stages, id_col, tuple(models.MODELS), FOLDS_AT_ONCE))
