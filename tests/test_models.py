import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from newsloom.functions import urls as U
from newsloom.operators import linear
from newsloom.operators.linear import LOGISTIC, SQUARED_HINGE, Classifier
from newsloom.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.RandomState(0)
    x = (r.rand(120, 6) * (r.rand(120, 6) < 0.6)).round(3)
    y = (x[:, 0] + 0.3 * r.rand(120) > x[:, 1] + 0.2).astype(int)
    data = [(k, int(y[k]), SparseVector(6, np.flatnonzero(x[k]), x[k][x[k] != 0])) for k in range(120)]
    return x, y, spark.createDataFrame(data, ["doc_id", "label", "features"])


def objective(w, x, y, C):
    sign = 2.0 * y - 1
    gap = np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1]))
    return C * gap @ gap + w @ w / 2, C * np.append(x.T @ (-2 * sign * gap), (-2 * sign * gap).sum()) + w


def test_squared_hinge_reaches_the_minimum(rows):
    x, y, df = rows
    model = Classifier(SQUARED_HINGE, 0.5, 500, 1e-8).fit(df.repartition(20))
    value, slope = objective(model.weights, x, y, 0.5)
    assert np.linalg.norm(slope) < 1e-4
    # a plain gradient descent ends at the same value
    w = np.zeros(7)
    for _ in range(20_000):
        w = w - 0.002 * objective(w, x, y, 0.5)[1]
    assert value == pytest.approx(objective(w, x, y, 0.5)[0], rel=1e-6) and np.allclose(w, model.weights, atol=1e-3)


def test_predictions_and_dense_rows(spark, rows):
    x, y, df = rows
    model = Classifier(SQUARED_HINGE, 0.5, 500, 1e-8).fit(df)
    got = {r.doc_id: r.prediction for r in model.transform(df).collect()}
    assert [got[k] for k in range(120)] == (x @ model.weights[:-1] + model.weights[-1] > 0).astype(float).tolist()
    dense = spark.createDataFrame([(k, int(y[k]), Vectors.dense(x[k])) for k in range(120)], ["doc_id", "label", "features"])
    assert np.allclose(Classifier(SQUARED_HINGE, 0.5, 500, 1e-8).fit(dense).weights, model.weights, atol=1e-4)


def logistic(w, x, y, C):
    sign = 2.0 * y - 1
    f = x @ w[:-1] + w[-1]
    pull = -sign / (1 + np.exp(sign * f))
    return C * np.log1p(np.exp(-sign * f)).sum() + w[:-1] @ w[:-1] / 2, C * np.append(x.T @ pull, pull.sum()) + np.append(w[:-1], 0)


def test_logistic_regression_reaches_the_minimum(rows):
    x, y, df = rows
    model = Classifier(LOGISTIC, 1.0, 500).fit(df.repartition(3))
    w = np.zeros(7)
    for _ in range(20_000):
        w = w - 0.01 * logistic(w, x, y, 1.0)[1]
    assert np.allclose(w, model.weights, atol=1e-4)
    assert np.linalg.norm(logistic(model.weights, x, y, 1.0)[1]) <= 1.01e-6 * np.linalg.norm(logistic(np.zeros(7), x, y, 1.0)[1])


def test_default_stop_holds_for_both(rows):
    _, _, df = rows
    for loss in (LOGISTIC, SQUARED_HINGE):
        model = Classifier(loss, 0.7, 500).fit(df)
        assert model.gradient_norm <= 1e-6 * model.first_norm


def test_fits_together_equal_fits_alone(rows):
    """Tasks on different rows, of both losses, in the same passes; blocks of a few entries."""
    _, _, df = rows
    folds = [df.where(F.col("doc_id") % 3 != k).withColumn("task", F.lit(k)) for k in range(3)]
    train = folds[0].union(folds[1]).union(folds[2]).select("task", "label", "features")
    fits = [Classifier(loss, 0.7, 500).task(k) for k in range(3) for loss in (LOGISTIC, SQUARED_HINGE)]
    together = linear.fit_all(linear.blocks(train.repartition(20)), linear.widths(train), fits)
    for fit, model in zip(fits, together):
        alone = Classifier(fit.loss, 0.7, 500).fit(folds[fit.task])
        assert np.allclose(model.weights, alone.weights, atol=1e-4)


def test_blocks_are_bounded(rows, monkeypatch):
    _, _, df = rows
    whole = linear.blocks(df.withColumn("task", F.col("doc_id") % 2).coalesce(1))
    batches = [r.asDict() for r in whole.collect()]
    assert sum(len(r["sizes"]) // 4 for r in batches) == 120 and {r["task"] for r in batches} == {0, 1}


def test_one_class_and_no_entries(spark):
    df = spark.createDataFrame([(1, SparseVector(3, {})), (1, SparseVector(3, {0: 1.0}))], ["label", "features"])
    for loss in (LOGISTIC, SQUARED_HINGE):
        model = Classifier(loss, 1.0, 50).fit(df)
        assert np.isfinite(model.weights).all() and [r.prediction for r in model.transform(df).collect()] == [1.0, 1.0]


def test_predictions_after_an_observation_in_the_session(spark):
    """A model must not carry the session: an observed table leaves things in it that no task can take."""
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 10
    out = catalog.QUERIES["lr_predictions"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {r[0] for r in out.select("prediction").distinct().collect()} <= {0, 1}


def test_links_with_dots(spark):
    base = "https://x.org/p/q/r"
    want = {
        "../a/./b": "https://x.org/p/a/b", "../../../a": "https://x.org/a", "./": "https://x.org/p/q/", "..": "https://x.org/p/",
        "a/../b?x=../y": "https://x.org/p/q/b?x=../y", "/a/b/../c#d": "https://x.org/a/c#d", "a.b": "https://x.org/p/q/a.b",
        "//y.org/../z": "https://y.org/../z", "https://y.org/a/../b": "https://y.org/a/../b", ".hidden/x": "https://x.org/p/q/.hidden/x",
    }
    df = spark.createDataFrame([(h,) for h in want], "h string").select("h", U.resolve("h", F.lit(base)).alias("u"))
    assert {r.h: r.u for r in df.collect()} == want


def test_a_step_reads_only_blocks_that_are_asked_for(rows, monkeypatch):
    """Fits that have ended cost no more reading; rows without entries count with the constant alone."""
    _, _, df = rows
    blocks = linear.blocks(df.withColumn("task", F.col("doc_id") % 2))
    seen, plain = [], type(blocks).mapInArrow
    monkeypatch.setattr(type(blocks), "mapInArrow", lambda d, *a, **k: seen.append({r.task for r in d.select("task").collect()}) or plain(d, *a, **k))
    w = np.arange(7.0)
    (value, sums), = linear._answers(blocks, 1, {1: [(0, LOGISTIC, w, None)]}, {0: 7}).values()
    assert seen == [{1}]
    x, y, _ = rows
    f, sign = x[1::2] @ w[:-1] + w[-1], 2.0 * y[1::2] - 1
    pull = -sign / (1 + np.exp(sign * f))
    assert value == pytest.approx(np.log1p(np.exp(-sign * f)).sum()) and np.allclose(sums, np.append(x[1::2].T @ pull, pull.sum()))
