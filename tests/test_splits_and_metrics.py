import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import metrics, ranking, splits
from newsloom.plans import experiments as E


@pytest.fixture(scope="module")
def rows(spark):
    # one source holds a third of all rows
    return spark.range(503).select(
        F.col("id").alias("doc_id"),
        F.expr("CAST(id % 7 = 0 AS INT)").alias("label"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || (id % 23) END").alias("source"),
    )


def test_folds_are_even_and_complete(rows):
    folds = splits.stratified_folds(rows, "doc_id", "label")
    assert folds.count() == 503 and folds.select("doc_id").distinct().count() == 503
    per = [r["n"] for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 5 and max(per) - min(per) <= 1
    for c in (0, 1):
        per = [r["n"] for r in folds.where(f"label = {c}").groupBy("fold").agg(F.count("*").alias("n")).collect()]
        assert max(per) - min(per) <= 1


def test_folds_do_not_depend_on_partitions(rows):
    one = splits.stratified_folds(rows.coalesce(1), "doc_id", "label").collect()
    many = splits.stratified_folds(rows.repartition(13).orderBy(F.desc("doc_id")), "doc_id", "label").collect()
    assert sorted(one) == sorted(many)


def test_held_out_share(rows):
    split = splits.train_test_split(rows, "doc_id", "label")
    got = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 101 and abs(got[1] - 72 * 101 / 503) < 1


def test_group_folds_keep_sources_together(rows):
    folds = splits.group_folds(rows, "source", "label")
    assert folds.count() == folds.select("source").distinct().count() == rows.select("source").distinct().count()
    assert folds.select("fold").distinct().count() == 5
    assert splits.assign_group_folds(rows, folds, "source").count() == 503


def plain_greedy(counts, n_folds=5):
    """Sources one by one, by deviation of their class counts; numpy's own deviations."""
    totals = np.sum(list(counts.values()), axis=0)
    rows = np.zeros((n_folds, len(totals)))
    for source in sorted(counts, key=lambda s: (-np.std(counts[s]), -sum(counts[s]), s)):
        trials = []
        for fold in range(n_folds):
            rows[fold] += counts[source]
            trials.append((round(np.std(rows / totals, axis=0).mean(), 12), rows[fold].sum(), fold))
            rows[fold] -= counts[source]
        rows[min(trials)[2]] += counts[source]
    return np.std(rows / totals, axis=0).mean()


def deviation(rows, folds):
    per = splits.assign_group_folds(rows, folds, "source").groupBy("fold").pivot("label", [0, 1]).count().fillna(0)
    shares = np.array([[r["0"], r["1"]] for r in per.collect()], dtype=float)
    return np.std(shares / shares.sum(axis=0), axis=0).mean()


def source_counts(rows):
    out = {}
    for r in rows.groupBy("source", "label").count().collect():
        out.setdefault(r["source"], [0, 0])[r["label"]] = r["count"]
    return out


def test_group_folds_are_as_even_as_the_plain_greedy_deal(spark, rows):
    assert deviation(rows, splits.group_folds(rows, "source", "label")) <= plain_greedy(source_counts(rows)) + 1e-9
    many = spark.range(6000).select(
        F.expr("CAST(pmod(hash(id), 10) < 3 AS INT)").alias("label"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE 's' || CAST(sqrt(id) AS INT) || '-' || id % 7 END").alias("source"),
    )
    alone = deviation(many, splits.group_folds(many, "source", "label"))
    assert alone <= plain_greedy(source_counts(many)) + 1e-9
    # small sources in packs: as even but for the packs' own size, and a source stays whole
    packed = splits.group_folds(many, "source", "label", packs=64)
    assert packed.count() == many.select("source").distinct().count()
    assert deviation(many, packed) <= alone + 1 / 64


def test_group_folds_with_many_folds_and_odd_rows(spark):
    odd = spark.createDataFrame([(None, 1), ("a", None), ("a", 1), ("b", 1), ("p3", 0)], "source string, label int")
    folds = {r["source"]: r["fold"] for r in splits.group_folds(odd, "source", "label", 3).collect()}
    assert set(folds) == {"a", "b", "p3"} and set(folds.values()) <= {0, 1, 2}
    assert splits.group_folds(odd.limit(0), "source", "label").collect() == []
    one = splits.group_folds(odd.repartition(1), "source", "label", 3).collect()
    assert {r["source"]: r["fold"] for r in one} == folds


def test_metrics_agree(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3
    p = spark.createDataFrame([("m", a, b) for a, b in pairs], "model string, label int, prediction int")
    matrix = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(p, "model").collect()}
    assert matrix == {(0, 0): 5, (0, 1): 2, (1, 0): 0, (1, 1): 3}
    assert metrics.accuracy(p, "model").first()["accuracy"] == 0.8
    report = {r["entry"]: r for r in metrics.classification_report(p, "model").collect()}
    assert report["1"]["precision"] == pytest.approx(0.6) and report["1"]["recall"] == 1.0
    assert report["macro avg"]["recall"] == pytest.approx((5 / 7 + 1) / 2)
    assert report["weighted avg"]["recall"] == report["accuracy"]["recall"] == pytest.approx(0.8)


def test_never_predicted_class_scores_zero(spark):
    p = spark.createDataFrame([("m", 0, 1), ("m", 1, 1)], "model string, label int, prediction int")
    zero = {r["entry"]: r for r in metrics.classification_report(p, "model").collect()}["0"]
    assert (zero["precision"], zero["recall"], zero["f1"]) == (0.0, 0.0, 0.0)


def test_grouped_needs_sources(rows):
    with pytest.raises(ValueError, match="source"):
        E.with_folds(rows.drop("source"), "doc_id", grouped=True)


def test_cap_and_first_seen_under_skew(rows):
    capped = ranking.cap_per_source(rows, "source", ["doc_id"], cap=10, salts=4)
    hot = [r["doc_id"] for r in capped.where("source = 'hot'").orderBy("doc_id").collect()]
    assert hot == [3 * i for i in range(10)]
    seen = ranking.first_seen(rows, "source", "doc_id", "label").where("source = 'hot'").first()
    assert seen["doc_id"] == 501
