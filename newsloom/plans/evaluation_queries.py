"""Queries on folds, predictions and metrics."""

from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.operators import metrics, ranking, splits
from newsloom.plans import sql as Q
from newsloom.plans.registry import query
from newsloom.plans.tables import labelled_keys, table


@query("stratified_folds", f"SELECT doc_id, label, fold FROM {Q.FOLDS}")
def stratified_folds(spark, sf):
    return splits.stratified_folds(labelled_keys(spark, sf), "doc_id", "label")


_QUOTA = f"""(WITH c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM {Q.CORPUS} GROUP BY 1),
 e AS (SELECT label, n * ceil(total * 0.2) / total AS exact, ceil(total * 0.2) AS wanted FROM c),
 f AS (SELECT label, floor(exact) AS base, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, label) AS place,
   wanted - sum(floor(exact)) OVER () AS missing FROM e)
 SELECT label, base + CASE WHEN place <= missing THEN 1 ELSE 0 END AS quota FROM f)"""


@query(
    "train_test_split",
    f"SELECT doc_id, label, rank_in_class < quota AS is_test FROM {Q.ranked(Q.CORPUS)} r JOIN {_QUOTA} q USING (label)",
)
def train_test_split(spark, sf):
    return splits.train_test_split(labelled_keys(spark, sf), "doc_id", "label")


@query(
    "group_folds_check",
    f"SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, CAST(5 AS BIGINT) AS n_folds, CAST(1 AS BIGINT) AS folds_per_source FROM {Q.CORPUS}",
)
def group_folds_check(spark, sf):
    """Every row gets a fold, all five are used, no source is in two."""
    rows = labelled_keys(spark, sf, "source")
    assigned = splits.assign_group_folds(rows, splits.group_folds(rows, "source", "label"), "source")
    per_source = assigned.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("k"), F.min("fold").alias("fold")
    )
    return per_source.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_sources"),
        F.count_distinct("fold").alias("n_folds"),
        F.max("k").alias("folds_per_source"),
    )


# the greedy deal, a source at a time: a and b are the folds' rows of the two classes
_ITEMS = f"""SELECT source, n0, n1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1,
 row_number() OVER (ORDER BY 2 * (n0 * n0 + n1 * n1) - (n0 + n1) * (n0 + n1) DESC, n0 + n1 DESC, md5('s' || source), source) AS place
 FROM (SELECT source, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM {Q.CORPUS} WHERE source IS NOT NULL GROUP BY 1)"""


def _apart(rows: str, n: str, total: str) -> str:
    return (
        f"sqrt(CAST(5 * (list_sum([x * x FOR x IN {rows}]) + 2 * {n} * {rows}[f] + {n} * {n})"
        f" - (list_sum({rows}) + {n}) * (list_sum({rows}) + {n}) AS DOUBLE)) / CAST({total} AS DOUBLE)"
    )


def _filled(rows: str, n: str) -> str:
    return f"[{rows}[f] + CASE WHEN f = fold THEN {n} ELSE 0 END FOR f IN [1, 2, 3, 4, 5]]"


_GROUPED = f"""(WITH RECURSIVE items AS ({_ITEMS}),
 walk AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS source, 0 AS fold,
   CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS a, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS b
  UNION ALL
  SELECT place, source, fold, {_filled("a", "n0")}, {_filled("b", "n1")}
  FROM (SELECT i.place, i.source, i.n0, i.n1, w.a, w.b,
    list_min([{{'apart': {_apart("a", "n0", "t0")} + {_apart("b", "n1", "t1")}, 'rows': a[f] + b[f], 'fold': f}} FOR f IN [1, 2, 3, 4, 5]]).fold AS fold
   FROM walk w JOIN items i ON i.place = w.place + 1))
 SELECT source, CAST(fold - 1 AS INT) AS fold FROM walk WHERE place > 0)"""


@query("group_folds", f"SELECT source, fold FROM {_GROUPED}")
def group_folds(spark, sf):
    return splits.group_folds(labelled_keys(spark, sf, "source"), "source", "label")


_SIZES = """SELECT CAST(t.fold + 1 AS INT) AS "Fold", count(*) FILTER (f.fold <> t.fold) AS "Train Size", count(*) FILTER (f.fold = t.fold) AS "Test Size",
 count(*) FILTER (f.fold <> t.fold AND label = 0) AS "Train Left", count(*) FILTER (f.fold <> t.fold AND label = 1) AS "Train Right",
 count(*) FILTER (f.fold = t.fold AND label = 0) AS "Test Left", count(*) FILTER (f.fold = t.fold AND label = 1) AS "Test Right"
 FROM {rows} f, (SELECT CAST(unnest(range(5)) AS INT) AS fold) t GROUP BY t.fold"""


def _sizes(folded):
    from newsloom.plans import experiments

    return experiments.fold_rows(
        folded.select(
            F.lit("m").alias("model"), F.lit("LR").alias("classifier"), "fold", "label", F.col("label").alias("prediction")
        )
    ).drop("Model", "LR Accuracy", "SVC Accuracy")


@query("cv_fold_sizes", _SIZES.replace("{rows}", Q.FOLDS))
def cv_fold_sizes(spark, sf):
    """Sizes and class counts of both sides of each fold."""
    return _sizes(splits.stratified_folds(labelled_keys(spark, sf), "doc_id", "label"))


@query(
    "cv_fold_sizes_grouped",
    _SIZES.replace("{rows}", f"(SELECT g.fold, c.label FROM {Q.CORPUS} c JOIN {_GROUPED} g ON c.source = g.source)"),
)
def cv_fold_sizes_grouped(spark, sf):
    from newsloom.plans import experiments

    return _sizes(experiments.with_folds(labelled_keys(spark, sf, "source"), "doc_id", grouped=True))


# A prediction table over all labelled documents: two models, two classifiers.
# Wrong answers are placed by the id.
_SETUPS = (("TF-IDF", "LR", 7), ("TF-IDF", "SVC", 11), ("TF-IDF + NMF", "LR", 5), ("TF-IDF + NMF", "SVC", 13))


def _predictions(spark, sf, stage="CV"):
    setups = F.inline(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), F.lit(c).alias("classifier"), F.lit(k).alias("_k"))
                for m, c, k in _SETUPS
            ]
        )
    )
    rows = splits.stratified_folds(labelled_keys(spark, sf), "doc_id", "label")
    wrong = F.pmod("doc_id", F.col("_k")) == 0
    return (
        rows.select("*", setups)
        .withColumn("prediction", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")))
        .withColumn("stage", F.lit(stage))
        .drop("_k")
    )


_SETUP_SQL = ", ".join(f"('{m}', '{c}', {k})" for m, c, k in _SETUPS)
_P = (
    f"(SELECT doc_id, label, source, fold, model, 'CV' AS stage, classifier, "
    f"CASE WHEN doc_id % k = 0 THEN 1 - label ELSE label END AS prediction FROM {Q.FOLDS} f, (VALUES {_SETUP_SQL}) s(model, classifier, k))"
)
_KEYS = "model, stage, classifier, fold"
_MATRIX = f"""(SELECT k.model, k.stage, k.classifier, k.fold, CAST(g.a AS INT) AS actual, CAST(h.p AS INT) AS predicted,
 (SELECT count(*) FROM {_P} x WHERE x.model = k.model AND x.classifier = k.classifier AND x.fold = k.fold AND x.label = g.a AND x.prediction = h.p) AS n
 FROM (SELECT DISTINCT {_KEYS} FROM {_P}) k, (VALUES (0), (1)) g(a), (VALUES (0), (1)) h(p))"""


@query("confusion_matrix", f"SELECT * FROM {_MATRIX}")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_predictions(spark, sf), *metrics.KEYS)


@query(
    "confusion_pivot",
    f"""SELECT model, classifier, CASE WHEN label = 0 THEN 'Actual Left' ELSE 'Actual Right' END AS actual_class,
 count(*) FILTER (prediction = 0) AS pred_left, count(*) FILTER (prediction = 1) AS pred_right FROM {_P} GROUP BY ALL""",
)
def confusion_pivot(spark, sf):
    matrix = metrics.confusion_matrix(_predictions(spark, sf), "model", "classifier")
    return metrics.confusion_pivot(matrix, "model", "classifier")


@query(
    "confusion_total",
    f"SELECT model, stage, classifier, actual, predicted, CAST(sum(n) AS BIGINT) AS n FROM {_MATRIX} GROUP BY ALL",
)
def confusion_total(spark, sf):
    return metrics.total_confusion(metrics.confusion_matrix(_predictions(spark, sf), *metrics.KEYS))


@query(
    "accuracy",
    f"SELECT {_KEYS}, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM {_P} GROUP BY ALL",
)
def accuracy(spark, sf):
    return metrics.accuracy(_predictions(spark, sf), *metrics.KEYS).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "classification_report",
    f"""WITH c AS (SELECT model, classifier, k AS class, count(*) FILTER (label = k) AS support,
   coalesce(count(*) FILTER (label = k AND prediction = k) / nullif(count(*) FILTER (prediction = k), 0), 0) AS p,
   coalesce(count(*) FILTER (label = k AND prediction = k) / nullif(count(*) FILTER (label = k), 0), 0) AS r,
   count(*) FILTER (label = k AND prediction = k) AS hits
   FROM {_P}, (VALUES (0), (1)) v(k) GROUP BY ALL),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM c)
 SELECT model, classifier, CAST(class AS VARCHAR) AS entry, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM f
 UNION ALL SELECT model, classifier, 'accuracy', round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9), round(sum(hits) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f GROUP BY ALL
 UNION ALL SELECT model, classifier, 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f GROUP BY ALL
 UNION ALL SELECT model, classifier, 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(r * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f GROUP BY ALL""",
)
def classification_report(spark, sf):
    report = metrics.classification_report(_predictions(spark, sf), "model", "classifier")
    return report.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


_SCORES = f"(SELECT model, classifier, fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM {_P} GROUP BY ALL)"
_SUMMARY = f"""SELECT model AS "Model", avg(a) FILTER (classifier = 'LR') AS "LR Mean", stddev_pop(a) FILTER (classifier = 'LR') AS "LR Std",
 avg(a) FILTER (classifier = 'SVC') AS "SVC Mean", stddev_pop(a) FILTER (classifier = 'SVC') AS "SVC Std" FROM {_SCORES} GROUP BY model"""
_ROUNDED = ", ".join(f'round("{c} {s}", 9) AS "{c} {s}"' for c in ("LR", "SVC") for s in ("Mean", "Std"))


def _summary(spark, sf):
    return metrics.cv_summary(metrics.accuracy(_predictions(spark, sf), "model", "classifier", "fold"))


@query("cv_summary", f'SELECT "Model", {_ROUNDED} FROM ({_SUMMARY})')
def cv_summary(spark, sf):
    return _summary(spark, sf).withColumns(
        {f"{c} {s}": F.round(f"`{c} {s}`", 9) for c in ("LR", "SVC") for s in ("Mean", "Std")}
    )


@query(
    "summary_text",
    f"""SELECT "Model", printf('LR:  %.3f ± %.3f', "LR Mean", "LR Std") AS lr_line, printf('SVC: %.3f ± %.3f', "SVC Mean", "SVC Std") AS svc_line FROM ({_SUMMARY})""",
)
def summary_text(spark, sf):
    return metrics.summary_text(_summary(spark, sf))


@query(
    "fold_class_counts",
    f"SELECT fold, count(*) FILTER (label = 0) AS n_left, count(*) FILTER (label = 1) AS n_right FROM {Q.FOLDS} GROUP BY 1",
)
def fold_class_counts(spark, sf):
    return metrics.class_counts(splits.stratified_folds(labelled_keys(spark, sf), "doc_id", "label"), "fold")


def _folded(spark, sf):
    rows = labelled_keys(spark, sf, "source")
    return rows.join(splits.stratified_folds(rows, "doc_id", "label").drop("label"), "doc_id")


_LISTED = f"""(SELECT t.fold, CASE WHEN f.fold = t.fold THEN 'test' ELSE 'train' END AS part, source, count(*) AS n
 FROM {Q.FOLDS} f, (SELECT CAST(unnest(range(5)) AS INT) AS fold) t GROUP BY ALL)"""


@query("fold_sources", f"SELECT * FROM {_LISTED}")
def fold_sources(spark, sf):
    return metrics.fold_sources(_folded(spark, sf), "source", K.N_FOLDS)


@query(
    "fold_source_lists",
    f"""SELECT fold, string_agg(source, ', ' ORDER BY source) FILTER (part = 'train') AS train_sources,
 string_agg(source, ', ' ORDER BY source) FILTER (part = 'test') AS test_sources FROM {_LISTED} GROUP BY fold""",
)
def fold_source_lists(spark, sf):
    return metrics.join_sources(metrics.fold_sources(_folded(spark, sf), "source", K.N_FOLDS))


_TESTED = f"SELECT model AS \"Model\", avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (classifier = 'SVC') AS acc FROM {_P} GROUP BY model"


@query("best_model", f'SELECT "Model" FROM ({_TESTED}) ORDER BY acc DESC, "Model" LIMIT 1')
def best_model(spark, sf):
    from newsloom.plans import experiments

    tested = experiments.test_rows(_predictions(spark, sf, "TEST"))
    return ranking.best_model(tested, "SVC Test Acc").select("Model")


@query("embedding_class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def embedding_class_counts(spark, sf):
    from newsloom.operators import profiling

    return profiling.label_distribution(table(spark, sf, "embeddings"))
