"""Experiments learn together what each would learn alone, and cache nothing that grows with the texts."""
import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsloom.features import nmf, tfidf
from newsloom.features.registry import FeatureSet, _prepare_terms, fit_tfidf_nmf, fit_tfidf_nmf_tasks
from newsloom.operators import models
from newsloom.plans import experiments as E
from newsloom.sources import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    sides = [["market", "stock", "trade", "bank", "price", "profit"], ["goal", "match", "team", "coach", "league", "score"]]
    rows = []
    for i in range(70):
        words = list(rng.choice(sides[i % 2], 12)) + list(rng.choice(sides[1 - i % 2], 3))
        rows.append((i, " ".join(words), i % 2, f"src{i % 7}"))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, source string").localCheckpoint()


TOPICS = FeatureSet(_prepare_terms, fit_tfidf_nmf(4, 3), fit_tasks=fit_tfidf_nmf_tasks(4, 3))


def test_experiments_train_together_and_predict_as_alone(corpus, monkeypatch):
    trained, factored = [], []
    fit_models, fit_topics = models.fit_tasks, nmf.fit_tasks
    monkeypatch.setattr(models, "fit_tasks", lambda train, tasks, names: trained.append(list(tasks)) or fit_models(train, trained[-1], names))
    monkeypatch.setattr(nmf, "fit_tasks", lambda df, v, widths, **k: factored.append(list(widths)) or fit_topics(df, v, widths, **k))
    together = E.run_experiments(corpus, [("plain", "tfidf"), ("topics", TOPICS)])
    assert [len(t) for t in trained] == [12] and [len(t) for t in factored] == [6]
    keys = corpus.select("doc_id", "label")
    marked = E.marked_for_test(corpus, keys, "doc_id")
    alone = E.held_out(marked, "topics", TOPICS, "doc_id").unionByName(
        E.cross_validate(marked.where("NOT is_test").drop("is_test"), "topics", TOPICS, "doc_id")
    )
    assert sorted(map(tuple, together.where("model = 'topics'").collect())) == sorted(map(tuple, alone.collect()))
    assert together.where("model = 'plain'").count() == alone.count() == 2 * (56 + 14)


def test_topics_of_tasks_are_those_of_each_alone(corpus):
    rows = tfidf.with_terms(corpus)
    model = tfidf.fit(rows)
    x = model.transform(rows).withColumn("task", F.col("label") + 4).select("doc_id", "task", "tfidf")
    width = len(model.terms)
    both = nmf.fit_tasks(x.repartition(7), "tfidf", {4: width, 5: width}, k=3, max_iter=6, tol=0.0, fan_in=2)
    for task in (4, 5):
        alone = nmf.fit(x.where(F.col("task") == task).drop("task"), "doc_id", "tfidf", width, k=3, max_iter=6, tol=0.0)
        assert np.allclose(alone.losses, both[task].losses, atol=1e-8) and np.allclose(alone.topics, both[task].topics, atol=1e-6)


def test_no_texts_terms_or_vectors_are_cached(corpus, monkeypatch):
    kept, cls = [], type(corpus)
    plain = cls.persist
    monkeypatch.setattr(cls, "persist", lambda df, *a, **k: kept.append(set(df.columns)) or plain(df, *a, **k))
    marked = E.marked_for_test(corpus, corpus.select("doc_id", "label"), "doc_id")
    E.held_out(marked, "topics", TOPICS, "doc_id").count()
    E.cross_validate(corpus, "topics", TOPICS, "doc_id").count()
    assert all(columns <= {"doc_id", "label", "source"} for columns in kept)


def test_scratch_files_have_small_row_groups_however_long_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "scratch_folder", lambda spark, name: f"{tmp_path}/{name}")

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [i], "data": [np.random.default_rng(i).bytes(1 << 20)]})

    long = spark.range(0, 48, 1, 1).mapInArrow(rows, "id long, data binary")
    assert scratch.stored(long, "long").count() == 48
    sizes = [m.row_group(k).total_byte_size for f in glob.glob(f"{tmp_path}/long/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(sizes) > 48 << 20 and max(sizes) < 24 << 20
