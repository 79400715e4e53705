import hashlib
import re

from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from newsloom.features import embeddings, linguistic, nmf, scaling, sentiment, tfidf
from newsloom.features.registry import FEATURE_SETS
from newsloom.operators import linear


@pytest.fixture(scope="module")
def corpus(spark):
    words = "red fox jumps lazy dog river stone bridge market price bank vote law court team goal".split()
    docs = [(i, " ".join(words[(i * 3 + j * j) % 16] for j in range(12)), i % 2) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string, label int").persist()


def test_tfidf_closed_form(spark):
    df = tfidf.with_terms(spark.createDataFrame([(1, "red fox"), (2, "red dog")], "doc_id long, text string"))
    model = tfidf.fit(df)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.long_form(model.transform(df), model, "doc_id").collect()}
    rare, common = log(3 / 2) + 1, 1.0
    norm = sqrt(2 * rare**2 + common**2)
    assert got[(1, "fox")] == pytest.approx(rare / norm) and got[(1, "red")] == pytest.approx(common / norm)


def test_no_column_for_test_only_terms(corpus):
    rows = tfidf.with_terms(corpus.withColumn("text", F.when(F.col("doc_id") < 10, F.concat("text", F.lit(" secretterm"))).otherwise(F.col("text"))))
    model = tfidf.fit(rows.where("doc_id >= 10"))
    assert "secretterm" not in model.terms
    terms = {r["term"] for r in tfidf.long_form(model.transform(rows), model, "doc_id").collect()}
    assert "secretterm" not in terms and terms <= set(model.terms)


def test_tfidf_does_not_depend_on_partitions(corpus):
    a = tfidf.fit(tfidf.with_terms(corpus.coalesce(1)))
    b = tfidf.fit(tfidf.with_terms(corpus.repartition(8)))
    assert a == b


def test_nmf_loss_falls_and_weights_are_nonnegative(corpus):
    rows = tfidf.with_terms(corpus)
    model = tfidf.fit(rows)
    x = model.transform(rows).select("doc_id", "tfidf").persist()
    one = nmf.fit(x.coalesce(1), "doc_id", "tfidf", len(model.terms), k=4, max_iter=15, tol=0.0)
    assert (one.topics >= 0).all()
    assert all(b <= a + 1e-6 for a, b in zip(one.losses, one.losses[1:])) and one.losses[-1] < one.losses[0]
    many = nmf.fit(x.repartition(9), "doc_id", "tfidf", len(model.terms), k=4, max_iter=15, tol=0.0, fan_in=2)
    assert np.allclose(one.losses, many.losses, atol=1e-6)
    weights = one.transform(x, "doc_id").collect()
    assert len(weights) == 60 and min(min(r["topics"].toArray()) for r in weights) >= 0


def test_nmf_starts_from_singular_vectors(spark, corpus):
    rows = tfidf.with_terms(corpus)
    model = tfidf.fit(rows)
    x = model.transform(rows).select("doc_id", "tfidf").persist()
    width = len(model.terms)
    start = nmf.fit(x, "doc_id", "tfidf", width, k=4, max_iter=1)
    again = nmf.fit(x.repartition(5), "doc_id", "tfidf", width, k=4, max_iter=1)
    dense = np.array([r["tfidf"].toArray() for r in x.collect()])
    left, values, right = np.linalg.svd(dense, full_matrices=False)
    lead = np.abs(right[0])
    # the leading vector of a non-negative matrix has one sign
    first = nmf._initial_topics(exact_sums(dense), dense.sum(axis=0), 4, 3)[0]
    assert first @ lead / np.linalg.norm(first) == pytest.approx(1, abs=1e-3)
    assert start.losses[0] == pytest.approx(again.losses[0], rel=1e-6)
    # fewer documents than topics: the rest stay random and positive
    few = nmf.fit(x.where("doc_id < 2"), "doc_id", "tfidf", width, k=4, max_iter=5, tol=0.0)
    assert np.isfinite(few.topics).all() and few.losses[-1] < 1e-2
    assert nmf.fit(x.where("doc_id < 0"), "doc_id", "tfidf", width, k=4, max_iter=2).losses[-1] == 0.0


def exact_sums(dense):
    def sums(h, solve):
        w = solve(dense @ h.T, h @ h.T)
        return nmf._Sums(w.T @ dense, w.T @ w, 0.0)

    return sums


def test_nmf_stop_ignores_the_scale_of_topics():
    rng = np.random.default_rng(1)
    dense, h = rng.random((30, 12)), rng.random((3, 12))
    scaled = h * np.array([[10.0], [0.1], [3.0]])
    got = [nmf._gradient(t, exact_sums(dense)(t, lambda xh, gram: nmf._solve_weights(xh, gram, 20000))) for t in (h, scaled)]
    assert got[0] == pytest.approx(got[1], rel=1e-3)


def test_pos_ratios(spark):
    df = spark.createDataFrame([(1, "She quickly painted good houses, we must go."), (2, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linguistic.with_pos_ratios(df).collect()}
    # she we | quickly | painted go | good | houses | must
    assert got[1]["pron_ratio"] == pytest.approx(2 / 8) and got[1]["modal_ratio"] == pytest.approx(1 / 8)
    assert got[1]["adv_ratio"] == got[1]["adj_ratio"] == got[1]["noun_ratio"] - 1 / 8 or got[1]["adv_ratio"] == pytest.approx(1 / 8)
    assert all(got[2][c] == 0.0 for c in linguistic.POS_COLUMNS)


def test_readability_closed_form(spark):
    df = spark.createDataFrame([(1, "The cat sat. It was animated.")], "doc_id long, text string")
    r = linguistic.with_readability(df).first()
    # 6 words, 2 sentences, syllables 1 1 1 1 1 4, 22 letters
    assert r["words_per_sentence"] == 3.0
    assert r["flesch_ease"] == pytest.approx(206.835 - 1.015 * 3 - 84.6 * 9 / 6)
    assert r["gunning_fog"] == pytest.approx(0.4 * (3 + 100 / 6)) and r["smog"] == 0.0


def test_sentiment_rules(spark):
    texts = ["good", "very good", "not good", "good!!", "bad but good", "GOOD day", "day", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentiment.lexicon_sentiment(df, "doc_id").collect()}
    compound = lambda s: s / sqrt(s * s + 15)
    expected = [1.9, 1.9 + 0.293, 1.9 * -0.74, 1.9 + 0.584, -2.5 * 0.5 + 1.9 * 1.5, 1.9 + 0.733, 0.0, 0.0]
    for i, s in enumerate(expected):
        assert got[i]["compound"] == pytest.approx(compound(s)), texts[i]
    assert got[6]["neu"] == 1.0 and got[7]["neu"] == 0.0


def test_embeddings(spark):
    text = " ".join(f"w{i}" for i in range(450))
    df = spark.createDataFrame([(1, text), (2, " "), (3, "one two")], "doc_id long, text string")
    whole = {r["doc_id"]: np.array(r["embedding"]) for r in embeddings.document_embeddings(df, "doc_id", dim=16).collect()}
    parts = {r["doc_id"]: np.array(r["embedding"]) for r in embeddings.document_embeddings(df, "doc_id", dim=16, chunked=True).collect()}
    assert np.linalg.norm(whole[1]) == pytest.approx(1, abs=1e-5) and not parts[2].any()
    def encode(texts):
        """Signed hashing, word by word."""
        out = np.zeros((len(texts), 16))
        for row, text in zip(out, texts):
            for token in re.findall(r"\w\w+", text.lower()):
                code = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
                row[code % 16] += -1 if code >> 31 else 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    words = text.split()
    chunks = [" ".join(words[i : i + 200]) for i in (0, 200, 400)]
    assert np.allclose(parts[1], encode(chunks).mean(axis=0), atol=1e-6) and np.allclose(parts[3], whole[3])


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = scaling.fit_scaler(train, ["a", "b"])
    assert sorted(tuple(r) for r in scaling.scale(train, scaler).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("name", ["tfidf", "full", "embeddings", "chunked"])
def test_feature_sets(corpus, name):
    features = FEATURE_SETS[name]
    rows = features.prepare(corpus, "doc_id").persist()
    out = features.fit(rows.where("doc_id >= 10"), "doc_id", 50)(rows.where("doc_id < 10")).collect()
    assert len(out) == 10 and len({r["features"].size for r in out}) == 1


def batches_of(rows, folds, size):
    for start in range(0, len(rows), size):
        part = slice(start, start + size)
        yield pa.RecordBatch.from_pydict({"folds": pa.array(folds[part], pa.int64()), "terms": pa.array(rows[part], pa.list_(pa.string()))})


def test_a_task_adds_terms_up_before_they_move(monkeypatch):
    rows = [["a", "b", "a"], [], ["b", "a b"], ["a"], None, ["ß", "a"]] * 20
    folds = [1, 3, 3, 2, 1, 3] * 20
    want = Counter()
    for terms, fold in zip(rows, folds):
        for term, n in Counter(terms or []).items():
            want[fold, term, "tf"] += n
            want[fold, term, "df"] += 1
    for limit, size in ((1 << 19, 7), (6, 7), (1, 1)):
        monkeypatch.setattr(tfidf, "COUNTED_ROWS", limit)
        out = [r for b in tfidf._counts(batches_of(rows, folds, size)) for r in b.to_pylist()]
        got = Counter()
        for r in out:
            got[r["folds"], r["term"], "tf"] += r["tf"]
            got[r["folds"], r["term"], "df"] += r["df"]
        assert got == want
        if limit > 100:
            assert len(out) == len({(r["folds"], r["term"]) for r in out})
    assert list(tfidf._counts(batches_of([[], None], [0, 0], 1))) == []


def test_vectors_are_made_a_batch_at_a_time(spark):
    model = tfidf.TfidfModel(("a", "a b", "ß"), (1.0, 2.0, 3.0), 5)
    column = pa.array([["a", "x", "a", "ß"], [], None, ["x"], ["a b"]], pa.list_(pa.string()))
    got = tfidf._vectors(model.terms, model.weights)(column).to_pylist()
    assert got[2] is None and [len(r["indices"]) for r in got if r] == [2, 0, 0, 1]
    assert got[0]["indices"] == [0, 2] and got[0]["values"] == pytest.approx([2 / 13**0.5, 3 / 13**0.5]) and got[4]["values"] == [1.0]
    df = spark.createDataFrame([(1, ["ß", "x"]), (2, [])], "doc_id int, terms array<string>")
    assert {r.doc_id: r.tfidf for r in model.transform(df).collect()} == {1: SparseVector(3, {2: 1.0}), 2: SparseVector(3, {})}


def test_topic_pass_reads_blocks():
    rng = np.random.default_rng(2)
    dense = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4)
    dense[[0, 7, 29]] = 0.0
    h = rng.random((3, 12))
    lists = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in dense]
    rows = pa.RecordBatch.from_pydict({
        "task": pa.array([0] * 30, pa.int32()), "label": pa.array([0.0] * 30),
        "indices": pa.array([i for i, _ in lists], pa.list_(pa.int32())), "values": pa.array([v for _, v in lists], pa.list_(pa.float64())),
    })
    (sums,) = [r for b in nmf._pass(h)(linear.packed(iter([rows]))) for r in b.to_pylist()]
    w = nmf._solve_weights(dense @ h.T, h @ h.T)
    assert np.allclose(np.frombuffer(sums["a"]).reshape(3, 12), w.T @ dense) and np.allclose(np.frombuffer(sums["b"]).reshape(3, 3), w.T @ w)
    assert sums["cross"] == pytest.approx((w * (dense @ h.T)).sum()) and sums["sq"] == pytest.approx((dense**2).sum())
