"""Held-out accuracy of the two learned scores, restoration, and awkward rows."""
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import quality, toxicity
from newsloom.llm.common import table

from small import documents

FOLDER = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.exists(FOLDER), reason="the given tables are not here")


def held_out(spark, scored, label):
    rows = scored.filter("held_out").join(table(spark, FOLDER, "labels"), "doc_id").toPandas()
    rank, y = rows["score"].rank(), rows[label] == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    return area, rows[(rows[label] == 0)]["predicted"].mean(), rows[y]["predicted"].mean()


@needs_tables
def test_quality_on_held_out_rows(spark):
    scored = quality.score(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    area, wrong, right = held_out(spark, scored, "quality")
    assert area > 0.99 and wrong < 0.2 and right > 0.99


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.score(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    area, wrong, right = held_out(spark, scored, "toxic")
    assert area > 0.9 and wrong < 0.02 and right > 0.7


@needs_tables
def test_disguised_words_are_restored(spark):
    docs = table(spark, FOLDER, "documents")
    restorer = toxicity.Restorer(toxicity.character_model(docs))
    for told, meant in (
        ("1d1ot", "idiot"), ("idiooooot", "idiot"), ("id.i.o.t", "idiot"), ("m0r0n", "moron"), ("p@th3tic", "pathetic"),
        ("l0$er", "loser"), ("Thereaou!!", "thereaou"), ("the", "the"), ("loweischaft", "loweischaft"), ("555-6268", "555-6268"),
    ):
        assert restorer.text(told) == meant
    assert restorer.text("you w o r t h l e s s thing") == "you worthless thing"


def test_viterbi_finds_the_cheapest_path():
    costs = np.random.RandomState(0).uniform(0.1, 3, (27, 27, 27))
    from itertools import product

    span, options = "a4a|s", [[("a", 0)], [("a", toxicity.SWAP), ("", toxicity.DROP)], [("a", 0)], [("i", toxicity.SWAP), ("l", toxicity.SWAP), ("", toxicity.DROP)], [("s", 0)]]
    best = None
    for path in product(*options):
        word, total = "".join(c for c, _ in path), sum(k for _, k in path)
        codes = [0, 0] + [ord(c) - 96 for c in word] + [0]
        total += sum(costs[codes[i], codes[i + 1], codes[i + 2]] for i in range(len(codes) - 2))
        best = min(best or (total, word), (total, word))
    assert toxicity.viterbi(span, costs.ravel().tolist()) == best[1]


def test_isotonic_rises():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert (np.diff(y) >= 0).all() and x.tolist() == sorted(x) and y[0] < 0.5 < y[-1]
    assert np.interp(1, x, y) == np.interp(2, x, y)


@pytest.mark.parametrize("operator", [quality.score, toxicity.score])
def test_awkward_rows(spark, operator):
    rows = documents() + [(100 + k, ("idiot " if k % 2 else "fine ") * 9 + "words!!" * (k % 2), "s") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS score", "2 AS label", "3 AS stats")
    marks = [(100 + k, k % 2, k % 2) for k in range(60)] + [(None, 1, 1), (1, None, None), (4, 7, 7), (101, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "0 AS score", "'x' AS text")
    out = operator(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[101] > 0.7 > 0.3 > by[100] and by[1] == by[2]
    empty = [r.score for r in got if r.doc_id in (4, 5)]
    assert len(set(empty)) == 1
    assert operator(docs.limit(0), labels).collect() == [] == operator(docs.limit(0), labels.limit(0)).collect()
    flat = {r.score for r in operator(docs, labels.filter(F.lit(False))).collect()}
    assert flat == {0.5}


@needs_tables
def test_look_alikes_at_edges_doubled_letters_and_short_runs(spark):
    docs = table(spark, FOLDER, "documents")
    restorer = toxicity.Restorer(toxicity.character_model(docs), *toxicity.word_counts(docs))
    for told, meant in (
        ("!diot", "idiot"), ("|diot", "idiot"), ("@$$", "ass"), ("iidiot", "idiot"), ("mmoron", "moron"), ("l0$er!", "loser"),
        ("the!!", "the"), ("(the", "the"), ("!!!", ""), ("$100", "$100"), ("555-6268", "555-6268"),
    ):
        assert restorer.text(told) == meant, (told, restorer.text(told))
    assert restorer.text("10$3+") != "10$3+" and restorer.text("10$3+").isalpha()
    words, others = restorer.readings("such a i d i o t here")
    assert "idiot" in words + others and {"such", "here"} <= set(words)
    assert len(restorer.words("x s h y z")) < 5 and len(restorer.words("b a d")) == 1
    assert restorer.words("1 2 3") == ["1", "2", "3"]


def test_few_paths_are_decoded_as_by_states(monkeypatch):
    """Path by path or state by state: the same letters."""
    import random

    from newsloom.llm import toxicity as X

    r, table = random.Random(5), np.random.RandomState(5).exponential(3, 27**3).tolist()
    spans = ["".join(r.choice("aabbceeiioosst!*@$0134.-( é日") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    edges = [(r.randint(0, 1), r.randint(0, 1)) for _ in spans]
    fast = [X.viterbi(s, table, e) for s, e in zip(spans, edges)]
    monkeypatch.setattr(X, "FEW_PATHS", 0)
    assert fast == [X.viterbi(s, table, e) for s, e in zip(spans, edges)]


def test_double_letters_need_no_lattice(monkeypatch):
    rng = random.Random(5)
    costs = np.random.default_rng(5).uniform(0, 8, (27, 27, 27))
    restorer = toxicity.Restorer(costs)
    words = {"".join(rng.choice("aabbcdé") for _ in range(rng.randint(2, 9))) for _ in range(400)}
    words = sorted(w for w in words if not toxicity._THRICE.search(w))
    slow = [toxicity.viterbi(w, restorer.costs) for w in words]
    assert any(len(a) < len(w) for a, w in zip(slow, words)) and any(toxicity._doubled(a) for a in slow)
    odd = ["aaab", "ßaa", "ааb", "baa!", "b4aa"]  # thrice, no plain letters, marks that may be letters
    known = [toxicity.viterbi(w, restorer.costs) for w in odd[:3]]
    calls = []
    viterbi = toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda *a, **k: calls.append(a[0]) or viterbi(*a, **k))
    assert [restorer.decoded(w) for w in words] == slow and [restorer.decoded(w + ",") for w in words] == slow
    assert not calls
    assert [restorer.decoded(w) for w in odd][:3] == known and calls == odd


def test_evidence_without_a_rows_own_share():
    table, odds = {5: (1, 4), 9: (2, 6), 11: (3, 7)}, 0.25
    words = [[[5, 8], [9], [7]], [], [[11, 9, 5], [8], [5], [11], [9]], [[1]]]
    labels = [0, 1, 1, 0]
    want = []
    for label, own in zip(labels, words):
        found = [
            max([0.0, *[float(toxicity._weight(table[t][0] - (1 - label), table[t][1] - label, odds)) for t in terms if t in table]])
            for terms in own
        ]
        want.append(toxicity._evidence(found))
    batch = pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(words, pa.list_(pa.list_(pa.int64())))], ["label", "words"])
    for rows in ([batch], [batch.slice(0, 1), batch.slice(1)]):
        got = pa.Table.from_batches(list(toxicity._own_evidence(table, odds)(iter(rows))))
        assert got.column("label").to_pylist() == labels
        assert np.allclose(np.column_stack([got.column(c).to_numpy() for c in "abcd"]), want, rtol=1e-12, atol=0)
    none = pa.Table.from_batches(list(toxicity._own_evidence({}, odds)(iter([batch]))))
    assert not any(any(none.column(c).to_pylist()) for c in "abcd")


def test_words_are_weighed_once_and_by_their_beginnings():
    terms = {toxicity._term("awful"): 2.5, toxicity._term("nast*"): 1.5, toxicity._term("so*"): 9.0}
    model = toxicity.Model(np.ones((27, 27, 27)), terms, np.array([1.0, 1, 1, 1, 0]), {}, 1)
    scorer = toxicity.Scorer(model, 2)
    assert sorted(scorer._weights("Awful awful, nastily nasty so nice (awful) nastily")) == [1.5, 1.5, 2.5]
    assert scorer._weights("") == [] and scorer._weights("a w f") == []
