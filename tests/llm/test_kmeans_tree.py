"""Nearest neighbours against brute force."""
import math

import numpy as np
import pytest

from newsloom.llm import kmeans_tree as T


def brute(rows, most=20, step=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q % step:
            continue
        for i, w in ok:
            if i != q and len(w) == len(v):
                out[q, i] = max(out.get((q, i), -math.inf), float((w * v).sum()))
    near = {}
    for (q, i), s in out.items():
        near.setdefault(q, []).append((-s, i))
    return {q: sorted(found)[:most] for q, found in near.items()}


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, vec string, leaf int")


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((-r.score, r.vec_id))
    return got


def data():
    r = np.random.RandomState(2)
    centres = r.normal(size=(12, 10))
    rows = [(k, ((centres[k % 12] + 0.3 * r.normal(size=10)) * (1 + k % 3)).tolist()) for k in range(1500)]
    rows += [(k, rows[40][1]) for k in range(2000, 2100)]  # copies: ties
    rows += [(60, rows[7][1]), (None, [1.0] * 10), (2200, None), (2220, [0.0] * 10), (2240, [math.nan] * 10), (2260, [None] * 10), (2280, [math.inf] * 10)]
    return rows + [(2300, []), (2320, [1.0, 2.0]), (2321, [3.0, -1.0]), (2340, [2.0])]


def test_all_leaves_give_the_exact_answer(spark):
    rows = data()
    got = answers(T.nearest(table(spark, rows).repartition(6), recall=1.0, leaf_rows=10**6))
    want = brute(rows)
    assert got == want and len(want[2320]) == 1 and 2220 not in got and 2340 not in got


@pytest.mark.parametrize("task_bytes", [16 << 20, 20_000])
def test_calibrated_recall(spark, task_bytes):
    rows = data()
    got = answers(T.nearest(table(spark, rows).repartition(6), leaf_rows=40, task_bytes=task_bytes))
    want = brute(rows)
    true = {(q, i): s for q, found in want.items() for s, i in found}
    found = {(q, i): s for q, own in got.items() for s, i in own}
    assert len(true.keys() & found.keys()) >= 0.93 * len(true)
    assert all(found[k] == true[k] for k in true.keys() & found.keys())
    assert all(len(got[q]) == len(own) for q, own in want.items() if len(own) == 20)


def test_best_bins_come_first():
    r = np.random.RandomState(0)
    x = r.normal(size=(600, 5))
    tree = T.Tree(x, 30)
    leaves = {k for k, c in enumerate(tree.children) if c is None}
    assert set(tree.leaves(x).tolist()) <= leaves
    for query, order in zip(x[:20], tree.visits(x[:20])):
        assert sorted(order) == sorted(leaves) and tree.visits(query[None], 3)[0] == order[:3]


def test_nothing_to_search(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(20, None)], [(1, [1.0])], [(20, [0.0])], [(20, [1.0])]):
        assert T.nearest(spark.createDataFrame(rows, schema)).collect() == []
