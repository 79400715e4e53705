import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from newsloom.llm import mixing as M

from small import documents


def slow_targets(sizes):
    """Exact water filling over (source, size), in order."""
    weights = {s: 1 + k % 3 for k, (s, _) in enumerate(sizes)}
    size, total = dict(sizes), sum(n for _, n in sizes)
    target, open_, rest = {s: Fraction(0) for s, _ in sizes}, [s for s, n in sizes if n], Fraction(total)
    while open_:
        share = {s: rest * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * size[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(3 * size[s])
            rest -= target[s]
            open_.remove(s)
    return target


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "", re.ASCII))


def table(spark):
    rows = documents() + [(100 + k, "w " * (k % 50), f"src{k % 4}" if k % 3 else "hot") for k in range(400)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'x' AS bucket")


def test_shares(spark):
    rows, docs = table(spark)
    got = M.shares(docs).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, count(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = slow_targets([(s, sizes[s]) for s in order])
    source = {i: s for i, _, s in rows if i is not None}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6
            taken[s] += r.taken
    for s in ("hot", "src0", "src1", "src2"):
        assert abs(taken[s] - want[s]) <= 1
    again = {(r.doc_id, r.size, r.taken) for r in M.shares(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}


def test_many_buckets_give_the_same_totals(spark, monkeypatch):
    _, docs = table(spark)
    one = M.shares(docs).agg({"taken": "sum"}).first()[0]
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    assert M.shares(docs).agg({"taken": "sum"}).first()[0] == one


def test_tree_splits_exactly():
    quotas = np.array([1000, 7, 0, 333, 1])
    parts = M.split_tree(quotas, 13)
    assert (parts.sum(1) == quotas).all() and np.ptp(parts.sum(0)) <= 1
    # a hypergeometric draw: the mean of a source's share over seeds is its part
    many = np.array([M.split_tree(np.array([30, 10]), 4, seed)[0, 0] for seed in range(400)])
    assert abs(many.mean() - 7.5) < 0.3 and 0.8 < many.var() < 2.5


def test_mix_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 64)
    monkeypatch.setattr(M, "SHARD_BLOCKS", 40)
    _, docs = table(spark)
    words = M.mixed(docs).groupBy("doc_id").agg({"__words": "sum"}).collect()
    taken = {r.doc_id: r.taken for r in M.shares(docs).groupBy("doc_id").sum("taken").toDF("doc_id", "taken").collect()}
    assert {r[0]: r[1] for r in words if r[1]} == {i: n for i, n in taken.items() if n}
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    total = sum(count(r.text) for r in out.collect())
    assert total == sum(taken.values())
    assert M.mixed(docs).select("__shard").distinct().count() > 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.shares(docs).collect() == [] and M.mix_documents(docs).collect() == []


def test_shares_come_from_the_dealt_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 64)
    monkeypatch.setattr(M, "SHARD_BLOCKS", 40)
    rows, docs = table(spark)
    docs = docs.unionByName(docs.limit(30)).unionByName(docs.filter("doc_id % 7 = 0").selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "source", "size", "bucket"))
    drawn, split = [], M.split_tree
    monkeypatch.setattr(M, "split_tree", lambda quotas, shards, *seed: drawn.append(shards) or split(quotas, shards, *seed))
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in M.shares(docs).collect())
    assert drawn and drawn[0] > 3
    # twin: the running sums alone
    mix = [(r.doc_id, r["__mix"]) for r in M.placed(docs)[0].collect()]
    assert got == Counter((i, m.size, m.source_size, round(m.target, 6), m.size * m.full + m.left) for i, m in mix)
    # a shard that gets lost is missed in the result
    deal = M.dealt
    monkeypatch.setattr(M, "dealt", lambda *a: deal(*a).filter("__shard > 0"))
    assert sum(r.taken for r in M.shares(docs).collect()) < sum(k[-1] * n for k, n in got.items())


def test_the_tree_deals_several_shards_by_default(spark):
    """At its default settings, on the given table, the mix draws more than one shard."""
    from newsloom.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sizes = {r["__shard"]: r["w"] for r in M.mixed(docs).groupBy("__shard").agg({"__words": "sum"}).withColumnRenamed("sum(__words)", "w").collect()}
    assert len(sizes) >= M.MIN_SHARDS and max(sizes.values()) < 0.2 * sum(sizes.values())
