"""Every stage on its own input, against plain Python."""
import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from newsloom.llm import secret_scan, toxicity
from newsloom.llm.common import saved, table

from small import smallest_reachable
from test_simhash_dedup import slow_simhash

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.exists(FOLDER), reason="the given tables are not here")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "", re.ASCII))


@needs_tables
def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, FOLDER), name)
        seen.append((name, before.collect(), docs.collect()))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    (_, raw, clean), (_, _, single), (_, _, masked), (_, _, mixed), (_, _, packed) = seen

    scores = toxicity.score(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")).collect()
    bad = {r.doc_id for r in scores if r.predicted}
    assert bad and {r.doc_id for r in clean} == {r.doc_id for r in raw} - bad
    text = {r.doc_id: r.text for r in raw}

    prints = {r.doc_id: slow_simhash(r.text) for r in clean}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    root = smallest_reachable(ids, links)
    assert sorted(r.doc_id for r in single) == [i for i in ids if root[i] == i]
    assert all(r.text == text[r.doc_id] for r in single)

    assert {r.doc_id: r.text for r in masked} == {r.doc_id: secret_scan.masked(text[r.doc_id]) for r in single}
    assert any(secret_scan.MASK in r.text for r in masked)
    assert not any(secret_scan.base_spans(r.text) for r in masked if secret_scan.MASK not in r.text)

    size, total = {r.doc_id: words(r.text) for r in masked}, Counter()
    source = {r.doc_id: r.source for r in masked}
    for i, n in size.items():
        total[source[i]] += n
    took, per_doc = Counter(), Counter()
    for r in mixed:
        took[r.source] += words(r.text)
        per_doc[r.doc_id] += words(r.text)
    assert all(n <= 3 * size[i] for i, n in per_doc.items())
    assert abs(sum(took.values()) - sum(total.values())) <= len(total)

    pieces, bins = Counter(), defaultdict(list)
    for r in packed:
        pieces[r.doc_id] += r.piece == 0
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter(r.doc_id for r in mixed)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@needs_tables
def test_run_is_repeatable(spark):
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "piece", "length", "ids_crc32").collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_awkward_rows(spark, tmp_path):
    from small import documents

    rows = [(i, t, None, s, None if t is None else len(t)) for i, t, s in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS part")
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table_ in (docs, docs.limit(0)):
        out = table_
        for name, stage in corpus_pipeline.STAGES:
            out = saved(stage(spark, out, str(tmp_path)), name)
            assert name == "best_fit_packing" or out.columns == docs.columns
        assert (out.count() > 0) == (table_ is docs)
