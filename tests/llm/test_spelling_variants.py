"""Spelling variants against brute force over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import pytest

from newsloom.llm import spelling_variants as S

from small import documents


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def texts():
    r = random.Random(3)
    base = ["".join(r.choice("abcé÷") for _ in range(r.randint(6, 9))) for _ in range(60)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc" * 5, "z" * 40, "z" * 39, "z" * 24, "z" * 25, "y" * 23 + "x", "y" * 24]
    pool = set(base)
    for w in base:
        for _ in range(6):
            k = r.randrange(len(w) + 1)
            pool.add(r.choice([w[:k] + w[k + 1:], w[:k] + r.choice("abcéÿ") + w[k:], w[:k] + r.choice("abcd") + w[k + 1:]]))
    pool = sorted(pool)
    rows = [(None if k == 7 else k % 50, " ".join(r.choice(pool).title() if k % 3 else r.choice(pool) for _ in range(120))) for k in range(120)]
    rows += [(500 + k, (w + " ") * r.choice([5, 30, 200])) for k, w in enumerate(pool) if k % 2]
    return rows + [(None, "chains " * 700 + "chaixs " * 60 + "chaixt " * 6)]


@pytest.mark.parametrize("node_words,levels", [(20_000, 24), (3, 8)])
def test_variants_are_those_of_all_pairs(spark, node_words, levels):
    rows = texts() + [(i, t) for i, t, _ in documents()] * 2
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string").repartition(5)
    got = sorted(tuple(r) for r in S.variants(docs, levels=levels, node_words=node_words).collect())
    counts = brute_words(rows)
    want = brute(counts)
    assert len(want) > 100 and max(len(w) for w in counts) > 24
    assert got == want
    assert any(w[1] and w[2] != w[1] for w in want)  # a form of a form


def test_nothing_to_count(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.variants(empty).collect() == []
    assert S.variants(spark.createDataFrame([(1, None), (2, "short word"), (None, "")], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, "letters " * 6)], "doc_id long, text string")
    assert [tuple(r) for r in S.variants(only).collect()] == [("letters", None, "letters", 6, 0, None)]


def test_very_long_words(spark):
    a, b = "q" * 30_000 + "a" + "q" * 30_000, "q" * 60_000
    docs = spark.createDataFrame([(k, f"{a} {b}") for k in range(5)], "doc_id long, text string")
    got = {r.word: (r.n, r.n_near) for r in S.variants(docs).collect()}
    assert got == {a: (5, 1), b: (5, 1)}


def test_tables_of_words_are_not_sent_out(spark):
    """Files are small where their rows, exploded and in memory, are not."""
    docs = spark.createDataFrame([(1, "letters lettera letterb " * 6 + ("y" * 30 + " ") * 6)], "doc_id long, text string")
    listed = S.words(docs)
    for made in (S.near_pairs(listed), S.variants(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        sent = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[node#" not in line]
        assert "SortMergeJoin" in plan and not sent
