"""Vector codes against plain Lloyd rounds in whole numbers."""
import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import code_compression as C


def plain(rows, rounds=6):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in ok]
    width = len(whole[0]) // 8
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for v in whole[:16]] for p in range(8)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(8):
            held = defaultdict(list)
            for v in whole:
                held[nearest(part(v, p), books[p])[0]].append(part(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, labels = [], defaultdict(int)
    for (i, _, label), v in zip(ok, whole):
        chosen = [nearest(part(v, p), books[p]) for p in range(8)]
        out.append([i, "".join(f"{c:02x}" for c, _ in chosen), sum(d for _, d in chosen), label])
        labels[label] += out[-1][2]
    return [(i, code, error, labels[label], digest) for i, code, error, label in out]


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("block,leaf", [(4096, 16), (37, 2)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    r = np.random.RandomState(4)
    centres = r.normal(size=(9, 16))
    data = [(k, (centres[k % 9] + 0.05 * r.normal(size=16)).round(3).tolist(), int(k % 4) if k % 5 else None) for k in range(400)]
    data += [(k, data[3][1], 7) for k in range(1000, 1150)]  # copies
    data += [(k, [float(x) for x in r.randint(-1, 2, 16)], 8) for k in range(2000, 2100)]  # ties
    data += [(3000, None, 1), (3001, [float("nan")] * 16, 1), (3002, [None] + [1.0] * 15, 1), (3003, [math.inf] * 16, None),
             (3004, [0.0] * 16, None), (3005, [0.0] * 8, 1), (3006, [], 2), (None, [0.25] * 16, 2), (5, data[5][1], 3)]
    df = spark.createDataFrame([(i, v, g, "x") for i, v, g in data], "vec_id long, embedding array<double>, label int, code string")
    got = C.compress(df.repartition(5)).collect()
    assert key(got) == key(plain(data))


def test_bounds_strike_out_only_what_no_row_chooses():
    r = np.random.RandomState(1)
    rows, entries = r.randint(-50, 50, (3000, 3)), r.randint(-50, 50, (16, 3))
    entries[5] = entries[2]  # equal entries: the first is chosen
    tree, book = C.PartTree(rows), C.EntryTree(entries)
    chosen, whole = np.full(len(rows), -1), 0
    for kind, where, entry in C.walk(tree, book):
        if kind == "nodes":
            for (a, b, *total), e in zip(where.tolist(), entry.tolist()):
                assert (tree.rows[a:b].sum(0) == total).all() and (chosen[a:b] == -1).all()
                chosen[a:b] = e
                whole += b - a
        else:
            chosen[where] = entry
    assert (chosen == book.nearest(tree.rows)[0]).all() and whole > 300


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert C.compress(spark.createDataFrame([], schema)).collect() == []
    assert C.compress(spark.createDataFrame([(1, None, 2), (2, [1.0, 2.0], 3)], schema)).collect() == []
    few = [(1, [0.5] * 8, 1), (2, [-0.25] * 8, None), (3, [1e300] * 8, None)]
    rows = {r.vec_id: r for r in C.compress(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int")).collect()}
    assert rows[1].code == "00" * 8 and rows[2].code == "01" * 8 and rows[3].code == "02" * 8 and rows[3].error == 0
