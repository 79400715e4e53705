import numpy as np
import pytest

from newsloom.llm import embedding_dedup as E

from small import smallest_reachable


def vectors(size=16, seed=0):
    r = np.random.RandomState(seed)
    x = r.normal(size=(150, size))
    near = x[:40] + r.normal(size=(40, size)) * np.linspace(0.05, 0.5, 40)[:, None]
    crowd = x[0] + r.normal(size=(120, size)) * 0.08
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.vstack([x, near, crowd]))]
    n = len(rows)
    rows += [(n + k, rows[5][1]) for k in range(30)]  # equal ones
    rows += [(n + 40, [2 * v for v in rows[7][1]]), (n + 41, [-v for v in rows[7][1]])]
    bad = [None, [], [0.0] * size, [float("nan")] + rows[3][1][1:], [float("inf")] + rows[3][1][1:], [None] + rows[3][1][1:], rows[3][1][:-1]]
    rows += [(n + 50 + k, v) for k, v in enumerate(bad)]
    rows += [(None, rows[9][1]), (2, rows[2][1])]
    return rows


def expected(rows):
    valid = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v in rows]
    links, pairs = [0] * len(rows), []
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if valid[i] and valid[j] and len(x) == len(y):
                p, q = np.array(x, float), np.array(y, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    if a is not None and b is not None:
                        pairs.append((a, b))
    root = smallest_reachable({i for i, _ in rows if i is not None}, [p for p in pairs if p[0] != p[1]])
    return sorted((-1 if i is None else i, n, -1 if i is None else root[i], i is not None and root[i] == i) for (i, _), n in zip(rows, links))


@pytest.mark.parametrize("size,strip", [(16, 16_384), (64, 20), (3, 50)])
def test_against_brute_force(spark, monkeypatch, size, strip):
    monkeypatch.setattr(E, "STRIP_ROWS", strip)
    rows = vectors(size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS cls", "3 AS label")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in E.near_duplicates(df).collect())
    assert got == expected(rows)


def test_doubles_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in E.near_duplicates(df).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert E.near_duplicates(df.limit(0)).collect() == []


def test_sql_twin_on_linked_vectors(spark):
    """The SQL of the query against the operator, on vectors that do link."""
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    from newsloom.llm.queries import ORACLES

    rows = [(i, v) for i, v in vectors(8, 3) if i is not None and v and None not in v][:-1]
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["vec_id", "embedding"]))
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM given")
    want = sorted(con.execute(ORACLES["op3_subspace_pigeonhole"]).fetchall())
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] for r in want) > 100


@pytest.mark.parametrize("split", [False, True])
def test_a_group_compares_fewer_than_all_its_pairs(monkeypatch, split):
    """Vectors without structure, some with a near one: all links of the group are
    found, though many pairs are never compared."""
    r = np.random.RandomState(2)
    x = r.normal(size=(12_000, 64))
    x[:300] = x[300:600] + 0.1 * r.normal(size=(300, 64))
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    here, number = E.space(64), 0
    turned = here.rotated(unit)
    strip = np.floor(turned[:, here.blocks[number].start] / here.widths[number])
    unit, turned, guest = unit[(strip == 0) | (strip == 1)], turned[(strip == 0) | (strip == 1)], strip[(strip == 0) | (strip == 1)] == 1
    chunk, count = np.arange(len(unit)) % 2 * split, []
    plain = np.count_nonzero

    def counted(found):
        count.append(found.size)
        return plain(found)

    with monkeypatch.context() as m:
        m.setattr(np, "count_nonzero", counted)
        found = list(E._group_links(here, number, unit, guest, chunk, split))
    got = [tuple(sorted(p)) for a, b in found for p in zip(a.tolist(), b.tolist())]
    cosines = unit @ unit.T
    part = turned[:, here.blocks[number]]
    want = {
        (i, j) for i, j in np.argwhere(np.triu(cosines >= 0.95, 1)).tolist()
        if ((part[i] - part[j]) ** 2).sum() <= here.budgets[number] and not (guest[i] and guest[j]) and (not split or chunk[i] != chunk[j])
    }
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert sum(count) < (0.4 if split else 0.7) * len(unit) ** 2 / 2
