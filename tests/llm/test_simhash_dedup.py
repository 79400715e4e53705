from itertools import combinations

import xxhash

from newsloom.llm import simhash_dedup as S

from small import documents, smallest_reachable


def slow_simhash(text):
    words, w = [], []
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if ch == " " or "\t" <= ch <= "\r":
            words, w = words + (["".join(w)] if w else []), []
        else:
            w.append(ch)
    words += ["".join(w)] if w else []
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_four_positions_hold_a_list():
    assert len(S.POSITIONS) == 20
    assert all(any(set(t) <= set(four) for t in S.POSITIONS) for four in combinations(range(8), 4))


def test_against_brute_force(spark):
    rows = documents() + [(900 + k, "one two three four five six %d" % (k % 3), "src0") for k in range(40)]
    # a long text and copies of it that differ in a few words: near fingerprints
    base = " ".join("w%d" % (k * 7919 % 1000) for k in range(3000)).split()
    for k in range(60):
        words = list(base)
        words[50 * k] = "other"
        rows.append((2000 + k, " ".join(words), "src1"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS bits", "2 AS component_id")
    got = [tuple(r) for r in S.near_duplicates(docs).collect()]
    prints = [(i, slow_simhash(t)) for i, t, _ in rows]
    known = sorted({p for p in prints if p[0] is not None})
    links = [(a, b) for a, x in known for b, y in known if a < b and (x ^ y).bit_count() <= 4]
    root = smallest_reachable([i for i, _ in known], links)
    want = [(i, format(p, "016x"), None if i is None else root[i]) for i, p in prints]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len({root[2000 + k] for k in range(60)}) < 60


def test_split_lists_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "LIST_ROWS", 3)
    rows = [(k, (0b1 << k % 20) | 0xABCDE << 40) for k in range(20)]
    got = S.fingerprint_links(spark.createDataFrame(rows, "rep long, bits long")).collect()
    links = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 4]
    nodes = [a for a, _ in rows]
    assert smallest_reachable(nodes, [(r.a, r.b) for r in got]) == smallest_reachable(nodes, links)


def test_one_of_each_group_stays(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = S.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert sum(i is None for i in ids) == 2 and 1 in ids and 2 not in ids


def test_repeated_ids_and_extra_columns(spark):
    words = [f"{w} {k}" for k, w in enumerate("north south east west".split())]
    long = lambda k: " ".join(f"{words[k % 4]}{k}x{j}" for j in range(30))
    rows = [(k, long(k), k, {"a": k}) for k in range(20)]
    rows += [(3, long(40 + k % 2), 100 + k, {"a": k}) for k in range(60)]  # one id, three texts
    rows += [(None, long(7), 500 + k, {}) for k in range(30)] + [(30, long(5), 600, {}), (30, long(5), 601, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `gone` int, `n` map<string,int>").repartition(7)
    kept = S.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.gone) for r in kept.collect()]
    assert sorted(i for i, _ in got if i is not None) == list(range(20))  # 30 is a copy of 5
    assert sorted(g for i, g in got if i is None) == list(range(500, 530))
    again = [(r.doc_id, r.gone) for r in S.keep_one_of_each_group(docs.repartition(3)).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == [] and S.keep_one_of_each_group(docs).collect() == []
