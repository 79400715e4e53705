import hashlib

import numpy as np

from newsloom.llm import order_minhash as O

from small import documents


def slow_signature(text):
    """Every k-mer with its occurrence, every function, no short cuts."""
    if not text:
        return [0] * O.HASHES
    text = text.ljust(O.K, b"\0")
    base, place = O._numbered(text)
    # occurrence numbers by plain counting
    seen, numbered = {}, set()
    for k in range(len(text) - O.K + 1):
        gram = text[k:k + O.K]
        seen[gram] = seen.get(gram, -1) + 1
        numbered.add((gram, seen[gram]))
    assert len(set(base.tolist())) == len(base) == len(numbered) and sorted(place.tolist()) == list(range(len(base)))
    out = []
    for i in range(O.HASHES):
        values = [int(b) * int(O._ODD[i]) % 2**64 for b in base]
        low = sorted(range(len(base)), key=values.__getitem__)[:O.TUPLE]
        entry = np.array([i + 1], np.uint64)
        for k in sorted(low, key=place.__getitem__):
            entry = O._stir(entry * O._C + base[k])
        out.append(int(entry[0] >> np.uint64(32)))
    return out


def test_signature_against_brute_force():
    texts = [b"", b"a", b"abcdefgh", b"abcdefghi", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"the cat sat on the mat, the cat sat " * 30]
    texts += [bytes(np.random.RandomState(k).randint(97, 123, 1500, dtype=np.uint8)) for k in range(3)]
    for text in texts:
        assert O.signature(text).tolist() == slow_signature(text)


def test_order_counts():
    random = np.random.RandomState(1)
    words = ["".join(map(chr, random.randint(97, 123, 6))) for _ in range(400)]
    text = " ".join(words).encode()
    swapped = " ".join(words[200:] + words[:200]).encode()  # same k-mers, other order
    changed = " ".join(w if k % 50 else "changed" for k, w in enumerate(words)).encode()
    same = O.likeness(O.signature(text), O.signature(text))
    assert same == 1 > O.likeness(O.signature(text), O.signature(changed)) > O.likeness(O.signature(text), O.signature(swapped))


def test_every_row_against_brute_force(spark):
    rows = documents() + [(-5, "negative id " * 20, None), (2**60, "a large id", "x"), (2**60 + 1, "the next one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS guest")
    got = [tuple(r) for r in O.fingerprints(docs.repartition(5)).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = (text[:len(text) - half] + after[:half]).encode()
        a, b, c = (O.signature(t) for t in (text.encode(), changed, after.encode()))
        want.append((i, len(text), hashlib.sha256(changed).hexdigest(), O._hex(a), O._hex(b), O.likeness(a, b), O.likeness(a, c)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_one_row_and_none(spark):
    one = O.fingerprints(spark.createDataFrame([(7, "alone but here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert O.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
