"""Token files and packing against the library's ids, text by text."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsloom.llm import packing as P
from newsloom.llm import token_files as T
from newsloom.llm.word_encoder import WordEncoder

from small import documents

ODD = [
    "it's  x", "a\nb", "a\n\nb", " a", "a ", "don't you'll, I'd.", "ﬁ é́ É É x", "12 3a4 5.", "İ, stanbul ſ ß ẞ Σς ΑΣ", "日本 語", "😀 👍🏽.",
    "a -b --", "a\n.b", "<|endoftext|> <|startoftext|>", "foo... bar!? baz", "\n", "a \n b", "x:y", " ", "", "a​b c", "a\xa0b", "a\tb\r\nc",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, monkeypatch):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    words = WordEncoder(path)
    assert words.kind in ("byte", "lower")
    texts = ODD + [t or "" for _, t, _ in documents()] + [f"word{k} Word {k}, again\nLine {k}." for k in range(50)]
    for limit in (1 << 25, 400):  # with generations that change all the time
        monkeypatch.setattr("newsloom.llm.word_encoder.KEPT_BYTES", limit)
        for _ in range(2):
            got = [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)]
            assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def expected(name, rows):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    return [(i, plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS part", "2 AS start")
    index = T.write(docs.repartition(4), f"file://{tmp_path}/a", public_tokenizers.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in T.read(spark, f"file://{tmp_path}/a").collect()]
    want, at = [], 0
    for i, ids in sorted(expected("byte_bpe_50k.json", rows), key=lambda r: (r[0] is not None, r[0] or 0, [] if r[0] else r[1])):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    known = lambda x: sorted(r for r in x if r[0] is not None)
    assert known(got) == known(want) and len(got) == len(want)
    assert sum(p["tokens"] for p in index["parts"]) == at
    tokens = np.concatenate([np.fromfile(f"{tmp_path}/a/tokens-{p['part']:05d}.bin", index["dtype"]) for p in index["parts"]])
    assert len(tokens) == at and not list(tmp_path.glob("a/.*"))
    again = T.write(docs.coalesce(1), f"{tmp_path}/b", public_tokenizers.path("byte_bpe_50k.json"))
    assert {tuple(r) for r in T.read(spark, f"{tmp_path}/b").collect() if r[0] is not None} == {r for r in got if r[0] is not None}
    assert sum(p["documents"] for p in again["parts"]) == len(rows)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert T.write(docs, f"{tmp_path}/e", path)["parts"] == [] and T.read(spark, f"{tmp_path}/e").collect() == []
    assert P.pack(docs, path).collect() == []


def test_packing(spark):
    rows = documents() + [(100 + k, "some words here " * (k * 37 % 300), "s") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS item", "2 AS fill").repartition(6)
    length = 256
    out = P.pack(docs, public_tokenizers.path("word_bpe_49k.json"), length, with_ids=True)
    got = out.collect()
    want = defaultdict(list)
    total = 0
    for i, ids in expected("word_bpe_49k.json", rows):
        total += len(ids)
        for k in range(0, len(ids), length):
            want[i].append((k // length, k, len(ids[k:k + length]), crc(ids[k:k + length])))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {i: sorted(v) for i, v in have.items()} == {i: sorted(v) for i, v in want.items()}
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    assert len(bins) <= 1.05 * total / length + 2
    whole = P.sequences(out).collect()
    assert sorted(len(r.tokens) for r in whole) == sorted(sum(n for _, n in own) for own in bins.values())


def test_best_fit():
    bins, offsets, used = P.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert used.tolist() == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_slices_of_more_words_than_are_kept(name, monkeypatch):
    monkeypatch.setattr("newsloom.llm.word_encoder.KEPT_BYTES", 700)
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    words = WordEncoder(path)
    few, many = ["one two", "three"], ["one two three", "four five six seven", "eight nine ten one"]
    for texts in (few, many, few, many[::-1], many + few):
        got = [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.pieces) <= 4 and len(words.pieces.old) <= 4


def test_slices_are_cut_by_rows_and_bytes():
    import pyarrow as pa
    from newsloom.llm.common import slices

    texts = ["x" * n for n in (10, 10, 10, 500, 10, 10)] + [None, ""] * 5
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    cut = list(slices([batch, batch.slice(0, 0)], 4, 30))
    assert [c.num_rows for c in cut] == [3, 1, 4, 4, 4]
    assert pa.Table.from_batches(cut).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def test_no_setting_is_left_behind(spark):
    from newsloom.llm.common import saved

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    saved(spark.range(3).toDF("x"), "any").count()
    assert spark.conf.get(name) == before


def test_checksums_of_documents_read_together(monkeypatch):
    monkeypatch.setattr(T, "_WIDENED", 10)
    tokens = np.arange(100, dtype="<u2") * 601
    for cuts in ([0], [0, 1], [0, 3, 3, 4, 10, 10], [5, 15, 16, 60, 61, 62, 72, 100], [0, 100], [0, 0, 11, 21, 31, 31]):
        want = [crc(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert T._checksums(tokens, np.array(cuts, np.int64)) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_words_need_no_cutting(name, monkeypatch):
    path = public_tokenizers.path(name)
    plain, words = Tokenizer.from_file(path), WordEncoder(path)
    calls, simple = [], words.simple
    monkeypatch.setattr(words, "simple", lambda x: calls.append(x) or simple(x))
    texts = ["x Some plain Words", "x Größe, 12 plain! words", "opening Some"]
    got = [np.frombuffer(b, words.dtype).tolist() for b in words.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(calls) <= {"x", "opening", "Größe,", "Größe", "12", "plain!"}
