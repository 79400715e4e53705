"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import forest, mapped, saved, slices, tiled
from newsloom.llm.components import components

SEED = 42
MAX_BITS = 4
BYTES = 8
#: Fingerprints that differ in MAX_BITS bits share at least so many positional bytes.
MIN_SHARED = BYTES - MAX_BITS
#: Distinct fingerprints of one posting list compared in one task, at most twice that many.
LIST_ROWS = 2048
_HASHES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 20


def _posting_positions() -> list[tuple[int, int, int]]:
    """Byte positions of the posting lists.

    Any four of the eight positions hold one of these triples: with positions in
    three parts, four of them put three in one part, or two in one part and one
    in the part after it (otherwise two parts would hold two each, next to each
    other, which is such a triple as well).
    """
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = []
    for k, part in enumerate(parts):
        found += combinations(part, 3)
        found += [(*pair, other) for pair in combinations(part, 2) for other in parts[(k + 1) % 3]]
    return [tuple(sorted(x)) for x in found]


POSITIONS = _posting_positions()
#: By the mask of shared bytes: the first posting list that holds both.
_FIRST = np.array(
    [next((k for k, t in enumerate(POSITIONS) if all(m >> p & 1 for p in t)), -1) for m in range(256)]
)


def simhash(text: bytes, size: int = 4) -> int:
    """64-bit SimHash of the word shingles of UTF-8 ``text``: words are runs without
    ASCII white space, A-Z lower-cased; a bit is 1 if over half the shingles' XXH64
    (seed 42) have it. No word: 0. Fewer words than ``size``: one shingle of all."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths + 1) - lengths - 1
        starts, ends = begin[: 1 - size].tolist(), (begin + lengths)[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), _HASHES_AT_ONCE):
        cut = slice(k, k + _HASHES_AT_ONCE)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[cut], ends[cut])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for part in slices(batches):
        texts = part.column(1).to_pylist()
        prints = np.array([simhash(t or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "bits"])


def _pairs(gid, chunk, lo, hi, bits, pos):
    """Index pairs of one run of sorted postings that pass the tally and the check."""
    left, right = [], []
    active = np.arange(len(gid))
    for step in range(1, len(gid)):
        active = active[active + step < len(gid)]
        active = active[gid[active] == gid[active + step]]
        if not active.size:
            break
        other = active + step
        differ = bits[active] ^ bits[other]
        shared = differ.view(np.uint8).reshape(-1, BYTES) == 0
        keep = shared.sum(axis=1) >= MIN_SHARED
        keep &= (lo[active] == hi[active]) | (chunk[active] != chunk[other])
        at = np.flatnonzero(keep)
        mask = np.packbits(shared[at], axis=1, bitorder="little")[:, 0]
        at = at[(_FIRST[mask] == pos[active[at]]) & (np.bitwise_count(differ[at]) <= MAX_BITS)]
        left.append(active[at])
        right.append(other[at])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(batches):
    """Postings sorted by (key, lo, hi) in, spanning links of each run out."""
    rest, found, count = None, [], 0

    def flush():
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def ended(rows):
        key, chunk, lo, hi, rep = rows[0], rows[3], rows[4], rows[5], rows[1]
        new = (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
        gid = np.concatenate([[0], np.cumsum(new)])
        i, j = _pairs(gid, chunk, lo, hi, rows[2].view(np.uint64), key >> 24)
        return (rep[i], rep[j])

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows)]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[4] != rows[4][-1]) | (rows[5] != rows[5][-1]))
        cut = last[-1] + 1 if last.size else 0
        rest = [x[cut:] for x in rows]
        if cut:
            found.append(ended([x[:cut] for x in rows]))
            count += len(found[-1][0])
        if count > _PAIRS_AT_ONCE:
            yield flush()
            found, count = [], 0
    if rest is not None:
        found.append(ended(rest))
    if found:
        yield flush()


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints (rep, bits: long)
    that differ in at most MAX_BITS bits; what they join is complete, and links
    that add nothing within a task are left out."""
    byte = [F.shiftrightunsigned("bits", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = F.array(*[
        F.lit(k << 24).cast("long") + byte[p] * 65536 + byte[q] * 256 + byte[r] for k, (p, q, r) in enumerate(POSITIONS)
    ])
    postings = classes.select(F.explode(keys).alias("key"), "rep", "bits")
    tiles = tiled(postings, ["key"], "bits", LIST_ROWS, "hot-postings")
    dealt = tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "bits")
    return mapped(dealt, _links, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Distinct fingerprints are indexed by positional bytes; lists of three bytes
    hold every pair that shares the guaranteed minimum of four, the shared bytes
    of each pair met in a list are tallied, pairs below the minimum go, the rest
    is verified by its differing bits. component_id is the smallest doc_id
    reachable through links.

    A null text counts as empty (fingerprint zero). Rows with a null id are
    fingerprinted, link with nothing and have a null component_id. Rows that share
    an id are one node. Only the two named columns are read; ties and repeated
    rows share a fingerprint class. An empty table gives an empty result.
    """
    pairs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    prints = saved(mapped(pairs, _fingerprints, "doc_id long, bits long"), "simhash")
    known = prints.filter("doc_id IS NOT NULL")
    classes = saved(known.groupBy("bits").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    ends = fingerprint_links(classes)
    # rows of one id with different texts are one node
    same = known.distinct().join(classes, "bits").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = known.distinct().groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("a"))
    found = components(ends.union(same.join(twice, "a", "left_semi")))
    of_class = saved(
        classes.join(found, classes["rep"] == found["node"], "left")
        .select("bits", F.coalesce("component", "rep").alias("component_id")),
        "simhash-components",
    )
    return prints.join(of_class, "bits", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group the smallest doc_id
    stays, once. Rows with a null doc_id stay as they are. Of several rows with one
    doc_id the one with the least hash stays; they are reduced in map tasks first, so
    an id may repeat as often as it likes. An empty table stays empty.

    Texts of ids that are neither gone nor repeated are moved by no aggregation."""
    verdicts = near_duplicates(docs).filter("doc_id IS NOT NULL")
    marks = saved(
        verdicts.groupBy("doc_id").agg(
            F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count(F.lit(1)).alias("n")
        ).filter("gone OR n > 1"),
        "simhash-marks",
    )
    clear = docs.join(marks.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.join(marks.filter("NOT gone").select("doc_id"), "doc_id", "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    key = F.struct(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = repeated.groupBy("doc_id").agg(F.min_by(row, key).alias("__row")).select("__row.*")
    return clear.unionByName(first)
