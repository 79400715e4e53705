"""Document fingerprints: Order MinHash.

Of all k-mers of a text, numbered by occurrence, each of HASHES hash functions
selects the TUPLE smallest; in the order they have in the text, they are hashed to
one entry of the signature. Texts share an entry when they share those k-mers in
that order, so the signature follows the edit distance, not only the set of k-mers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import Ordered, mapped, slices

#: A k-mer is K bytes of UTF-8.
K, HASHES, TUPLE = 8, 32, 2
_COLUMNS = 1 << 14
_random = np.random.RandomState(23)
_ODD = _random.randint(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _stir(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def _numbered(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-mer with its occurrence number, and its place in the text."""
    if len(text) < K:
        text = text.ljust(K, b"\0")
    n = len(text) - K + 1
    codes = _stir(np.ndarray((n,), "<u8", text, strides=(1,)).astype(np.uint64))
    bits = np.uint64(n.bit_length())
    keys = (codes >> bits << bits) | np.arange(n, dtype=np.uint64)
    keys.sort()
    value = keys >> bits
    new = np.flatnonzero(value[1:] != value[:-1]) + 1
    first = np.concatenate([[0], new])
    occurrence = np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))
    return _stir((value << bits) + occurrence.astype(np.uint64) * _C), (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def signature(text: bytes) -> np.ndarray:
    """HASHES entries (uint32) of a UTF-8 text; all zero for an empty one."""
    if not text:
        return np.zeros(HASHES, np.uint32)
    base, place = _numbered(text)
    n, want = len(base), min(TUPLE, len(base))
    bound = 1.0 if n < 64 else 12 / n
    while True:
        # below this bound each function is expected to find twelve values
        limit = np.uint64(min(int(bound * 2**64), 2**64 - 1))
        which, where, values = [], [], []
        for at in range(0, n, _COLUMNS):
            hashed = base[None, at:at + _COLUMNS] * _ODD[:, None]
            row, column = np.nonzero(hashed <= limit)
            which.append(row)
            where.append(column + at)
            values.append(hashed[row, column])
        row, column, value = np.concatenate(which), np.concatenate(where), np.concatenate(values)
        if np.bincount(row, minlength=HASHES).min() >= want or bound >= 1:
            break
        bound *= 8
    order = np.lexsort((value, row))
    row, column = row[order], column[order]
    begin = np.searchsorted(row, np.arange(HASHES))
    chosen = column[begin[:, None] + np.arange(want)]
    chosen = np.take_along_axis(chosen, np.argsort(place[chosen], axis=1), axis=1)
    entry = np.arange(1, HASHES + 1, dtype=np.uint64)
    for k in range(want):
        entry = _stir(entry * _C + base[chosen[:, k]])
    return (entry >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _hex(sign: np.ndarray) -> str:
    return sign.astype(">u4").tobytes().hex()


def _row(doc, after):
    doc_id, text, sign = doc
    changed = edited(text, after[1]).encode("utf-8", "surrogatepass")
    other = signature(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed).hexdigest(), _hex(sign), _hex(other),
        likeness(sign, other), likeness(sign, after[2]),
    )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(batches):
    """Own rows of one range in order, then the first rows of the next range."""
    before, ended = None, False
    for part in slices(batches):
        rows = []
        for doc_id, text, guest in zip(*[part.column(k).to_pylist() for k in range(3)]):
            if ended:
                break
            text = text or ""
            doc = (doc_id, text, signature(text.encode("utf-8", "surrogatepass")))
            if before is not None:
                rows.append(_row(before, doc))
            before, ended = doc, bool(guest)
        columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The next document is the one after it by ascending id (null first), then text;
    after the last comes the first, so a single document follows itself. Texts move
    once, to ranges of ids; the first row of each range also goes to the range
    before, so no order over the whole table is needed. A null text counts as
    empty; repeated rows follow each other; other columns are not read. An empty
    table gives an empty result.
    """
    ranges = Ordered(docs, id_column)
    source = ranges.part_of(docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).alias("text")))
    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("guest"))
    back = F.pmod(F.col("part") + F.lit(ranges.parts - 1), F.lit(ranges.parts)).cast("int")
    guest = F.struct(back.alias("to"), F.lit(1).alias("guest"))
    sent = source.select(
        F.col(id_column).alias("doc_id"), "text",
        F.explode(F.when(F.col("starts"), F.array(own, guest)).otherwise(F.array(own))).alias("way"),
    ).select("doc_id", "text", "way.guest", "way.to")
    dealt = sent.repartitionById(ranges.parts, F.col("to")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(dealt.select("doc_id", "text", "guest"), _compared, schema)
