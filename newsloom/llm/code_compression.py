"""Vector codes of a few parts, by Lloyd's rounds over pairs of trees.

Vectors become whole numbers and are cut into equal parts; each part has a codebook of
a few entries. Tasks sort the parts of a block of vectors into trees once, with the box,
the number and the sum of the rows below each node. A round walks these trees against a
tree over the codebook's entries: distance bounds between a node and a group of entries,
then between a node and single entries, strike out entries that no row below the node
can choose. A node left with one entry is assigned whole, by its cached sum; rows of
leaves that stay uncertain are compared one by one. All bounds and distances are whole
numbers, so ties and sums are exact, however the rows are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a leaf, and vectors of one block with its own trees.
LEAF_ROWS, BLOCK_ROWS = 16, 4096


def _limit(size: int) -> int:
    """Largest whole component whose squared distances, over a vector, fit 64 bits."""
    return isqrt((1 << 62) // max(size, 1)) // 2


def _whole(values, size: int) -> np.ndarray | None:
    """Whole numbers of a vector; None if it is not to be coded."""
    if values is None or len(values) != size or None in values:
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all():
        return None
    limit = _limit(size)
    # a scale that is a power of two is exact; components beyond the limit count as the limit
    return np.clip(np.floor(np.clip(x, -limit, limit) * SCALE), -limit, limit).astype(np.int64)


class PartTree:
    """Rows of one part in tree order; levels of nodes with box, count and sum."""

    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        ranges = [(0, len(rows))]
        self.levels: list[dict[str, np.ndarray]] = []
        while True:
            ends = np.array(ranges, np.int64)
            own = rows[self.order]
            self.levels.append({
                "start": ends[:, 0], "stop": ends[:, 1],
                "low": np.minimum.reduceat(own, ends[:, 0]), "high": np.maximum.reduceat(own, ends[:, 0]),
                "sum": np.add.reduceat(own, ends[:, 0]),
            })
            if max(b - a for a, b in ranges) <= LEAF_ROWS:
                break
            halves = []
            for a, b in ranges:
                part = rows[self.order[a:b]]
                widest = int(np.argmax(part.max(0) - part.min(0)))
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, widest], middle)]
                halves += [(a, a + middle), (a + middle, b)]
            ranges = halves
        self.rows = rows[self.order]


class EntryTree:
    """Entries of one codebook in groups of near ones, with the box of each group."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        groups = [np.arange(len(entries))]
        while max(map(len, groups)) > 4:
            halves = []
            for g in groups:
                own = entries[g]
                order = g[np.argsort(own[:, int(np.argmax(own.max(0) - own.min(0)))], kind="stable")]
                halves += [h for h in (order[:len(order) // 2], order[len(order) // 2:]) if len(h)]
            groups = halves
        self.groups = groups
        self.low = np.array([entries[g].min(0) for g in groups])
        self.high = np.array([entries[g].max(0) for g in groups])
        self.square = (entries * entries).sum(1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row (the first of equals) and its squared distance."""
        gaps = rows[:, None, :] - self.entries[None]
        far = (gaps * gaps).sum(2)
        best = far.argmin(1)
        return best, far[np.arange(len(rows)), best]

    def live(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which entries a row of each box may choose."""
        # boxes of nodes against boxes of groups of entries
        apart = np.maximum(0, np.maximum(self.low[None] - high[:, None], low[:, None] - self.high[None]))
        least = (apart * apart).sum(2)
        across = np.maximum(high[:, None] - self.low[None], self.high[None] - low[:, None])
        most = (across * across).sum(2).min(1)
        live = np.zeros((len(low), len(self.entries)), bool)
        for k, group in enumerate(self.groups):
            live[:, group] = (least[:, k] <= most)[:, None]
        # single entries against the entry nearest to the middle of the box, twice to spare fractions
        gaps = (low + high)[:, None] - 2 * self.entries[None]
        owner = np.where(live, (gaps * gaps).sum(2), np.iinfo(np.int64).max).argmin(1)
        # largest of |p - owner|^2 - |p - other|^2 over the box: linear in p
        lean = 2 * (self.entries[None] - self.entries[owner][:, None])
        worst = self.square[owner][:, None] - self.square[None] + np.maximum(lean * low[:, None], lean * high[:, None]).sum(2)
        other = np.arange(len(self.entries))[None]
        struck = (worst < 0) | ((worst == 0) & (other > owner[:, None]))
        struck[np.arange(len(low)), owner] = False
        return live & ~struck


def walk(tree: PartTree, entries: EntryTree) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Nodes assigned whole and rows assigned one by one: (kind, where, entry); ``where``
    is (start, stop, sum) of nodes, or places of rows in tree order."""
    open_ = np.arange(1)
    for depth, level in enumerate(tree.levels):
        live = entries.live(level["low"][open_], level["high"][open_])
        sure = live.sum(1) == 1
        at = open_[sure]
        if at.size:
            yield "nodes", np.column_stack([level["start"][at], level["stop"][at], level["sum"][at]]), live[sure].argmax(1)
        open_ = open_[~sure]
        if depth + 1 < len(tree.levels):
            # halves of a node stand side by side in the next level
            open_ = np.sort(np.concatenate([2 * open_, 2 * open_ + 1]))
    if open_.size:
        last = tree.levels[-1]
        places = np.concatenate([np.arange(a, b) for a, b in zip(last["start"][open_], last["stop"][open_])])
        for k in range(0, len(places), 1024):
            own = places[k:k + 1024]
            yield "rows", own, entries.nearest(tree.rows[own])[0]


def _blocks(size: int):
    """Blocks of vectors as one row of bytes: ids, labels and whole numbers."""
    def run(batches):
        held: list[tuple] = []

        def block():
            rows = np.array([h[2] for h in held]).reshape(len(held), size)
            ids, labels = ([h[k] for h in held] for k in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([rows.astype("<i8").tobytes()])],
                ["ids", "labels", "rows"],
            )

        for batch in batches:
            for vec_id, label, values in zip(*[c.to_pylist() for c in batch.columns]):
                row = _whole(values, size)
                if row is not None:
                    held.append((vec_id, label, row))
                if len(held) == BLOCK_ROWS:
                    yield block()
                    held = []
        if held:
            yield block()
    return run


#: Trees of the blocks this process has seen last, by the digest of their rows.
_TREES: dict[bytes, list[PartTree]] = {}


def _trees(raw: bytes, size: int) -> list[PartTree]:
    name = hashlib.md5(raw).digest()
    if name not in _TREES:
        while len(_TREES) >= 8:
            _TREES.pop(next(iter(_TREES)))
        rows = np.frombuffer(raw, "<i8").reshape(-1, size)
        _TREES[name] = [PartTree(part) for part in np.split(rows, PARTS, axis=1)]
    return _TREES[name]


def _sums(books: list[np.ndarray], size: int):
    """For each part and entry: count and sum of the rows of this partition."""
    def run(batches):
        entries = [EntryTree(b) for b in books]
        width = size // PARTS
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        totals = np.zeros((PARTS, len(books[0]), width), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for part, tree in enumerate(_trees(raw, size)):
                    for kind, where, chosen in walk(tree, entries[part]):
                        if kind == "nodes":
                            np.add.at(counts[part], chosen, where[:, 1] - where[:, 0])
                            np.add.at(totals[part], chosen, where[:, 2:])
                        else:
                            np.add.at(counts[part], chosen, 1)
                            np.add.at(totals[part], chosen, tree.rows[where])
        part, entry, place = np.indices(totals.shape).reshape(3, -1)
        yield pa.RecordBatch.from_pydict({
            "part": part.astype(np.int32), "entry": entry.astype(np.int32), "place": place.astype(np.int32),
            "n": np.repeat(counts.ravel(), width), "total": totals.ravel(),
        })
    return run


def _codes(books: list[np.ndarray], size: int):
    def run(batches):
        entries = [EntryTree(b) for b in books]
        for batch in batches:
            for ids, labels, raw in zip(*[c.to_pylist() for c in batch.columns]):
                codes = np.zeros((len(ids), PARTS), np.int64)
                error = np.zeros(len(ids), np.int64)
                for part, tree in enumerate(_trees(raw, size)):
                    chosen = np.zeros(len(ids), np.int64)
                    for kind, where, entry in walk(tree, entries[part]):
                        if kind == "nodes":
                            for a, b, e in zip(where[:, 0].tolist(), where[:, 1].tolist(), entry.tolist()):
                                chosen[a:b] = e
                        else:
                            chosen[where] = entry
                    gap = tree.rows - books[part][chosen]
                    codes[tree.order, part] = chosen
                    error[tree.order] += (gap * gap).sum(1)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )
    return run


def fit(blocks: DataFrame, books: list[np.ndarray], size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` rounds. The driver sees one sum for each component of
    each entry a round, a few thousand numbers whatever the number of vectors."""
    for _ in range(rounds):
        sums = mapped(blocks.select("rows"), _sums(books, size), "part int, entry int, place int, n long, total long")
        # sums of a partition fit 64 bits, their sum over the table may not
        found = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [b.copy() for b in books]
        for r in found.filter("n > 0").collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS,
) -> DataFrame:
    """One row per coded vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped; so are
    those whose size differs from that of the vector with the smallest id, and all if
    that size is not a positive multiple of the number of parts. Components beyond what
    squared distances in 64 bits allow (32,768 and more for 64 components) count as that
    bound. Rows with null ids come after all others where the first codebooks are
    chosen, rows of one id by their vectors; rows that repeat are coded each. With
    fewer vectors than entries, the codebooks have as many entries as vectors. Other
    columns are not read. A table without vectors to code gives an empty result.
    """
    spark = vectors.sparkSession
    source = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = source.filter(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    least = kept.orderBy(*order).limit(1).collect()
    size = len(least[0]["v"]) if least else 0
    if not size or size % PARTS:
        return spark.createDataFrame([], schema)
    first = kept.filter(F.size("v") == size).orderBy(*order).limit(ENTRIES).collect()
    books = [np.array(b) for b in np.split(np.array([_whole(r["v"], size) for r in first]), PARTS, axis=1)]
    blocks = saved(mapped(kept, _blocks(size), "ids array<long>, labels array<string>, rows binary"), "vector-blocks")
    books = fit(blocks, books, size, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = saved(mapped(blocks, _codes(books, size), "vec_id long, label string, code string, error long"), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
