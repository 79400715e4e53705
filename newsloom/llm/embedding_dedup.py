"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with a cosine of at least ``1 - T / 2`` are within a squared distance T.
Rotated vectors are split into blocks of equal width; if every block of a pair were
further apart than its share of T, the whole would be further apart than T. So each
block is range-joined alone, on strips of its leading coordinate, under its share of
the budget; the pairs found are verified exactly, each in the first block that finds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import forest, mapped, saved, slices, tiled
from newsloom.llm.components import components

MIN_COSINE = 0.95
BLOCKS = 4
SEED = 5
#: Rotated coordinates are whole multiples of 1 / UNIT, so block distances are exact.
UNIT = 1 << 15
#: Vectors of one strip compared in one task, at most about twice that many.
STRIP_ROWS = 16_384
_GATHERED, _DENSE = 50_000, 0.02
#: Rows of a leaf in a task, and by how many coordinates leaves are cut.
LEAF_ROWS, LEAF_CUTS = 64, 2


class Space:
    """Rotation, blocks and budgets for vectors of ``size`` components."""

    def __init__(self, size: int):
        random = np.random.RandomState(SEED)
        self.turn = np.linalg.qr(random.normal(size=(size, size)))[0]
        edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
        self.blocks = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
        # rounding moves a difference by at most one unit in each coordinate
        total = (np.sqrt(2 - 2 * MIN_COSINE) + np.sqrt(size) / UNIT + 1e-9) ** 2
        self.budgets = [int(total * (b.stop - b.start) / size * UNIT**2) + 1 for b in self.blocks]
        self.widths = [int(np.sqrt(b)) + 1 for b in self.budgets]

    def rotated(self, unit: np.ndarray) -> np.ndarray:
        return np.rint(unit @ self.turn * UNIT)


_SPACES: dict[int, Space] = {}


def space(size: int) -> Space:
    if size not in _SPACES:
        _SPACES[size] = Space(size)
    return _SPACES[size]


def _classes_of(dtype: str):
    """Digest and bytes of each valid vector; nulls for the others."""
    def run(batches):
        for part in slices(batches):
            digests, raw = [], []
            for values in part.column(1).to_pylist():
                vector = None
                if values and None not in values:
                    vector = np.array(values, dtype) + 0  # no negative zero
                    if not np.isfinite(vector).all() or not vector.any():
                        vector = None
                data = None if vector is None else vector.tobytes()
                raw.append(data)
                digests.append(None if data is None else hashlib.sha256(data).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "cls", "vec"]
            )
    return run


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _strips(dtype: str, whole: bool):
    """For each block, a row in its own strip and, as a guest, in the strip below."""
    width = np.dtype(dtype).itemsize
    def run(batches):
        for part in slices(batches, 2048):
            table = part.to_pydict()
            sizes = np.array([len(v) // width for v in table["vec"]])
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                here = space(size)
                turned = here.rotated(_units([table["vec"][k] for k in at], dtype))
                for number, (block, wide) in enumerate(zip(here.blocks, here.widths)):
                    strip = np.floor(turned[:, block.start] / wide).astype(np.int64)
                    for guest in (False, True):
                        columns = {
                            "size": pa.array(np.full(len(at), size, np.int32)), "block": pa.array(np.full(len(at), number, np.int32)),
                            "strip": pa.array(strip - guest),
                        }
                        if whole:
                            taken = pa.array(at)
                            columns |= {n: part.column(part.schema.get_field_index(n)).take(taken) for n in ("cls", "rep", "n", "vec")}
                            columns["guest"] = pa.array(np.full(len(at), guest))
                        yield pa.RecordBatch.from_pydict(columns)
    return run


class Leaves:
    """Rows of a group ordered into leaves of about LEAF_ROWS: cut evenly by one
    coordinate of the block after another, with the bounds of each leaf."""

    def __init__(self, block: np.ndarray, rows: np.ndarray):
        cuts = min(LEAF_CUTS, block.shape[1])
        parts = max(1, round((len(rows) / LEAF_ROWS) ** (1 / cuts)))
        leaves = [rows]
        for k in range(cuts):
            # the leading coordinate comes last: a strip is narrow in it already
            by = block[:, (k + 1) % block.shape[1]]
            leaves = [x for leaf in leaves for x in np.array_split(leaf[np.argsort(by[leaf], kind="stable")], parts) if len(x)]
        self.rows = np.concatenate(leaves) if leaves else rows
        self.sizes = np.array([len(x) for x in leaves], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low = np.minimum.reduceat(block[self.rows], self.starts) if leaves else block[:0]
        self.high = np.maximum.reduceat(block[self.rows], self.starts) if leaves else block[:0]

    def near(self, low: np.ndarray, high: np.ndarray, budget: int) -> np.ndarray:
        """Which leaves may hold a row within the budget of a row within the bounds."""
        gap = np.maximum(np.maximum(low - self.high, self.low - high), 0)
        return (gap * gap).sum(1) <= budget


def _sides(guest, chunk, split):
    """What of a group is compared: (left rows, right rows, whether they are the same).
    Two guests meet in their own strip, two rows of a chunk in the chunk's own tile."""
    if split:
        low = chunk == chunk.min()
        sides = [(low & ~guest, ~low), (low & guest, ~low & ~guest)]
    else:
        sides = [(~guest, ~guest), (~guest, guest)]
    for number, (a, b) in enumerate(sides):
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        if a.size and b.size:
            yield a, b, not split and number == 0


def _group_links(here: Space, number: int, unit, guest, chunk, split):
    """Index pairs of one group with a cosine of at least MIN_COSINE that no earlier
    block finds. A leaf is compared at once with all leaves whose bounds, over all
    coordinates of the block together, are within the block's budget."""
    block, budget = here.blocks[number], here.budgets[number]
    turned = here.rotated(unit)
    whole = turned[:, block]
    part = (whole / UNIT).astype(np.float32)
    square = (part * part).sum(1, dtype=np.float32)[:, None]
    one = np.ones_like(square)
    # left . right = minus the squared distance
    left, right = np.hstack([2 * part, -square, -one]), np.hstack([part, one, square])
    near = np.float32(-(budget / UNIT**2 + 1e-5 * (1 + 4 * float(square.max()))))

    def close(i, j, k):
        gap = turned[i, here.blocks[k]] - turned[j, here.blocks[k]]
        return (gap * gap).sum(1) <= here.budgets[k]

    for some, others, same in _sides(guest, chunk, split):
        these = Leaves(whole, some)
        those = these if same else Leaves(whole, others)
        across = right[those.rows]
        for leaf, (start, size) in enumerate(zip(these.starts.tolist(), these.sizes.tolist())):
            meets = those.near(these.low[leaf], these.high[leaf], budget)
            if same:
                meets[:leaf] = False
            at = np.flatnonzero(np.repeat(meets, those.sizes))
            if not at.size:
                continue
            rows, columns = these.rows[start:start + size], those.rows[at]
            found = left[rows] @ across[at].T >= near
            if np.count_nonzero(found) > _DENSE * found.size:
                # many candidates: the cosine of all of them at once, up to its rounding
                found &= unit[rows] @ unit[columns].T >= MIN_COSINE - 1e-9
            hits = np.flatnonzero(found)
            i, j = hits // len(at), hits % len(at)
            if same:
                later = start + i < at[j]
                i, j = i[later], j[later]
            i, j = rows[i], columns[j]
            for k in range(0, len(i), _GATHERED):
                a, b = i[k:k + _GATHERED], j[k:k + _GATHERED]
                keep = close(a, b, number)
                for earlier in range(number):
                    a, b = a[keep], b[keep]
                    keep = ~close(a, b, earlier)
                a, b = a[keep], b[keep]
                linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= MIN_COSINE
                yield a[linked], b[linked]


def _verified(dtype: str):
    """Groups in order in; out: links counted per class, and spanning links."""
    names = ["cls", "n", "a", "b"]

    def ended(rows: pa.Table):
        first = {n: rows.column(n)[0].as_py() for n in ("size", "block", "lo", "hi")}
        unit = _units(rows.column("vec").to_pylist(), dtype)
        guest, chunk, many = (rows.column(n).to_numpy() for n in ("guest", "chunk", "n"))
        rep = rows.column("rep").to_pylist()
        known = np.array([r is not None for r in rep])
        rep = np.array([r or 0 for r in rep], np.int64)
        counts, spans = np.zeros(len(unit), np.int64), []
        for a, b in _group_links(space(first["size"]), first["block"], unit, guest, chunk, first["lo"] != first["hi"]):
            counts += np.bincount(a, many[b], len(unit)).astype(np.int64) + np.bincount(b, many[a], len(unit)).astype(np.int64)
            both = known[a] & known[b]
            if both.any():
                spans.append(forest(rep[a[both]], rep[b[both]]))
        at = np.flatnonzero(counts)
        if at.size:
            nothing = pa.nulls(len(at), pa.int64())
            classes = rows.column("cls").combine_chunks().take(pa.array(at))
            yield pa.RecordBatch.from_arrays([classes, pa.array(counts[at]), nothing, nothing], names)
        if spans:
            a, b = forest(np.concatenate([s[0] for s in spans]), np.concatenate([s[1] for s in spans]))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names
            )

    def run(batches):
        held, key = [], None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("size", "block", "strip", "lo", "hi")]
            if not batch.num_rows:
                continue
            changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows]):
                own = tuple(int(c[a]) for c in columns)
                if own != key and held:
                    yield from ended(pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from ended(pa.Table.from_batches(held))
    return run


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class, compared once and counted by its size; links of a
    class are counted where they are found, so no pair leaves its task. Strips of
    many vectors are split into tiles, each with its own task.

    Vectors that are null, empty, zero, or hold null or non-finite components, link
    with nothing; vectors of different sizes don't link. A row with a null id counts
    as a link of others, but joins no component: its component_id is null, kept
    false. Rows that share an id are one node of the components. Other columns are
    not read. An empty table gives an empty result.
    """
    kind = vectors.schema[vector_column].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    source = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).cast("array<float>" if kind == "float" else "array<double>").alias("embedding"),
    )
    rows = mapped(source, _classes_of(dtype), "vec_id long, cls binary, vec binary")
    classes = saved(
        rows.filter("cls IS NOT NULL").groupBy("cls").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")
        ),
        "vector-classes",
    )
    keys = ["size", "block", "strip"]
    layout = "size int, block int, strip long"
    whole = mapped(classes, _strips(dtype, True), layout + ", cls binary, rep long, n long, vec binary, guest boolean")
    alone = mapped(classes.select("vec"), _strips(dtype, False), layout)
    tiles = tiled(whole, keys, "cls", STRIP_ROWS, "hot-strips", alone)
    dealt = tiles.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "cls", "guest")
    found = saved(mapped(dealt, _verified(dtype), "cls binary, n long, a long, b long"), "vector-links")
    counts = found.filter("cls IS NOT NULL").groupBy("cls").agg(F.sum("n").alias("links"))
    # rows of one id with different vectors are one node already: both carry that id
    nodes = components(found.filter("a IS NOT NULL").select("a", "b"))
    per_class = saved(
        classes.select("cls", "rep", "n").join(counts, "cls", "left")
        .join(nodes, F.col("rep") == F.col("node"), "left")
        .select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("of")),
        "vector-components",
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("of", "vec_id"))
    return rows.select("vec_id", "cls").join(per_class, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
