"""Nearest neighbours by inner product, in a hierarchical k-means tree.

Vectors get one more component that brings all to the same length, and queries a zero
there: then the nearest by distance are those of the largest inner product. A tree of
k-means centres, fitted on a bounded sample, deals every vector to a leaf. A query
visits leaves best bin first, from a priority queue of nodes by their centre's distance.
How many it visits is calibrated: the true neighbours of some queries are found by
comparing them with all vectors, and visits widen until the leaves visited hold the
wanted share of these. A visited leaf is searched whole, in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved, slices

NEAREST, QUERY_STEP = 20, 20
#: Vectors the tree is fitted on; the centres of a node; vectors meant for a leaf.
SAMPLE, BRANCHES, LEAF_ROWS = 20_000, 8, 256
#: Queries used to calibrate, and the share of their neighbours that must be found.
CALIBRATED, RECALL = 400, 0.95
#: Bytes of indexed vectors one task holds (about), and queries multiplied at once.
TASK_BYTES, QUERY_ROWS = 16 << 20, 512


class Tree:
    """Centres of all nodes; children of a node stand together; a leaf has none."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, seed: int = 11):
        random = np.random.RandomState(seed)
        centres, children, waiting = [sample.mean(0)], [None], [(0, np.arange(len(sample)))]
        for node, rows in waiting:
            if len(rows) <= max(leaf_rows, 2 * BRANCHES):
                continue
            found = _kmeans(sample[rows], random)
            parts = [rows[found[1] == k] for k in range(len(found[0]))]
            if max(map(len, parts)) == len(rows):
                continue  # equal vectors
            children[node] = (len(centres), len(centres) + len(parts))
            for centre, part in zip(found[0], parts):
                waiting.append((len(centres), part))
                centres.append(centre)
                children.append(None)
        self.centres, self.children = np.array(centres), children

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: from the root to the nearest centre each time."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = [n for n in np.unique(node).tolist() if self.children[n]]
            if not inner:
                return node
            for n in inner:
                a, b = self.children[n]
                own = np.flatnonzero(node == n)
                node[own] = a + _gaps(x[own], self.centres[a:b]).argmin(1)

    def visits(self, queries: np.ndarray, most: int | None = None, rows: dict[int, int] | None = None, least: int = 0) -> list[list[int]]:
        """Leaves of each query, best bin first: ``most`` of them, and more until they
        hold ``least`` vectors (``rows`` of each leaf)."""
        out = []
        for row in _gaps(queries, self.centres).tolist():
            queue, found, held = [(row[0], 0)], [], 0
            while queue and (most is None or len(found) < most or held < least):
                _, node = heapq.heappop(queue)
                span = self.children[node]
                if span is None:
                    found.append(node)
                    held += rows.get(node, 0) if rows else 0
                else:
                    for child in range(*span):
                        heapq.heappush(queue, (row[child], child))
            out.append(found)
        return out


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the square of x."""
    return (centres * centres).sum(1)[None] - 2 * (x @ centres.T)


def _kmeans(x: np.ndarray, random, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    centres = x[random.choice(len(x), BRANCHES, False)]
    for _ in range(rounds):
        near = _gaps(x, centres).argmin(1)
        counts = np.bincount(near, minlength=BRANCHES)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres, _gaps(x, centres).argmin(1)


def _even(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all as long as the longest."""
    rest = np.sqrt(np.maximum(longest - (x * x).sum(1), 0.0))
    return np.column_stack([x, rest])


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _valid(batches):
    """Vectors as bytes of doubles, with their size and squared length."""
    for part in slices(batches, 1024):
        ids, raw, sizes, lengths = [], [], [], []
        for vec_id, values in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if vec_id is None or not values or None in values:
                continue
            x = np.array(values, "<f8")
            square = float(x @ x)
            if not np.isfinite(x).all() or not x.any():
                continue
            ids.append(vec_id)
            raw.append(x.tobytes())
            sizes.append(len(x))
            lengths.append(square)
        yield pa.RecordBatch.from_pydict({
            "vec_id": pa.array(ids, pa.int64()), "vec": pa.array(raw, pa.binary()), "size": pa.array(sizes, pa.int32()),
            "length": pa.array(lengths, pa.float64()),
        })


def _scores(query: np.ndarray, ids: np.ndarray, x: np.ndarray, own: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``most`` candidates; each score is the sum over one row alone, so equal
    vectors score equally wherever they lie."""
    score = (x * query).sum(1)
    keep = np.flatnonzero(ids != own)
    order = keep[np.lexsort((ids[keep], -score[keep]))[:most]]
    return ids[order], score[order]


class _Best:
    """Best candidates of a query so far."""

    def __init__(self, most: int):
        self.most, self.ids, self.scores = most, np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.most]
        self.ids, self.scores = ids[order], scores[order]


def _compared(best: dict, keys: list, own: list[int], queries: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> None:
    """Compare queries with one block of vectors; ``best`` is by key."""
    rough = queries @ x.T
    # what a product of matrices may be off from a row's own sum
    slack = 1e-12 * np.sqrt((queries * queries).sum(1)) * float(np.sqrt((x * x).sum(1).max()))
    want = min(most + 1, x.shape[0])
    floor = -np.partition(-rough, want - 1, axis=1)[:, want - 1] - 2 * slack
    for k, key in enumerate(keys):
        least = floor[k]
        if len(best[key].ids) == most:
            least = max(least, best[key].scores[-1] - 2 * slack[k])
        near = np.flatnonzero(rough[k] >= least)
        if near.size:
            best[key].add(*_scores(queries[k], ids[near], x[near], own[k], most))


def _exact(wanted: list[tuple[int, bytes]], most: int):
    """The best of one partition for each of a bounded set of queries."""
    def run(batches):
        queries, own = _matrix([v for _, v in wanted]), [i for i, _ in wanted]
        best = {k: _Best(most) for k in range(len(wanted))}
        for part in slices(batches, 4096):
            if part.num_rows:
                x = _matrix(part.column(1).to_pylist())
                _compared(best, list(best), own, queries, part.column(0).to_numpy(), x, most)
        rows = [(own[k], int(i), float(s)) for k, b in best.items() for i, s in zip(b.ids, b.scores)]
        query, ids, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"]
        )
    return run


def _indexed(tree: Tree, longest: float):
    def run(batches):
        for part in slices(batches, 4096):
            if part.num_rows:
                x = _matrix(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(tree.leaves(_even(x, longest)), pa.int64())], ["vec_id", "vec", "leaf"]
                )
    return run


def _asking(tree: Tree, visits: int, most: int, counts: dict[int, int], blocks: dict[int, int], parts: int):
    """A row for each task that holds a block of a visited leaf, with those leaves."""
    def run(batches):
        for part in slices(batches, 1024):
            if not part.num_rows:
                continue
            x = _matrix(part.column(1).to_pylist())
            rows = []
            for vec_id, vec, leaves in zip(
                part.column(0).to_pylist(), part.column(1).to_pylist(), tree.visits(_even(x, 0.0), visits, counts, most + 1)
            ):
                tasks: dict[int, list[int]] = {}
                for leaf in leaves:
                    for task in {_task(leaf, b, parts) for b in range(blocks.get(leaf, 0))}:
                        tasks.setdefault(task, []).append(leaf)
                rows += [(task, own, vec_id, vec) for task, own in tasks.items()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()])],
                ["task", "leaves", "vec_id", "vec"],
            )
    return run


def _task(leaf: int, block: int, parts: int) -> int:
    return (leaf * 7919 + block) % parts


def _searched(most: int):
    """One task: its blocks of vectors first, then queries a batch at a time."""
    def answers(best: dict[int, _Best]) -> pa.RecordBatch:
        rows = [(key, int(i), float(s)) for key, b in best.items() for i, s in zip(b.ids, b.scores)]
        query, ids, scores = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"]
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in slices(batches, QUERY_ROWS):
            kinds = part.column(1).to_numpy()
            stop = int(np.searchsorted(kinds, 1))
            if stop:
                ids, raw = part.column(2).to_numpy()[:stop], part.column(3).to_pylist()[:stop]
                leaf = np.array([own[0] for own in part.column(4).to_pylist()[:stop]])
                x = _matrix(raw)
                for one in np.unique(leaf).tolist():
                    held.setdefault(one, []).append((ids[leaf == one], x[leaf == one]))
            if stop == part.num_rows:
                continue
            for one, pieces in held.items():
                if len(pieces) > 1:
                    held[one] = [(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))]
            own, leaves = part.column(2).to_pylist()[stop:], part.column(4).to_pylist()[stop:]
            queries = _matrix(part.column(3).to_pylist()[stop:])
            asked: dict[int, list[int]] = {}
            for k, wanted in enumerate(leaves):
                for one in wanted:
                    asked.setdefault(one, []).append(k)
            best = {k: _Best(most) for k in range(len(own))}
            for one, at in asked.items():
                for ids, x in held.get(one, ()):
                    _compared(best, at, [own[k] for k in at], queries[at], ids, x, most)
            # rows of one query id (repeated ids) answer together
            yield answers_by_id(best, own)

    def answers_by_id(best, own):
        merged: dict[int, _Best] = {}
        for k, b in best.items():
            merged.setdefault(own[k], _Best(most)).add(b.ids, b.scores)
        return answers(merged)

    return run


def _cut(found: DataFrame, most: int) -> DataFrame:
    """The nearest of each query: a group holds at most ``most`` rows from each task."""
    rows = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id")))
    ranked = rows.groupBy("query_id").agg(F.slice(order, 1, most).alias("near"))
    listed = ranked.select("query_id", F.posexplode("near").alias("place", "one"))
    return listed.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"),
        (F.lit(0.0) - F.col("one.less")).alias("score"),
    )


def _calibrated(tree: Tree, index: DataFrame, sample: list[tuple[int, bytes]], most: int, wanted: float) -> int:
    """The least number of visits that finds the wanted share of the true neighbours."""
    leaves = len([c for c in tree.children if c is None])
    if not sample or leaves == 1:
        return leaves
    truth = _cut(mapped(index.select("vec_id", "vec"), _exact(sample, most), "query_id long, vec_id long, score double"), most)
    homes = truth.join(index.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").collect()  # CALIBRATED * most rows
    ranks = {q: {leaf: k for k, leaf in enumerate(order)} for (q, _), order in zip(
        sample, tree.visits(_even(_matrix([v for _, v in sample]), 0.0))
    )}
    needed = np.sort([ranks[r["query_id"]][r["leaf"]] + 1 for r in homes])
    visits = 1
    while needed.size and np.searchsorted(needed, visits, "right") < wanted * needed.size:
        visits += 1
    return visits


def _search(valid: DataFrame, size: int, n: int, longest: float, most: int, step: int, recall: float, leaf_rows: int, task_bytes: int):
    """Nearest neighbours among the valid vectors of one size."""
    spark = valid.sparkSession
    drawn = valid.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("vec").collect()
    sample = _even(_matrix([bytes(r["vec"]) for r in drawn]), longest)
    tree = Tree(sample, leaf_rows * len(sample) / n)
    index = saved(mapped(valid.select("vec_id", "vec"), _indexed(tree, longest), "vec_id long, vec binary, leaf long"), "leaves")
    queries = valid.filter(F.pmod("vec_id", F.lit(step)) == 0).select("vec_id", "vec")
    probe = queries.dropDuplicates(["vec_id"]).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(CALIBRATED).collect()
    visits = _calibrated(tree, index, [(r["vec_id"], bytes(r["vec"])) for r in probe], most, recall)

    # a leaf of many vectors is cut into blocks, which lie in different tasks
    block_rows = max(1, task_bytes // (16 * size))
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a few thousand leaves at most
    blocks = {leaf: -(-c // block_rows) for leaf, c in counts.items()}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * size * 8 // task_bytes))
    cuts = spark.createDataFrame(list(blocks.items()), "leaf long, blocks long")
    block = F.pmod(F.xxhash64("vec_id", "vec"), "blocks")
    task = F.pmod(F.col("leaf") * 7919 + block, F.lit(parts)).cast("int")
    rows = index.join(F.broadcast(cuts), "leaf").select(  # one row a leaf, bounded by the sample
        task.alias("task"), F.lit(0).alias("kind"), "vec_id", "vec", F.array("leaf").alias("leaves")
    )
    asking = mapped(queries, _asking(tree, visits, most, counts, blocks, parts), "task int, leaves array<long>, vec_id long, vec binary")
    both = rows.union(asking.select("task", F.lit(1).alias("kind"), "vec_id", "vec", "leaves"))
    dealt = both.repartitionById(parts, F.col("task")).sortWithinPartitions("kind")
    return mapped(dealt, _searched(most), "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = NEAREST, step: int = QUERY_STEP,
    recall: float = RECALL, leaf_rows: int = LEAF_ROWS, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id ``step`` divides, the
    ``most`` others of largest inner product found, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without an id, take no part. Vectors meet only those of their own size. Rows that
    share an id are one candidate (its best score) and one query (the best of its
    vectors). Other columns are not read. No vectors, or no queries, give an empty result.
    """
    source = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding")
    )
    valid = saved(mapped(source, _valid, "vec_id long, vec binary, size int, length double"), "vectors")
    sizes = valid.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"), F.count_if(F.pmod("vec_id", F.lit(step)) == 0).alias("asking"))
    found = None
    for r in sizes.filter("asking > 0").orderBy("size").collect():  # the sizes a table mixes are few
        own = _search(valid.filter(F.col("size") == r["size"]), r["size"], r["n"], r["longest"], most, step, recall, leaf_rows, task_bytes)
        found = own if found is None else found.union(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _cut(found, most)
