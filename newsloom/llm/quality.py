"""Quality scores: random Fourier features of document statistics, ridge
regression by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved, slices

#: Random features, kernel width in standard deviations, ridge, folds of the calibration.
FEATURES, WIDTH, RIDGE, FOLDS, SEED = 256, 3.0, 1.0, 3, 11
THRESHOLD = 0.3
#: Partial sums of each fold are merged in so many tasks before the driver adds them.
MERGES = 4
#: Scores are counted in bins of this width before the calibration.
BIN = 5e-4
_KINDS = 11


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, np.int64)
    for k, span in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12), (10, 13))):
        kind[list(span)] = k
    kind[[ord(c) for c in ".,;:"]] = 5
    kind[[ord(c) for c in "!?"]] = 6
    kind[[ord(c) for c in "'\"-()"]] = 7
    kind[[ord(c) for c in "|<>{}[]=\\/_"]] = 8
    kind[128:] = 10
    return kind


_KIND = _kinds()


def statistics(text: bytes) -> list[float]:
    """Numbers that describe the form of a UTF-8 text; all zero for an empty one."""
    counts, size = np.zeros(_KINDS, np.int64), len(text)
    for at in range(0, size, 1 << 20):
        counts += np.bincount(_KIND[np.frombuffer(text[at:at + (1 << 20)], np.uint8)], minlength=_KINDS)
    words, lines = text.split(), text.split(b"\n")
    letters = counts[0] + counts[1] + counts[10]
    distinct = len(set(words))
    n = max(1, len(words))
    return [
        np.log1p(size), np.log1p(len(words)), (size - counts[3] - counts[4]) / n, distinct / n,
        np.log1p(distinct) / np.log1p(n), len(set(lines)) / len(lines), np.log1p(size / len(lines)),
        counts[1] / max(1, letters), *(counts[2:] / max(1, size)), len(set(text.lower().split())) / n,
    ]


WIDTH_OF_STATISTICS = len(statistics(b""))


def _described(batches):
    for part in slices(batches):
        values = [statistics(t or b"") for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "stats"]
        )


class Kernel:
    """Random Fourier features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        random = np.random.RandomState(SEED)
        self.mean, self.scale = mean, scale
        self.turns = random.normal(size=(len(mean), FEATURES)) / WIDTH
        self.shift = random.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.turns + self.shift)
        return np.column_stack([waves, np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(kernel: Kernel):
    """Per partition and fold: sums of z z' and z y."""
    def run(batches):
        size = FEATURES + 1
        left, right = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for part in slices(batches, 2048):
            z, y = kernel(_matrix(part.column(0))), part.column(1).to_numpy().astype(float)
            fold = part.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                left[k] += own.T @ own
                right[k] += own.T @ y[fold == k]
        blobs = [np.column_stack([left[k], right[k]]).tobytes() for k in range(FOLDS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array(blobs, pa.binary())], ["fold", "sums"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"fold": table.column("fold")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by score; knots of a rising curve."""
    blocks: list[list[float]] = []
    for s, g, k in zip(score, good, n):
        blocks.append([s, s, g, k])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, g2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + g2, blocks[-1][3] + k2]
    x = [v for b in blocks for v in (b[0], b[1])]
    # one case of either class is added to each pool, so no pool is certain
    y = [(b[2] + 0.5) / (b[3] + 1) for b in blocks for _ in range(2)]
    return np.array(x), np.maximum.accumulate(np.array(y))


def _calibrated(kernel, weights, knots):
    def run(batches):
        for part in slices(batches, 2048):
            raw = kernel(_matrix(part.column(1))) @ weights
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.interp(raw, *knots))], ["doc_id", "score"])
    return run


def _raw_scores(kernel, by_fold):
    def run(batches):
        for part in slices(batches, 2048):
            raw = (kernel(_matrix(part.column(0))) * by_fold[part.column(2).to_numpy()]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw / BIN).astype(np.int64)), part.column(1)], ["bin", "label"])
    return run


def score(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The statistics of each text are computed once and kept; all labels whose
    crc32(id as text) mod 5 is not 0 are learned from. The normal equations are
    summed per partition and fold, merged in tasks and solved on the driver (a
    matrix of FEATURES squared). The calibration uses scores of models that have
    not seen the row's fold.

    A null text counts as empty. A null id is never held out and never learned
    from; labels that are null or not 0/1 are ignored; repeated rows count as often
    as they come. Without usable labels every score is 0.5. Other columns are not
    read. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    stats = saved(mapped(source, _described, "doc_id long, stats array<double>"), "quality-statistics")
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)), F.lit(1))
    marked = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label"))
    known = stats.join(marked.filter(F.col("label").isin(0, 1) & (rest != 0)), "doc_id").select(
        "stats", "label", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    )
    known = saved(known, "quality-training")
    moments = known.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")
    ).orderBy("k").collect()
    held_out = (rest == 0).alias("held_out")
    if not moments:
        flat = stats.select("doc_id", held_out, F.lit(0.5).alias("score"))
        return flat.withColumn("predicted", F.lit(1))
    kernel = Kernel(np.array([r["mean"] for r in moments]), np.array([max(r["scale"], 1e-9) for r in moments]))
    parts = mapped(known, _normal_equations(kernel), "fold int, sums binary")
    merged = parts.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    merged = merged.groupBy("fold", "merge").applyInArrow(_added, "fold int, sums binary")
    sums = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
    for row in merged.collect():  # FOLDS * MERGES matrices at most
        sums[row["fold"]] += np.frombuffer(row["sums"]).reshape(FEATURES + 1, FEATURES + 2)
    pull = RIDGE * np.eye(FEATURES + 1)
    pull[-1, -1] = 1e-6
    solve = lambda s: np.linalg.solve(s[:, :-1] + pull, s[:, -1])
    total = sums.sum(0)
    by_fold = np.array([solve(total - own) for own in sums])
    bins = mapped(known, _raw_scores(kernel, by_fold), "bin long, label int").groupBy("bin").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")
    ).orderBy("bin").toPandas()  # a few thousand bins
    knots = isotonic(bins["bin"].to_numpy() * BIN, bins["good"].to_numpy(float), bins["n"].to_numpy(float))
    out = mapped(stats, _calibrated(kernel, solve(total), knots), "doc_id long, score double")
    return out.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
