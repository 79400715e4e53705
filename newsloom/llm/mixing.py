"""Mixing sources to target weights with a hypergeometric splitting tree.

Each source's documents stand in a random order (by a seeded hash) and are cut into
blocks. Targets, in words, say how many blocks of each source the mix takes; these
quotas are split between the output shards by a binary tree: at each node the blocks
of the left half are a multivariate-hypergeometric draw from the node's counts, so
every shard gets its exact number of blocks and the shards' quotas add up to the
source's. A shard then draws its own stretch of the source's permuted blocks, and
shuffles what it got.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import few_rows, saved

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
SHARD_BLOCKS = 2048
#: At least so many shards, if there are blocks enough.
MIN_SHARDS = 16
SEED = 17
#: About so many documents share a bucket of the running sums; so do buckets.
BUCKET_ROWS = 2000
#: The sources are the mix's recipe: one row each, kept on the driver up to this many.
MAX_SOURCES = 200_000
WORD = r"[^\x20\x09-\x0D]+"
_RECIPE = pa.schema({
    "none": pa.bool_(), "source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "full": pa.int32(), "over": pa.int64(),
})
_PLAN = pa.schema({
    "__none": pa.bool_(), "__source": pa.string(), "__blocks": pa.int64(), "__quota": pa.int64(), "__step": pa.int64(),
    "__shift": pa.int64(), "__bounds": pa.list_(pa.int64()),
})


def capped_shares(weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above MAX_REPEATS times its size."""
    sizes, weights = sizes.astype(float), weights.astype(float)
    caps = MAX_REPEATS * sizes
    target, open_ = np.zeros(len(sizes)), sizes > 0
    rest = sizes.sum()
    while open_.any():
        share = rest * weights / weights[open_].sum()
        over = open_ & (share >= caps)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = caps[over]
        rest -= caps[over].sum()
        open_ &= ~over
    return target


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard: sources x shards, rows add up to the
    quotas, columns differ by one at most. Every node has its own seed, so any
    shard's share can be drawn again from the path that leads to it."""
    out = np.zeros((len(quotas), shards), np.int64)

    def down(counts: np.ndarray, first: int, last: int, node: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        mid = (first + last) // 2
        total = int(counts.sum())
        left = total * (mid - first) // (last - first)
        random, rest, need = np.random.default_rng([seed, node]), total, left
        taken = np.zeros_like(counts)
        for k, own in enumerate(counts.tolist()):
            rest -= own
            taken[k] = random.hypergeometric(own, rest, need) if own and need else 0
            need -= int(taken[k])
        down(taken, first, mid, 2 * node)
        down(counts - taken, mid, last, 2 * node + 1)

    down(quotas.astype(np.int64), 0, shards, 1)
    return out


def _running(df: DataFrame, group: list[str], order: list, value: str, name: str) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def words_in(column) -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def placed(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source",
    size: F.Column | None = None, tie: F.Column | None = None,
) -> tuple[DataFrame, list]:
    """Every row of ``docs`` with its part in the mix; all columns kept, and
    ``__mix``: struct of size, source_size, target (long, long, double), ``start``
    (words before it in its source's order), ``full`` (passes over the whole source)
    and ``left`` (words the last, partial pass takes of it).

    The running sums go through two levels of hash buckets, so that no window holds
    more than about BUCKET_ROWS rows of a source, however large the source. Also
    returns the recipe: (is null, source, words, target, full passes, words over).
    ``size`` and ``tie``: words and a digest of the text, where they are known already.
    """
    size = words_in(F.col("text")) if size is None else size
    tie = F.xxhash64(F.col("text")) if tie is None else tie
    hashed = F.xxhash64(F.lit(SEED), F.col(id_column).cast("long"))
    slim = docs.select(
        F.col(source_column).cast("string").alias("source"), hashed.alias("h"), size.alias("size")
    )
    marked = slim.select("source", "h", "size", F.col("source").isNull().alias("none"))
    # buckets of the finest kind; they are merged below once the number of rows is known
    fine_bits = 20
    fine = saved(
        marked.groupBy("none", "source", F.shiftrightunsigned("h", 64 - fine_bits).alias("fine"))
        .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")),
        "mix-buckets",
    )
    sources = fine.groupBy("none", "source").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    found = sorted(
        ((r["none"], r["source"], r["words"], r["n"]) for r in sources.limit(MAX_SOURCES + 1).collect()),
        key=lambda r: (r[0], r[1] or ""),
    )
    if len(found) > MAX_SOURCES:
        raise ValueError(f"More than {MAX_SOURCES} sources: group them before mixing.")
    weights = np.array([WEIGHTS[k % len(WEIGHTS)] for k in range(len(found))])
    sizes = np.array([r[2] for r in found], np.int64)
    targets = capped_shares(weights, sizes)
    largest = max([r[3] for r in found], default=1)
    bits = min(fine_bits, max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS)))))
    coarse = fine_bits - bits
    recipe = []
    for (none, source, words, _), goal in zip(found, targets.tolist()):
        full = int(goal // words) if words else 0
        recipe.append((none, source or "", int(words), goal, full, int(round(goal - full * words))))
    recipe_rows = few_rows(docs.sparkSession, recipe, _RECIPE)
    keys = ["none", "source"]
    buckets = (
        fine.withColumn("source", F.coalesce("source", F.lit("")))
        .groupBy(*keys, F.shiftright("fine", coarse).alias("bucket")).agg(F.sum("words").alias("words"))
        .withColumn("group", F.shiftright("bucket", bits // 2))
    )
    groups = _running(buckets.groupBy(*keys, "group").agg(F.sum("words").alias("w")), keys, ["group"], "w", "base")
    before = _running(buckets, [*keys, "group"], ["bucket"], "words", "inner").join(
        groups.select(*keys, "group", "base"), [*keys, "group"]
    )
    starts = saved(
        before.select(*keys, "bucket", (F.col("base") + F.col("inner")).alias("begin")).join(recipe_rows, keys), "mix-starts"
    ).select(
        F.struct(*keys, "bucket").alias("__key"),
        F.struct("begin", "source_size", "target", "full", "over").alias("__of"),
    )
    key = F.struct(
        F.col(source_column).isNull().alias("none"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.shiftrightunsigned("__h", 64 - bits).cast("long").alias("bucket") if bits else F.lit(0).cast("long").alias("bucket"),
    )
    rows = docs.withColumn("__h", hashed).withColumn("__size", size).withColumn("__key", key)
    order = [F.col("__h"), F.col(id_column), tie]
    ranked = _running(rows, ["__key.none", "__key.source", "__key.bucket"], order, "__size", "__inner")
    joined = ranked.join(
        starts.select(
            F.col("__key.none").alias("__none"), F.col("__key.source").alias("__source"),
            F.col("__key.bucket").alias("__bucket"), "__of",
        ),
        (F.col("__key.none") == F.col("__none")) & (F.col("__key.source") == F.col("__source"))
        & (F.col("__key.bucket") == F.col("__bucket")),
    )
    start = F.col("__of.begin") + F.col("__inner")
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), F.col("__of.over") - start))
    out = joined.select(
        *docs.columns,
        F.struct(
            F.col("__size").alias("size"), F.col("__of.source_size").alias("source_size"),
            F.col("__of.target").alias("target"), start.alias("start"), F.col("__of.full").alias("full"), left.alias("left"),
            F.col("__key.none").alias("none"), F.col("__key.source").alias("source"), F.col("__h").alias("h"),
        ).alias("__mix"),
    )
    return out, recipe


def shares(docs: DataFrame) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken.

    ``taken`` sums the words of the row's copies in the dealt and shuffled shards,
    which are written as rows without their texts. Sources are taken in code-point
    order, null last, with weights 1, 2, 3 in turn. Whole passes over a source take
    every document once; the rest of a target is taken from the front of the source's
    random order, the last document in part, so a source's words meet its target to a
    word. A null text has size 0. Rows with null or repeated ids are documents of
    their own. An empty table gives an empty result.
    """
    slim = saved(
        docs.select(
            F.monotonically_increasing_id().alias("__row"), "doc_id", "source",
            words_in(F.col("text")).alias("__n"), F.xxhash64("text").alias("__tie"),
        ),
        "mix-documents",
    )
    rows, recipe = placed(slim, size=F.col("__n"), tie=F.col("__tie"))
    rows = saved(rows, "mix-placed")
    # written, so that the order within the shards is made and not only planned
    copies = saved(dealt(rows.select("__row", "__mix"), recipe), "mix-dealt")
    taken = copies.groupBy("__row").agg(F.sum("__words").alias("__taken"))
    mix = F.col("__mix")
    return rows.join(taken, "__row", "left").select(
        "doc_id", mix["size"].alias("size"), mix["source_size"].alias("source_size"), mix["target"].alias("target"),
        F.coalesce("__taken", F.lit(0).cast("long")).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = SEED, least_shards: int = MIN_SHARDS) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as it takes them, in their shards.

    Adds ``__shard`` (int), ``__words`` (words taken of this copy) and ``__order``
    (the place key within the shard). Blocks of BLOCK_WORDS words are dealt: each
    source's blocks, of all passes, stand in a permuted order (an affine map of
    the block number), and shard k draws the stretch its quota gives it. Rows come
    out grouped by shard and shuffled within it.
    """
    return dealt(*placed(docs), seed, least_shards)


def dealt(rows: DataFrame, recipe: list, seed: int = SEED, least_shards: int = MIN_SHARDS) -> DataFrame:
    """``mixed`` for rows that are placed already: their columns but ``__mix``. There are
    ``least_shards`` shards, more if they would hold more than SHARD_BLOCKS blocks, fewer
    if there are fewer blocks."""
    spark = rows.sparkSession
    mix = F.col("__mix")
    per_pass = np.array([max(1, -(-words // BLOCK_WORDS)) for _, _, words, _, _, _ in recipe], np.int64)
    # a partial pass ends in the block that holds its last word
    over = np.array([r[5] for r in recipe], np.int64)
    quotas = per_pass * np.array([r[4] for r in recipe], np.int64) + -(-over // BLOCK_WORDS)
    total = int(quotas.sum())
    shards = max(1, min(total, max(least_shards, -(-total // SHARD_BLOCKS))))
    bounds = np.cumsum(split_tree(quotas, shards, seed), axis=1)
    random = np.random.default_rng(seed)
    plan = []
    for k, (r, q) in enumerate(zip(recipe, quotas.tolist())):
        step = next(int(s) for s in random.integers(1, 1 << 31, 64) if math.gcd(int(s), max(1, q)) == 1) if q > 1 else 1
        plan.append((r[0], r[1], int(per_pass[k]), max(1, q), step, int(random.integers(0, max(1, q))), bounds[k].tolist()))
    table = few_rows(spark, plan, _PLAN)
    copies = rows.withColumn("__pass", F.explode(F.sequence(F.lit(0), mix["full"]))).withColumn(
        "__words", F.when(F.col("__pass") < mix["full"], mix["size"]).otherwise(mix["left"])
    ).filter((F.col("__words") > 0) | ((mix["size"] == 0) & (F.col("__pass") == 0)))
    blocks = copies.join(table, (mix["none"] == F.col("__none")) & (mix["source"] == F.col("__source")))
    block = F.col("__pass") * F.col("__blocks") + F.floor(mix["start"] / F.lit(BLOCK_WORDS))
    block = F.least(block, F.col("__quota") - 1)
    at = F.pmod(F.pmod(block, "__quota") * F.pmod("__step", "__quota") + F.col("__shift"), F.col("__quota"))
    shard = F.least(F.size(F.filter("__bounds", lambda b: b <= at)), F.lit(shards - 1))
    out = blocks.withColumn("__shard", shard.cast("int")).withColumn(
        "__order", F.xxhash64(F.lit(seed), "__shard", mix["h"], "__pass")
    ).select(*[c for c in rows.columns if c != "__mix"], "__shard", "__words", "__order")
    return out.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", "__order")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix with the columns of ``docs``: a document comes once per copy taken;
    of a copy taken in part the leading words stay, a blank between them, and
    n_chars follows. Documents without words, null texts among them, stay once; rows
    with null or repeated ids are documents of their own; an empty table stays empty."""
    full = words_in(F.col("text"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " ")
    part = F.col("__words") < full
    out = mixed(docs)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.when(part, cut).otherwise(F.col("text")).alias("text"))
        elif name == "n_chars":
            columns.append(F.when(part, F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(name))
    return out.select(*columns)
