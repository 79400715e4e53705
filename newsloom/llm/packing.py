"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each partition packs its own pieces, largest first, into the fullest sequence they
fit in. Sequences that are nearly full are done; the rest become items themselves,
come together in fewer groups, and are packed again, up a tree, until one group is
left or nothing more fits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, saved, slices
from newsloom.llm.word_encoder import encoder

LENGTH, END = 2048, 0
#: A sequence with at most so many free places is done.
SLACK = 8
#: Groups of one round that come together in the next, and rows a group may hold.
FAN_IN, GROUP_ROWS = 8, 400_000


def _pieces(tokenizer: str, length: int, with_ids: bool):
    def run(batches):
        words = encoder(tokenizer)
        end = np.array([END], words.dtype).tobytes()
        step = length * words.dtype.itemsize
        for part in slices(batches):
            rows = []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(texts)):
                ids += end
                for k in range(0, len(ids), step):
                    own = np.frombuffer(ids[k:k + step], words.dtype)
                    crc = zlib.crc32(own.astype("<u4").tobytes())
                    rows.append((doc_id, k // step, k // words.dtype.itemsize, len(own), crc, own.tobytes() if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds)], names[:keep])
    return run


def pieces(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Tokens of each document with the end id, cut only where longer than ``length``:
    doc_id, piece, start, length, ids_crc32 (and ``ids``, binary)."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return mapped(source, _pieces(tokenizer, length, with_ids), schema)


def best_fit(fills: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing of items no longer than ``length``: bin and offset of each
    item, fill of each bin. Ties go by position, so equal input packs equally."""
    order = np.argsort(-fills, kind="stable")
    bins, offsets = np.empty(len(fills), np.int64), np.empty(len(fills), np.int64)
    used: list[int] = []
    free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0  # bit r: some bin has r places free
    for item, fill in zip(order.tolist(), fills[order].tolist()):
        fitting = mask >> fill
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + fill
            target = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            target, room = len(used), length
            used.append(0)
        bins[item], offsets[item] = target, used[target]
        used[target] += fill
        room -= fill
        if room:
            free[room].append(target)
            mask |= 1 << room
    return bins, offsets, np.array(used, np.int64)


def _packed(round_: int, length: int):
    """Rows of one group (item, offset in it, its fill last) to rows in new bins."""
    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        item, inner, fill = (table.column(n).to_numpy() for n in ("item", "offset", "fill"))
        new = np.concatenate([[True], item[1:] != item[:-1]])
        first = np.flatnonzero(new)
        bins, offsets, used = best_fit(fill[first], length)
        of = np.cumsum(new) - 1
        number = bins[of] + (round_ << 56 | TaskContext.get().partitionId() << 32)
        kept = table.drop_columns(["item", "offset", "fill"])
        for name, values in (("item", number), ("offset", inner + offsets[of]), ("fill", used[bins[of]])):
            kept = kept.append_column(name, pa.array(values))
        yield from kept.to_batches(max_chunksize=10_000)
    return run


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Place of every piece of every document in sequences of at most ``length`` tokens:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    A null text counts as empty (the end id alone). Rows with null or repeated ids
    are documents of their own. An empty table gives an empty result. Each round is
    written and read back, so a lost executor never mixes two packings.
    """
    cut = saved(pieces(docs, tokenizer, length, id_column, text_column, with_ids), "pieces")
    names = cut.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", item long, offset long, fill long"
    # in the first round each piece is an item, and a partition of the table a group
    rest = cut.withColumns({
        "item": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "fill": F.col("length")
    })
    groups, round_, items, done = rest.rdd.getNumPartitions(), 0, None, []
    while True:
        bins = saved(mapped(rest, _packed(round_, length), schema), "packed")
        left = bins.filter(F.col("fill") < length - SLACK)
        found = left.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("offset") == 0).alias("items")).first()
        shrunk = items is None or found["items"] < 0.99 * items
        if groups == 1 or not found["items"] or not shrunk:
            done.append(bins)
            break
        done.append(bins.filter(F.col("fill") >= length - SLACK))
        items, round_ = found["items"], round_ + 1
        groups = max(-(-groups // FAN_IN), -(-found["rows"] // GROUP_ROWS))
        group = F.pmod(F.xxhash64(F.lit(round_), "item"), F.lit(groups)).cast("int")
        rest = left.repartitionById(groups, group).sortWithinPartitions(F.desc("fill"), "item", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*names[:5], F.col("item").alias("sequence_id"), "offset", *names[5:])


def sequences(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """sequence_id and its tokens (array of int), of ``pack(..., with_ids=True)``; a
    group is one sequence, so it holds at most its length in pieces."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))

    def tokens(batches):
        for part in slices(batches):
            rows = [
                np.frombuffer(b"".join(p["ids"] for p in row), dtype).astype(np.int32) for row in part.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "tokens"])

    return mapped(joined, tokens, "sequence_id long, tokens array<int>")
