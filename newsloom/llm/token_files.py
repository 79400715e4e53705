"""Token files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A folder holds, for each range of ids, ``tokens-N.bin`` (the ids of all its documents
in a row), ``offsets-N.bin`` (64-bit: where each document starts in it, and its end)
and ``documents-N.bin`` (64-bit ids); ``index.json`` has the width of a token and the
base of each range, a prefix sum of the ranges' token counts. The folder must be
shared by the driver and the executors; its address may be that of any store pyarrow
knows, a store of files is memory-mapped when read.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Ordered, mapped, saved, slices
from newsloom.llm.word_encoder import encoder

END = 0
#: Stands for a null id in the files.
NO_ID = -(1 << 63)


class _Written:
    """A file that appears under its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.path, self.own = f"{base}/{name}", f"{base}/.{name}.{uuid4().hex}"
        self.stream = self.store.open_output_stream(self.own)

    def close(self):
        self.stream.close()
        self.store.move(self.own, self.path)


def _writer(folder: str, tokenizer: str):
    def run(batches):
        words = encoder(tokenizer)
        end = np.array([END], words.dtype).tobytes()
        files, at, count, number = None, 0, 0, None
        for part in slices(batches):
            if files is None:
                number = part.column(2)[0].as_py()
                files = [_Written(folder, f"{kind}-{number:05d}.bin") for kind in ("tokens", "offsets", "documents")]
            texts = [t or "" for t in part.column(1).to_pylist()]
            encoded = [ids + end for ids in words.encode(texts)]
            sizes = [len(ids) // words.dtype.itemsize for ids in encoded]
            starts = at + np.cumsum([0, *sizes])
            files[0].stream.write(b"".join(encoded))
            files[1].stream.write(starts[:-1].astype("<u8").tobytes())
            ids = [NO_ID if i is None else i for i in part.column(0).to_pylist()]
            files[2].stream.write(np.array(ids, "<i8").tobytes())
            at, count = int(starts[-1]), count + len(texts)
        if files:
            files[1].stream.write(np.array([at], "<u8").tobytes())
            for file in files:
                file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([count], pa.int64()), pa.array([at], pa.int64())],
                ["part", "documents", "tokens"],
            )
    return run


def write(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """Write the token files of ``docs`` in ascending id order; returns the index.

    Texts move once, to ranges of ids, each written by one task. A task that runs
    again writes the same bytes under the same names. A null text counts as empty
    (the end id alone); a null id comes first; repeated ids are ordered by text;
    other columns are not read. An empty table gives an index without ranges.
    """
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    ranges = Ordered(docs, id_column)
    source = ranges.part_of(docs.select(F.col(id_column).cast("long").alias(id_column), F.col(text_column).alias("text")))
    dealt = source.select(F.col(id_column).alias("doc_id"), "text", "part").repartitionById(ranges.parts, F.col("part"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = saved(mapped(ordered, _writer(folder, tokenizer), "part int, documents long, tokens long"), "token-parts")
    parts = sorted((r["part"], r["documents"], r["tokens"]) for r in written.collect())  # one row per range
    bases = [0, *accumulate(tokens for _, _, tokens in parts)]
    index = {
        "dtype": encoder(tokenizer).dtype.str, "end": END,
        "parts": [{"part": p, "documents": d, "tokens": t, "base": b} for (p, d, t), b in zip(parts, bases)],
    }
    with store.open_output_stream(f"{base}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


def _mapped_file(folder: str, name: str, dtype: str) -> np.ndarray:
    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


#: Tokens widened at once for checksums.
_WIDENED = 1 << 18


def _checksums(tokens: np.ndarray, cuts: np.ndarray) -> list[int]:
    """crc32 of each document's ids as 32-bit integers; ``cuts``: where documents start, and the end.

    Documents are widened many at once, and one longer than _WIDENED piece by piece.
    """
    out, first, ends = [], 0, cuts.tolist()
    while first < len(ends) - 1:
        at = ends[first]
        last = max(first + 1, int(np.searchsorted(cuts, at + _WIDENED, "right")) - 1)
        if ends[last] - at > _WIDENED:
            crc = 0
            for k in range(at, ends[last], _WIDENED):
                crc = zlib.crc32(tokens[k:min(k + _WIDENED, ends[last])].astype("<u4"), crc)
            out.append(crc)
        else:
            wide = memoryview(tokens[at:ends[last]].astype("<u4").tobytes())
            own = [4 * (end - at) for end in ends[first:last + 1]]
            out += [zlib.crc32(wide[a:b]) for a, b in zip(own, own[1:])]
        first = last
    return out


def _reader(folder: str, dtype: str):
    def run(batches):
        for batch in batches:
            for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = _mapped_file(folder, f"tokens-{number:05d}.bin", dtype)
                offsets = _mapped_file(folder, f"offsets-{number:05d}.bin", "<u8")
                ids = _mapped_file(folder, f"documents-{number:05d}.bin", "<i8")
                for k in range(0, len(ids), 1024):
                    cuts = np.array(offsets[k:k + 1025], np.int64)
                    own = np.array(ids[k:k + 1024])
                    crc = _checksums(tokens, cuts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(base + cuts[:-1]),
                            pa.array(np.diff(cuts)), pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the files hold: doc_id, start (tokens before it), n_tokens, ids_crc32."""
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{base}/index.json") as file:
        index = json.loads(file.read())
    rows = [(p["part"], p["base"]) for p in index["parts"]]
    parts = spark.createDataFrame(rows, "part int, base long").repartition(max(1, len(rows)))
    return mapped(parts, _reader(folder, index["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
