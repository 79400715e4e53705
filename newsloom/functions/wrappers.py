"""Blocks of a text that repeat another block inside themselves.

Testing each pair of blocks costs the square of their number.  Here the blocks'
starts are indexed by hashes instead: for every power of two k one pass takes the
hash of all windows of k characters, and a block of k to 2k-1 characters is known
by its first and its last k.  Windows that meet a known start are few; what they
name is compared as text, so a shared hash never decides.  The work is linear in
the text, times the number of powers and of lengths that occur.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: an odd multiplier and its inverse modulo 2^64, a mixing constant ---
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % (1 << 64), np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def wrapping(blocks: list[str]) -> set[str]:
    """The blocks that contain another, shorter block of the list."""
    texts = sorted(set(blocks), key=len)
    if len(texts) < 2 or not texts[0]:
        return set(texts[1:])
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = len(codes)
    summed = np.zeros(total + 1, np.uint64)
    np.cumsum(_mixed(codes + np.uint64(1)) * _powers(_BASE, total), out=summed[1:])
    undo = _powers(pow(_BASE, -1, 1 << 64), total)
    owner = np.repeat(np.arange(len(texts)), sizes)
    room = ends[owner] - np.arange(total)  # characters from a place to its block's end
    found: set[int] = set()
    for power in range(int(sizes[-1]).bit_length()):
        k = 1 << power
        members = np.flatnonzero((sizes >= k) & (sizes < 2 * k))
        if not len(members):
            continue
        window = (summed[k:] - summed[:-k]) * undo[: total - k + 1]
        first = window[starts[members]]
        # a block's own start says nothing: it holds no shorter block than itself there
        places = np.flatnonzero((room[: len(window)] >= k) & np.isin(window, first))
        for size in np.unique(sizes[members]).tolist():
            own = members[sizes[members] == size]
            known = _mixed(window[starts[own]]) + window[ends[own] - k]
            order = np.argsort(known)
            at = places[(room[places] >= size) & (sizes[owner[places]] > size)]
            if not len(at):
                continue
            key = _mixed(window[at]) + window[at + size - k]
            hit = np.minimum(np.searchsorted(known[order], key), len(own) - 1)
            same = known[order][hit] == key
            for place, member in zip(at[same].tolist(), own[order][hit[same]].tolist()):
                if owner[place] not in found and joined.startswith(texts[member], place):
                    found.add(int(owner[place]))
    return {texts[i] for i in found}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unwrapped(blocks: pd.Series) -> pd.Series:
    def kept(row):
        if row is None:
            return None
        gone = wrapping([b for b in row if b is not None])
        return [b for b in row if b not in gone]

    return blocks.map(kept, na_action=None)


def drop_wrappers(blocks: Column | str) -> Column:
    """Drop a block that contains another, shorter block of the same array."""
    return _unwrapped(F.col(blocks) if isinstance(blocks, str) else blocks)
