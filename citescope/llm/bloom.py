"""Blocked Bloom filters of 64-bit keys, built by Spark and small enough to be sent to tasks.

A filter has one or more shards, and each its own blocks.  A key has one block of 64 bits, in
which it sets up to five; so a probe reads one number.
Blocks are joined by ``bit_or`` in Spark and packed into a few binary parts, which are all
that reaches the driver.  The number of blocks is bounded by ``max_bytes``: more keys than it
was made for let more strangers pass, never fewer members."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm import words as W

#: Bits for each key: about one stranger in a thousand passes.
BITS_PER_KEY = 24
MAX_BYTES = 32 << 20
_PART = 1 << 16


def _places(keys: np.ndarray, blocks: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of each key; ``blocks``, of all or of each, is a power of two."""
    h = W.mix(keys.view(W.U64), seed=41)
    one = W.U64(1)
    bits = one << (h & W.U64(63))
    for k in range(1, 5):
        bits |= one << ((h >> W.U64(6 * k)) & W.U64(63))
    return ((h >> W.U64(32)) & (np.asarray(blocks) - 1).astype(W.U64)).astype(np.int64), bits


class Filter:
    """Whether a key may be a member of a shard; all members are."""

    def __init__(self, shards: np.ndarray, sizes: np.ndarray, blocks: np.ndarray):
        self.shards, self.sizes, self.blocks = shards, sizes, blocks
        self.firsts = np.cumsum(sizes) - sizes

    def holds(self, keys: np.ndarray, shard: int = 0) -> np.ndarray:
        k = int(np.searchsorted(self.shards, shard))
        if k == len(self.shards) or self.shards[k] != shard:
            return np.zeros(len(keys), dtype=bool)
        at, bits = _places(keys, int(self.sizes[k]))
        return (self.blocks[self.firsts[k] + at] & bits) == bits


def blocks_for(keys: int, max_bytes: int = MAX_BYTES) -> int:
    """Number of blocks, a power of two."""
    wanted = max(1, keys * BITS_PER_KEY // 64)
    return min(1 << (wanted - 1).bit_length(), 1 << ((max_bytes // 8).bit_length() - 1))


Keys = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _set_bits(shards: np.ndarray, sizes: np.ndarray, keys: Keys):
    firsts = np.cumsum(sizes) - sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, key = keys([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            k = np.searchsorted(shards, shard)
            at, bits = _places(key.astype(np.int64), sizes[k])
            at = firsts[k] + at
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            merged = np.bitwise_or.reduceat(bits[order], first) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(merged.view(np.int64))], names=["block", "bits"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    at = table.column("block").to_numpy()
    part = np.zeros(_PART, dtype=W.U64)
    part[at % _PART] = table.column("bits").to_numpy().view(W.U64)
    return pa.table({"part": pa.array(at[:1] // _PART), "data": pa.array([part.tobytes()], pa.binary())})


def build(rows: DataFrame, counts: dict[int, int], keys: Keys, max_bytes: int = MAX_BYTES) -> Filter:
    """The filter of about as many rows of each shard.

    ``keys`` makes the shard and a number of each row from its columns, without nulls."""
    shards = np.array(sorted(counts), dtype=np.int64)
    total = max(1, sum(counts.values()))
    sizes = np.array([blocks_for(counts[s], max(8, max_bytes * counts[s] // total)) for s in shards.tolist()], dtype=np.int64)
    merged = rows.mapInArrow(_set_bits(shards, sizes, keys), "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))
    packed = merged.groupBy(F.expr(f"block div {_PART}")).applyInArrow(_pack, "part long, data binary")
    blocks = int(sizes.sum())
    out = np.zeros(-(-blocks // _PART) * _PART, dtype=W.U64)
    for r in packed.toLocalIterator():
        out[r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.data, dtype=W.U64)
    return Filter(shards, sizes, out[:blocks])
