"""A Bloom filter over 64-bit key hashes: built by aggregation in the JVM, broadcast with a fixed bound, probed in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A filter never has more bits than this (32 MiB); more keys than it serves are split into ranges with a filter each.
MAX_BITS = 1 << 28
HASHES, BITS_A_KEY = 5, 10
#: Words of a filter that travel as one value.
SEGMENT = 512


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """A power of two with ten bits or more a key, from 2^16 to `most`."""
    return min(most, max(1 << 16, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))


def ranges_for(keys: int, most: int = MAX_BITS) -> int:
    """How many filters of at most `most` bits give each key its ten bits."""
    return max(1, -(-BITS_A_KEY * keys // most))


def range_of(hash_col: Column, ranges: int) -> Column:
    """The filter that a hash belongs to; hashed once more, as the filters use the hash's own bits."""
    return F.pmod(F.xxhash64(hash_col), F.lit(ranges)).cast("int")


def build(keys: DataFrame, hash_col: str, bits: int) -> np.ndarray:
    """The filter as 64-bit words. Each word is or-ed together in the JVM, with partial results before the shuffle, and packed into
    segments, so that the driver gets the filter's own size."""
    h = F.col(hash_col)
    step = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(h.bitwiseAND(F.lit(0xFFFFFFFF)) + step * i).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))

    size = min(SEGMENT, bits >> 6)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            word, mask = (np.concatenate(x) for x in zip(*held))
            segments, own = np.unique(word // size, return_inverse=True)
            flat = np.zeros((len(segments), size), dtype=np.int64)
            flat[own, word % size] = mask
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], ["segment", "words"])

    out = np.zeros(bits >> 6, dtype=np.int64)
    for r in words.repartition(F.floor(F.col("word") / size).cast("long")).mapInArrow(pack, "segment bigint, words binary").toArrow().to_pylist():
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["words"], dtype=np.int64)
    return out


def may_contain(shared: Broadcast, hash_col: Column) -> Column:
    """False only where the hash was never added to the broadcast filter."""

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        words = shared.value
        top = (len(words) << 6) - 1
        x = h.to_numpy(dtype=np.int64)
        low, step = x & 0xFFFFFFFF, (x.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
        hit = np.ones(len(x), dtype=bool)
        for i in range(HASHES):
            at = (low + step * i) & top
            hit &= (words[at >> 6] >> (at & 63)) & 1 == 1
        return pd.Series(hit)

    return probe(hash_col)
