"""Candidates for similar sets by SimHash: several fingerprints of each set, and deletion variants of their segments.

At a Jaccard similarity of 0.8, two fingerprints differ in some ten bits of 64,
so no radius that can be indexed spans whole ones. A segment of 32 bits
may still differ in at most one, and several fingerprints give several chances of that. Sets are
candidates if any segment of theirs differs in at most one bit: equal segments meet their
smallest set, and distinct segments are indexed 32 times, with one bit
position left open. As only distinct ones are, a bucket holds two at most, however many sets are alike.

What meets is verified by the caller, and what doesn't meet is the caller's to find.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, materialise
from factloom.llm.wordhash import mix

#: Fingerprints of a set, of 64 bits each, and the bits of a segment.
PRINTS, HALF = 2, 32
#: Segments whose variants are shuffled at once, which bounds the disk they take.
AT_ONCE = 2
_SEEDS = (np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def fingerprints(s: np.ndarray) -> np.ndarray:
    """The SimHash fingerprints of a set of 64-bit hashes: a bit is 1 if set in over half of them, mixed anew for each fingerprint."""
    bits = np.zeros((PRINTS, 64), np.int64)
    for k in range(0, len(s), 1 << 14):  # a very large set isn't held as bits all at once
        mixed = mix(s[None, k:k + (1 << 14)] + _SEEDS).astype(">u8")
        bits += np.unpackbits(mixed.view(np.uint8).reshape(PRINTS, -1, 8), axis=2).sum(1, dtype=np.int32)
    return np.packbits(2 * bits > len(s), axis=1).view(">u8").astype(np.uint64).ravel()


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of rows (key, prints) of which a segment differs in at most one bit, through the smallest key of equal segments."""
    low = (1 << HALF) - 1
    halves = ", ".join(f"prints[{k}] & {low}L, shiftrightunsigned(prints[{k}], {HALF})" for k in range(PRINTS))
    opened = ", ".join(f"(value & {low & ~(1 << p)}L) + (segment * {HALF}L + {p}L) * {1 << HALF}L" for p in range(HALF))
    own = sets.select("key", F.expr(f"posexplode(array({halves}))").alias("segment", "value"))
    first = own.groupBy("segment", "value").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialise(first, "segments")
    equal = own.join(first.where("n > 1"), ["segment", "value"]).where("key > first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    found = [materialise(equal.distinct(), "equal-segments")]
    for k in range(0, 2 * PRINTS, AT_ONCE):
        some = first.where(F.col("segment").between(k, k + AT_ONCE - 1))
        buckets = some.select("first", F.expr(f"explode(array({opened}))").alias("bucket"))
        met = buckets.groupBy("bucket").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
        found.append(materialise(met.select("a", "b").distinct(), "near-segments"))
    pairs = materialise(reduce(DataFrame.unionByName, found).distinct(), "fingerprint-pairs")
    for table in (first, *found):
        discard(table)
    return pairs
