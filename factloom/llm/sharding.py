"""Jump consistent hashing of stable keys to shards, in DataFrame functions only.

The jump chain of a key is a rising list of shard numbers, the same for every
shard count n; the key's shard is the last number below n. So one chain up to
n + 1 gives both the shard today and the shard after one more is appended, and
a key moves only if the chain holds n itself.

The generator of the chain is a 64-bit multiply-and-add that wraps. Spark's
checked arithmetic doesn't wrap, so the state is kept as three limbs of 22, 22
and 20 bits, whose products never leave a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import materialise, whole_text

MULTIPLIER = 2862933555777941757  # fixed by the published algorithm
LIMB = (1 << 22) - 1
TOP = (1 << 20) - 1
#: Steps that settle practically all keys; the rest go on in a second loop.
FIRST_STEPS = 24
#: Each shard is numbered in independent parts, so that no task orders a whole shard: this many, or more of this many rows.
SLOT_PARTS, PART_ROWS = 64, 1_000_000
ROW_OVERHEAD = 16


def _step(state: Column, n: int) -> Column:
    a0, a1, a2 = MULTIPLIER & LIMB, (MULTIPLIER >> 22) & LIMB, MULTIPLIER >> 44
    s0, s1, s2 = state["s0"], state["s1"], state["s2"]
    r0 = s0 * a0 + 1
    r1 = s0 * a1 + s1 * a0 + F.shiftright(r0, 22)
    r2 = s0 * a2 + s1 * a1 + s2 * a0 + F.shiftright(r1, 22)
    t1, t2 = r1.bitwiseAND(LIMB), r2.bitwiseAND(TOP)
    high = F.shiftleft(t2, 11) + F.shiftright(t1, 11)  # the state's upper 31 bits
    jump = ((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
    after = F.struct(
        state["j"].alias("b"), state["b"].alias("before"), jump.alias("j"),
        r0.bitwiseAND(LIMB).alias("s0"), t1.alias("s1"), t2.alias("s2"),
    )
    return F.when(state["j"] < n, after).otherwise(state)


def jump_shards(key: Column, n: int) -> Column:
    """struct(shard, grown_shard) of a 64-bit hash, for n shards and for n + 1. A null key is hashed as any other."""
    if n < 1:
        raise ValueError("there must be at least one shard")
    long = lambda c: c.cast("long")
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("before"), F.lit(0).cast("long").alias("j"),
        long(key.bitwiseAND(LIMB)).alias("s0"),
        long(F.shiftrightunsigned(key, 22).bitwiseAND(LIMB)).alias("s1"),
        long(F.shiftrightunsigned(key, 44)).alias("s2"),
    )
    grown = n + 1
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(grown, FIRST_STEPS))), start, lambda acc, _: _step(acc, grown))
    if grown > FIRST_STEPS:
        more = F.sequence(F.lit(1), F.lit(grown - FIRST_STEPS))
        state = F.transform(
            F.array(state),
            lambda s: F.when(s["j"] < grown, F.aggregate(more, s, lambda acc, _: _step(acc, grown))).otherwise(s),
        )[0]
    return F.transform(
        F.array(state),
        lambda s: F.struct(
            F.when(s["b"] == n, s["before"]).otherwise(s["b"]).cast("int").alias("shard"),
            s["b"].cast("int").alias("grown_shard"),
        ),
    )[0]


def assign_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the shard count alone decide the shard. Null ids share one shard;
    null texts count as empty; rows that repeat an id share its shard and have
    slots of their own; other columns aren't read. Slots count from 0 without a
    gap in each shard, in the order (part, id, crc, size). The text leaves the
    row before anything is shuffled. A table of shards x parts counts, one for each PART_ROWS rows beyond
    a fixed number, is all that is broadcast.
    """
    text = whole_text(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = rows.withColumn("_s", jump_shards(F.xxhash64("doc_id"), n_shards)).select(
        "doc_id", "size", "text_crc32", "_s.shard", "_s.grown_shard",
    )
    rows = materialise(rows, "shards")
    parts = max(SLOT_PARTS, -(-rows.count() // (PART_ROWS * n_shards)))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(7), "doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard",
        )
    )
