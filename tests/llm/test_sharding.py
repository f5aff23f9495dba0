import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 23, 40, 1000])
def test_shards_equal_the_published_algorithm(spark, n):
    rows = spark.range(300).select("id", F.xxhash64("id").alias("h")).withColumn("s", sharding.jump_shards(F.col("h"), n)).collect()
    for r in rows:
        assert r.s.shard == jump(r.h % (1 << 64), n) and r.s.grown_shard == jump(r.h % (1 << 64), n + 1)
        assert r.s.grown_shard in (r.s.shard, n)


def test_slots_sizes_and_odd_rows(spark):
    rows = [(k, "x" * (k % 7), "a") for k in range(500)] + [(None, "n", "b"), (3, None, "c"), (3, "é", "c"), (3, "é", "c")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, slot string"), 40).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted(
        (d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows
    )
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.assign_shards(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0
