import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from factloom.llm import packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity=2048):
    plain = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc_id, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        at, k = 0, 0
        while at < len(ids):
            n = first if k == 0 else capacity
            want[doc_id, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table_is_packed_near_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, BYTES).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    bound = packing.plan_packing(dict(Counter(r.length for r in rows))).lower_bound
    assert bound <= used <= bound * 1.01 + 1


def test_odd_rows_and_empty_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])
    rows = [(1, None, "a"), (2, "", None), (3, "same", "b"), (3, "same", "b"), (None, "no id", "c"), (5, "word " * 30_000, None)]
    frame = spark.createDataFrame(rows, schema)
    assert check(packing.pack(frame, BYTES).collect(), [r[:2] for r in rows]) >= 15
    assert packing.pack(spark.createDataFrame([], schema), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 300])
    histogram = {k: rnd.randint(1, 10 ** rnd.randint(0, 6)) for k in rnd.sample(range(1, capacity + 1), capacity // 2)}
    plan = packing.plan_packing(histogram, capacity, rounds=60)
    placed = Counter()
    for c, n in plan.configurations:
        assert sum(c) <= capacity and n > 0
        for k in c:
            placed[k] += n
    assert placed == histogram
    assert plan.lower_bound <= plan.n_sequences <= plan.lower_bound * 1.1 + capacity


def test_pricing_equals_a_plain_knapsack():
    rnd = random.Random(1)
    values = np.array([0.0] + [rnd.random() * k for k in range(1, 41)])
    best = [0.0] * 41
    for c in range(1, 41):
        best[c] = max([best[c - 1]] + [best[c - k] + values[k] for k in range(1, c + 1)])
    worth, used = packing.dearest(values, 40)
    assert worth == pytest.approx(best[40]) and sum(values[k] * n for k, n in used.items()) == pytest.approx(worth)


def test_special_strings_are_the_library_s_tokens():
    from factloom.llm.tokenizing import tokenizer

    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|ENDOFTEXT|> y", "plain text", "<|startoftext|> in <|endoftext|> out"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        plain, as_text = Tokenizer.from_file(path), Tokenizer.from_file(path)
        as_text.encode_special_tokens = True
        for own, truth in ((tokenizer(path), plain), (tokenizer(path, special_as_text=True), as_text)):
            got = [np.frombuffer(x, "<u4").tolist() for x in own.many(texts)]
            assert got == [truth.encode(x, add_special_tokens=False).ids for x in texts]
