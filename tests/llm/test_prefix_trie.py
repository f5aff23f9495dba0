import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import prefix_trie, queries
from tests.oracle import both

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("digest", T.StringType()), ("place", T.StringType()))])


def in_order(rows):
    """{conversation: [(role, text)]} by brute force."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, turn_digest(role or "", text or ""), (role or "", text or "")))
    return {c: [said for *_, said in sorted(turns)] for c, turns in by.items()}


def turn_digest(role, text):
    return hashlib.sha256(hashlib.sha256(role.encode()).digest() + hashlib.sha256(text.encode()).digest()).digest()


def brute(convs):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    out = []
    for node, own in members.items():
        children = [x for x in members if len(x) == len(node) + 1 and x[:-1] == node]
        below = [x for x in members if x[:len(node)] == node]
        leaves = sum(all(y[:-1] != x for y in members if y) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def found(turns, conversations=None, block=prefix_trie.BLOCK):
    return sorted((tuple(r) for r in prefix_trie.trie(turns, conversations, block).drop("digest", "parent").collect()), key=str)


ROWS = [
    (1, 0, "user", "a", "x", None), (1, 1, "bot", "bb", None, "y"), (2, 0, "user", "a", None, None), (2, 1, "bot", "bb", None, None), (2, 2, "user", "ccc", None, None),
    (3, None, None, None, None, None), (3, 0, "user", "a", None, None), (4, 5, "", "", None, None), (4, 6, "user", "a", None, None),
    (5, 1, "u", "tie", None, None), (5, 1, "u", "é€😀", None, None), (5, 1, "u", "tie", None, None), (None, 0, "user", "a", None, None), (None, None, None, None, None, None),
    (-6, 0, "user", "a", None, None), (7, 0, "user\nbot", "", None, None), (8, 0, "user", "\nbot", None, None), (9, 0, "user", "z" * 100_000, None, None),
]


def test_nodes_of_awkward_conversations(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert found(prefix_trie.turn_digests(df)) == brute(in_order(ROWS))


def test_conversations_without_turns_belong_to_the_root(spark):
    turns = prefix_trie.turn_digests(spark.createDataFrame(ROWS, SCHEMA))
    ids = spark.createDataFrame([(1,), (2,), (50,)], "conv_id long")
    assert found(turns.where("conv_id in (1, 2)"), ids) == brute({c: x for c, x in in_order(ROWS).items() if c in (1, 2)} | {50: []})


def test_an_empty_table_has_no_node(spark):
    assert found(prefix_trie.turn_digests(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("block", [2, 3, 32])
def test_deep_conversations_are_summed_by_blocks(spark, block):
    rng = random.Random(block)
    rows = []
    for c in range(14):
        same = rng.randrange(0, 40)
        rows += [(c, k, "u", "same" if k < same else rng.choice("ab"), None, None) for k in range(rng.choice([0, 1, 2, 7, 40]))]
    turns = prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))
    assert found(turns, None, block) == brute(in_order(rows))


def test_ids_that_end_at_a_node_are_hashed_over_many_strings(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    rows = spark.range(0, 1000, 1, 8).select(F.lit("n").cast("binary").alias("digest"), (F.col("id") * 7 % 1000 - 20).alias("conv_id"))
    one = prefix_trie.ending_digests(rows.unionByName(spark.range(1).select(F.lit("m").cast("binary").alias("digest"), F.lit(3).cast("long").alias("conv_id")))).collect()
    want = {b"n": ",".join(map(str, range(-20, 980))), b"m": "3"}
    assert {bytes(r.digest): r.ends_sha256 for r in one} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_spliced_conversations(spark):
    rows = [(100, k, "u", f"s{k}", None, None) for k in range(3)] + [(c, k, "u", f"{c}-{k}", None, None) for c in (101, 102, 205) for k in range(4)]
    turns = prefix_trie.turn_digests(spark.createDataFrame(rows, SCHEMA))
    convs = in_order(rows)
    want = {c: (convs[100] if c < 200 else [])[:c % 6] + x[c % 6:] for c, x in convs.items()}
    got = prefix_trie.spliced(turns, 100, F.col("conv_id") % 6)
    assert found(got, turns.select("conv_id").distinct()) == brute(want)


def test_query_equals_its_sql(spark):
    mine, theirs = both(spark, queries.op11_conversation_prefix_trie, queries.OP11_SQL)
    assert mine and mine == theirs
