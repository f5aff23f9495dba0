"""The prefix trie of conversations, as rows: chained digests name prefixes, grouping makes nodes, exploding to ancestors makes subtree sums.

A turn is digested where it is read (SHA-256 of the digests of its role and
text), so texts never travel. The digest of the first d turns is the SHA-256 of
that of the first d - 1 and the d-th turn's; equal digests are equal prefixes.
Each conversation is passed once, in order, and gives a row for each prefix;
rows of one (depth, digest) are a node. Shared prefixes, the root's above all, are aggregated before
they are shuffled.

Subtree sums explode each node to its ancestors. Within ``BLOCK`` depths these are all of them; beyond, a node is exploded
to the ancestors of its block of depths, and the blocks' tops to those of their
own block of tops, and so on, so a conversation of n turns gives some n * BLOCK rows and not n * n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import materialise, whole_text

BLOCK = 32
#: Ids that are joined to one string before the strings of a node are hashed in order.
IDS_AT_ONCE = 8192
ROOT = hashlib.sha256(b"").digest()


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, chars) of each turn: its place from 1 and its text's code points.

    Null turns come first, turns of one number stand by digest; a null role or
    text is empty. Rows without a conversation id belong to none and are left
    out. Other columns aren't read.
    """
    role, text = whole_text(role_col), whole_text(text_col)
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("_turn"),
        F.unhex(F.sha2(F.unhex(F.concat(F.sha2(role, 256), F.sha2(text, 256))), 256)).alias("digest"), F.char_length(text).cast("long").alias("chars"),
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "digest"))
    return rows.select("conv_id", place.cast("long").alias("place"), "digest", "chars")


PREFIXES = "conv_id long, depth long, digest binary, chars long, ends boolean, above array<array<binary>>"
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("chars", pa.int64()), ("ends", pa.bool_()), ("above", pa.list_(pa.list_(pa.binary())))])


def _chaining(block: int):
    """Rows come sorted by conversation and place; a row without a digest says that there is such a conversation."""
    def emit(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        last: list | None = None
        levels: list[list[bytes]] = []
        for b in batches:
            rows = []
            for conv_id, digest, chars in zip(*(c.to_pylist() for c in b.columns)):
                if conv_id != conv:
                    if last:
                        rows.append(last)
                    conv, levels = conv_id, [[ROOT]]
                    last = [conv_id, 0, ROOT, 0, True, []]
                if digest is None:
                    continue
                last[4] = False
                rows.append(last)
                depth, chained = last[1] + 1, hashlib.sha256(last[2] + digest).digest()
                above, k, step = [], 0, 1
                while depth % step == 0:  # the node is one of the k-th tree of block tops
                    if k == len(levels):
                        levels.append([ROOT])
                    above.append(levels[k])
                    levels[k] = [chained] if depth % (step * block) == 0 else [*levels[k], chained]
                    k, step = k + 1, step * block
                last = [conv_id, depth, chained, chars, True, above]
                if len(rows) >= 2048:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)
        if last:
            yield emit([last])

    return run


def prefixes(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """PREFIXES of (conv_id, place, digest, chars); ``conversations`` (conv_id) names those that may have no turns.

    ``above`` holds a node's ancestors, from its block's top down; its k-th list those
    among the tops of the k-th level, for a node that is one itself.
    """
    if block < 2:
        raise ValueError("a block has two depths at least")
    rows = turns.select("conv_id", "place", "digest", "chars")
    if conversations is not None:
        rows = rows.unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest", "chars")
    return dealt.mapInArrow(_chaining(block), PREFIXES)


def subtree_sums(nodes: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """(digest, *values): the values summed over each node's subtree; of nodes (digest, depth, above, *values)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps = [block]  # of each level, the depths that its blocks span
    while steps[-1] <= deepest:
        steps.append(steps[-1] * block)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(*[F.sum(v).alias(v) for v in values])

    def listed(level: int) -> Column:
        return F.coalesce(F.get("above", level), F.array().cast("array<binary>"))

    tops, inner = nodes, []
    for level, step in enumerate(steps):
        more = F.when(F.col("depth") % step == 0, F.array().cast("array<binary>")).otherwise(listed(level))
        inner.append(summed(tops.select(F.explode(F.concat(F.array("digest"), more)).alias("digest"), *values)))
        if level + 1 < len(steps):
            inner[-1] = materialise(inner[-1], "trie-level")
            tops = nodes.drop(*values).where(F.col("depth") % step == 0).join(inner[-1], "digest")
    total = inner.pop()
    for level in reversed(range(len(inner))):
        below = nodes.drop(*values).where((F.col("depth") > 0) & (F.col("depth") % steps[level] == 0)).join(total, "digest")
        total = materialise(summed(inner[level].unionByName(below.select(F.explode(listed(level)).alias("digest"), *values))), "trie-level")
    return total


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (digest, conv_id) in order, strings of up to IDS_AT_ONCE ids of one digest."""
    def emit() -> pa.RecordBatch:
        digests, firsts, texts = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["digest", "first", "ids"])

    node, ids, done = None, [], []
    for b in batches:
        for digest, conv_id in zip(*(c.to_pylist() for c in b.columns)):
            if ids and (digest != node or len(ids) == IDS_AT_ONCE):
                done.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = digest
            ids.append(conv_id)
        if len(done) >= 256:
            yield emit()
            done = []
    if ids:
        done.append((node, ids[0], ",".join(map(str, ids))))
    if done:
        yield emit()


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (digest, ids) in order, the SHA-256 of each digest's strings, comma-joined; they are hashed one by one."""
    node, state = None, hashlib.sha256()
    for b in batches:
        done = []
        for digest, ids in zip(*(c.to_pylist() for c in b.columns)):
            if digest == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["digest", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])


def ending_digests(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of rows (digest, conv_id): the hash of each digest's ids, ascending, comma-joined.

    Ids are ordered over ranges of (digest, id), so one node's may lie in any number of tasks; what is hashed in one task is strings of many ids, read in turn.
    """
    joined = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_joining, "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(_hashing, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and digest, parent (binary).

    conv_id is a node's smallest member, parent_conv_id its parent's; the root (depth 0)
    has no parent. n_leaves counts childless nodes in the subtree, saved_tokens sums (n_convs - 1) * code points of the
    last turn over it. An empty table has no node; conversations without turns
    are members of the root alone. Turns as ``turn_digests`` gives them; repeated
    places are turns in any order of theirs.
    """
    rows = materialise(prefixes(turns, conversations, block), "prefixes")
    nodes = rows.groupBy("depth", "digest", "chars", "above").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialise(nodes.withColumn("parent", F.element_at(F.get("above", 0), -1)), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialise(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "trie-children")
    sums = subtree_sums(nodes.select("digest", "depth", "above", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], block)
    ends = ending_digests(rows.where("ends"))
    own = nodes.select("digest", "parent", "conv_id", "depth", "n_convs", "n_children").join(sums, "digest").join(ends, "digest", "left")
    of_parent = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return own.join(of_parent, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest", "parent",
    )


def spliced(turns: DataFrame, every: int, length: Column) -> DataFrame:
    """Turns in which each conversation c begins with the first ``length`` (of conv_id) turns of conversation c - c % every, in place of as many of its own.

    A source that isn't there gives none, a shorter one all it has.
    """
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("_source"), length.cast("long").alias("_n"))
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_source"), "place", "digest", "chars")
    lent = ids.join(heads, "_source").where(F.col("place") <= F.col("_n")).select("conv_id", "place", "digest", "chars")
    kept = turns.where(F.col("place") > length).select("conv_id", "place", "digest", "chars")
    return reduce(DataFrame.unionByName, (lent, kept))
