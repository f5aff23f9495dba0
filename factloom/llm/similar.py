"""Near copies: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by SimHash and an exact join for what it leaves apart.

What deletion variants of SimHash fingerprints bring together
(``variants``) is verified by whole sets first, and links make groups. Fingerprints can't promise to reach a pair, so
pairs of different groups are then sought by a prefix join, which loses none. In any one order of all shingles, two sets of
which one has a shingles and that reach the threshold t share a shingle among the first
a - ceil(t a) + 1 of each, so meeting on these loses no pair. The order puts
shingles that are common in a sample of the texts last, which keeps buckets
small; it bears on the cost alone, never on the pairs. Equal sets are one beforehand,
and only shingles that two prefixes or more hold travel on.

With the fingerprints' candidates each set is also held against a few others, those of some members of its prefix
buckets with which it shares most; this joins large groups at a linear cost. Then pairs of one
bucket that no link joins yet are sought. Sizes and places in the order tell which can still
reach the threshold, and so do parity bitmaps, a short one within the join and a longer one
behind it: the bits in which two of them differ are no
more than the shingles that one set alone has. Every candidate left is verified by its whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import variants
from factloom.llm.common import discard, drop_what_is_kept, give_back, materialise, one_row_each
from factloom.llm.graph import components
from factloom.llm.wordhash import mix, ngrams

WIDTH, THRESHOLD = 5, 0.8
#: Texts that are sampled for the order of shingles, and shingles that are put last at most.
SAMPLED, MOST_COMMON = 2000, 200_000
#: Members of a bucket that others are held against at first, and how many of these a set is verified with.
MEMBERS, CLOSEST = 16, 3
#: Words of 64 bits of the short bitmap.
SKETCH = 8
#: Bytes of text whose shingles are made at once.
AT_A_TIME = 1 << 20


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The hashes of the distinct shingles, sorted; a shorter text is one shingle, and one without words has none."""
    return next(_shingles_of([text], width))


def _shingles_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingles of each text, made for many texts at once."""
    words = [(x or "").encode("utf-8").lower().split() for x in texts]  # as in simhash: A-Z change, and white space is ASCII's
    sizes = np.array([len(w) for w in words], np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for own in words for w in own), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    grams = ngrams(hashes, width)
    for end, n in zip(ends.tolist(), sizes.tolist()):
        own = grams[end - n:end - width + 1] if n >= width else ngrams(hashes[end - n:end], n) if n else hashes[:0]
        yield np.unique(own)


def _each(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of an array of texts, by slices of about AT_A_TIME."""
    some, start, size = [], 0, 0
    for i, x in enumerate(texts):
        some.append(x.as_py())
        size += len(some[-1] or "")
        if size >= AT_A_TIME:
            yield from enumerate(_shingles_of(some, width), start)
            some, start, size = [], i + 1, 0
    yield from enumerate(_shingles_of(some, width), start)


def prefix_length(n: int, threshold: float = THRESHOLD) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def _key(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64))


def parity_bits(s: np.ndarray, size: int = 0) -> np.ndarray:
    """A bitmap of ``size`` bits, by default at least two a shingle and a power of two; a bit tells whether an odd number of shingles falls on it."""
    size = size or (max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64)
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts).view(np.int64)))


SETS = "doc_id long, key long, n int, prefix array<long>, bits array<long>, sketch array<long>, prints array<long>"


def _prefixes(common: np.ndarray, rank: np.ndarray, threshold: float, width: int):
    """SETS of rows of (id, text); ``common`` is sorted, a higher ``rank`` stands later in the order."""
    def prefix(s: np.ndarray) -> np.ndarray:
        late = np.zeros(len(s), np.int64)
        if len(common) and len(s):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            late = np.where(common[at] == s, rank[at], 0)
        return s[np.lexsort((s, late))[:prefix_length(len(s), threshold)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[int], done: list[tuple]) -> pa.RecordBatch:
            keys, sizes, prefixes, bits, sketches, prints = zip(*done)
            return pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(prefixes), _lists(bits), _lists(sketches), _lists(prints)],
                names=["doc_id", "key", "n", "prefix", "bits", "sketch", "prints"],
            )

        drop_what_is_kept()
        for b in batches:
            rows, done, held = [], [], 0
            for i, s in _each(b.column(1), width):
                rows.append(i)
                done.append((_key(s), len(s), prefix(s), parity_bits(s), parity_bits(s, 64 * SKETCH), variants.fingerprints(s)))
                held += len(s)
                if held >= 1 << 20:
                    yield batch(rows, done)
                    rows, done, held = [], [], 0
            if rows:
                yield batch(rows, done)
        give_back()

    return run


def _whole(width: int):
    """(key, shingles) of rows of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, s in _each(b.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_key(s)], np.uint64).view(np.int64)), _lists([s])], names=["key", "shingles"])

    return run


def _sampled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, s in _each(b.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["shingle"])

    return run


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled texts and their numbers of texts, sorted by shingle."""
    total = rows.count()
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // SAMPLED))) == 0).select("text").distinct()
    counted = some.mapInArrow(_sampled(width), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    top = counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
    found, n = np.asarray(top.column("shingle")).astype(np.int64).view(np.uint64), np.asarray(top.column("n")).astype(np.int64)
    order = np.argsort(found)
    return found[order], n[order]


def _alone(a: Column, b: Column) -> Column:
    """The bits in which two parity bitmaps differ; the longer is folded to the other's length, which keeps parities."""
    def fold(x: Column, y: Column) -> Column:
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    differ = F.zip_with(fold(a, b), fold(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda total, x: total + x)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id) of each row: the smallest id that a chain of similar texts leads to. Texts without words are one group.

    Rows that repeat an id have a row each. Null ids are returned, but name no
    component unless all ids of it are null. Other columns aren't read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = materialise(docs.mapInArrow(_prefixes(*_common(docs, width), threshold, width), SETS), "shingle-prefixes")
    rows = materialise(every.select("doc_id", "key"), "set-keys")
    sets = materialise(every.groupBy("key").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "bits", "sketch", "prints")]), "distinct-sets")
    discard(every)
    least = sets.select("key", "least")
    placed = sets.select("key", "n", F.posexplode("prefix").alias("at", "token"))
    several = placed.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token")
    shared = materialise(placed.join(several, "token"), "shared-prefixes")
    members = shared.groupBy("token", F.pmod(F.xxhash64("key"), F.lit(MEMBERS)).alias("_m")).agg(F.min(F.struct("key", "n", "at")).alias("first"))

    def enough(n: Column, at: Column, m: Column, place: Column) -> Column:
        """Whether sets of n and m whose first shared shingle has these places can reach the threshold."""
        most = F.least(n - at, m - place)
        return most >= threshold * (n + m - most) - 1e-9

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The candidates (a, b) that reach the threshold: by bitmaps first, then by whole sets, made again of their texts alone."""
        of = lambda side: sets.select(F.col("key").alias(side), F.col("n").alias(f"_n{side}"), F.col("bits").alias(f"_bits{side}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        total = F.col("_na") + F.col("_nb")
        likely = both.where((total - _alone(F.col("_bitsa"), F.col("_bitsb"))) / 2 >= threshold / (1 + threshold) * total - 1e-6)
        likely = materialise(likely.select("a", "b"), f"{name}-candidates")
        keys = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        ids = least.join(keys, "key", "left_semi").select(F.col("least").alias("_id"))
        texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        whole = materialise(texts.mapInArrow(_whole(width), "key long, shingles array<long>").join(keys, "key", "left_semi").dropDuplicates(["key"]), f"{name}-sets")
        one = whole.select(F.col("key").alias("a"), F.col("shingles").alias("_a"))
        other = whole.select(F.col("key").alias("b"), F.col("shingles").alias("_b"))
        common = F.size(F.array_intersect("_a", "_b"))
        held = likely.join(one, "a").join(other, "b").where(common >= threshold * (F.size("_a") + F.size("_b") - common) - 1e-9)
        held = materialise(held.select("a", "b"), name)
        discard(whole)
        return held

    col = F.col
    near = variants.candidates(sets.select("key", "prints"))
    stars = shared.join(members, "token").where((col("key") != col("first.key")) & enough(col("n"), col("at"), col("first.n"), col("first.at")))
    stars = stars.groupBy(col("first.key").alias("a"), col("key").alias("b")).agg(F.count(F.lit(1)).alias("_c"))
    closest = stars.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("_c", "a")), False), 1, CLOSEST).alias("_s")).select("b", F.explode("_s.a").alias("a"))
    stars = closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(near.unionByName(stars).distinct(), "first-links")
    joined = materialise(components(links), "star-groups")
    grouped = sets.select("key", *[F.get("sketch", k).alias(f"s{k}") for k in range(SKETCH)]).join(joined, sets.key == joined.node, "left").drop("node")
    grouped = grouped.withColumn("group", F.coalesce("component", "key")).drop("component")
    known = materialise(shared.join(grouped, "key"), "grouped-prefixes")
    mixed = known.groupBy("token").agg(F.min("group").alias("_least"), F.max("group").alias("_most")).where("_least < _most").select("token")
    known_mixed = known.join(mixed, "token", "left_semi")
    left, right = known_mixed.alias("l"), known_mixed.alias("r")
    differ = sum((F.bit_count(col(f"l.s{k}").bitwiseXOR(col(f"r.s{k}"))) for k in range(SKETCH)), F.lit(0))
    total = col("l.n") + col("r.n")
    pairs = left.join(right, col("l.token") == col("r.token")).where(
        (col("l.key") < col("r.key")) & (col("l.group") != col("r.group")) & enough(col("l.n"), col("l.at"), col("r.n"), col("r.at"))
        & ((total - differ) / 2 >= threshold / (1 + threshold) * total - 1e-6)
    )
    more = verified(pairs.select(col("l.key").alias("a"), col("r.key").alias("b")).distinct(), "links")
    classes = components(links.unionByName(more))
    merged = least.join(classes, least.key == classes.node, "left").select("key", "least", F.coalesce("component", "key").alias("class"))
    smallest = merged.groupBy("class").agg(F.min("least").alias("component_id"))
    found = rows.join(merged.join(smallest, "class").select("key", "component_id"), "key").select("doc_id", "component_id")
    found = materialise(found, "similar-groups")
    for table in (sets, shared, known, near):
        discard(table)
    return found


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row of each group: that of the smallest id. Rows with a null id stay; of rows that repeat the smallest id, that whose text has the smallest hash stays."""
    classes = similar_groups(df, id_col, text_col, threshold, width)
    keep = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    n, different = keep.agg(F.count("_kept"), F.count_distinct("_kept")).first()
    kept = df.join(keep.distinct(), df[id_col] == F.col("_kept"), "left_semi")
    if n > different:
        kept = one_row_each(kept, id_col, text_col)
    return kept.unionByName(df.where(F.col(id_col).isNull()))
