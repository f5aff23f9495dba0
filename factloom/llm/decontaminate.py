"""Benchmark passages in training documents: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Every n-gram of words of the test items is a seed (n is five, less for
   short items). While the items are few (``PART_BYTES``) their seeds are broadcast as
   sorted hashes and one pass over the whole texts finds the seeds' places. Beyond
   that a bit array of fixed size goes in their stead: the n-grams of texts whose bit is
   set are joined with the seeds as rows, and a second pass cuts out the
   passages, however large the items are together.
2. Places of one item near each other in one document are one passage, kept as
   the hashes of its words with a margin on both sides. Equal passages are
   aligned once, however many documents share them.
3. A seed's document frequency over all documents says how rare it is. Passages
   with rare seeds and passages with common ones alone are both verified, the
   latter so that a leak into a great many documents isn't lost; what a
   result's rarest seed is worth is returned with it.
4. Smith-Waterman over words (match 2, mismatch -1, gap -2), divided by twice
   the item's words, is the score; from ``threshold`` on the document holds
   the item.

With a threshold of 0.8 an alignment of L words may lose 0.4 L of its 2 L points.
An inserted word breaks a run for 2, a changed or lost one for 3 or 4. Whatever is
spent on these, some run of the item is left that is no shorter than its words
over its pieces. Seeds are no longer than the least of that, so no document at the
threshold is without a seed, and windows of twice the item's length on both sides
hold the whole alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_what_is_kept, give_back, materialise, small_table
from factloom.llm.wordhash import hashed_words, ngrams, text_slices

SEED_WORDS, THRESHOLD = 5, 0.8
MATCH, MISMATCH, GAP = 2, -1, -2
#: Bytes of test items that are broadcast; more are joined as rows, behind a filter of so many bits (a power of two).
PART_BYTES, FILTER_BITS = 8 << 20, 1 << 26
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 20


def seed_length(words: int, threshold: float = THRESHOLD) -> int:
    """The longest run of words that any document at the threshold must share with an item, at most SEED_WORDS."""
    points = MATCH * words * (1 - threshold) + 1e-9
    shortest = SEED_WORDS
    for changed in range(int(points / (MATCH - MISMATCH)) + 1):
        breaks = changed + int((points - (MATCH - MISMATCH) * changed) / -GAP)
        shortest = min(shortest, -(-(words - changed) // (breaks + 1)))
    return max(1, shortest)


class Items:
    """The test items on an executor: their words, and their seeds by length, sorted."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray, threshold: float):
        self.ids, self.first, self.words = ids, first, words
        by: dict[int, list[np.ndarray]] = {}
        for k in range(len(ids)):
            own = words[first[k]:first[k + 1]]
            if len(own):
                n = seed_length(len(own), threshold)
                grams = np.unique(ngrams(own, n))
                by.setdefault(n, []).append(np.stack([grams, np.full(len(grams), k, np.uint64)]))
        self.seeds = {}
        for n, parts in by.items():
            g, item = np.concatenate(parts, 1)
            order = np.lexsort((item, g))
            self.seeds[n] = g[order], item[order].astype(np.int64)

    def places(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position, item, seed) of every seed in a batch's words; doc numbers the words' documents."""
        out = []
        for n, (g, item) in self.seeds.items():
            grams = ngrams(words, n)
            if not len(grams):
                continue
            left = np.searchsorted(g, grams)
            hit = np.flatnonzero((g[np.minimum(left, len(g) - 1)] == grams) & (doc[:len(grams)] == doc[n - 1:]))
            if len(hit):
                lo = left[hit]
                times = np.searchsorted(g, grams[hit], "right") - lo
                pick = np.repeat(lo - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
                out.append((np.repeat(hit, times), item[pick], g[pick]))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64),) * 3


PASSAGES = "doc_id long, item long, words array<long>, seeds array<long>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate(parts).view(np.int64)))


def _cut(ids: pa.Array, first: np.ndarray, words: np.ndarray, doc: np.ndarray, at: np.ndarray, item: np.ndarray, length: np.ndarray, seed: np.ndarray) -> pa.RecordBatch:
    """The passages around places of seeds: of document ``doc``, word ``at``, for an item of so many words.

    Words of document d begin at first[d]; ``at`` counts from the batch's first word.
    """
    order = np.lexsort((at, item, doc))
    doc, at, item, length, seed = (x[order] for x in (doc, at, item, length, seed))
    # a place goes on with a passage while it is within the item's length of the place before
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) > length[1:])])
    ends = np.r_[starts[1:], len(at)]
    d, own = doc[starts], length[starts]
    begin = np.maximum(at[starts] - 2 * own, first[d])
    stop = np.minimum(at[ends - 1] + 2 * own + SEED_WORDS, first[d + 1])
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(d)), pa.array(item[starts]),
            _lists([words[x:y] for x, y in zip(begin, stop)]), _lists([np.unique(seed[x:y]) for x, y in zip(starts, ends)]),
        ],
        names=["doc_id", "item", "words", "seeds"],
    )


def _passages(items: Items):
    lengths = np.diff(items.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_what_is_kept()
        for batch in batches:
            for b in text_slices(batch, 1, SLICE):
                first, words = hashed_words(b.column(1))
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                at, item, seed = items.places(words, doc)
                if len(at):
                    yield _cut(b.column(0), first, words, doc[at], at, item, lengths[item], seed)
        give_back()

    return run


# -- items beyond the bound: their words and seeds stay rows --------------------


def _item_rows(threshold: float):
    """(item_id, item, words, n, seeds) of rows (item_id, text); item is a number of its own for each text of an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, words = hashed_words(b.column(2))
            own = [words[x:y] for x, y in zip(first, first[1:])]
            n = [seed_length(len(w), threshold) if len(w) else 1 for w in own]
            seeds = [np.unique(ngrams(w, k)) for w, k in zip(own, n)]
            if own:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(own), pa.array(n, pa.int32()), _lists(seeds)], names=["item_id", "item", "words", "n", "seeds"])

    return run


def _possible(bits: np.ndarray, lengths: list[int]):
    """(doc_id, copy, n, at, seed): the n-grams of rows (doc_id, copy, text) whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, 2, SLICE):
                first, words = hashed_words(b.column(2))
                doc = np.repeat(np.arange(b.num_rows), np.diff(first))
                for n in lengths:
                    grams = ngrams(words, n)
                    place = grams & np.uint64(FILTER_BITS - 1)
                    hit = np.flatnonzero((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool) & (doc[:len(grams)] == doc[n - 1:]))
                    if len(hit):
                        d = pa.array(doc[hit])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(d), b.column(1).take(d), pa.array(np.full(len(hit), n, np.int32)), pa.array(hit - first[doc[hit]]), pa.array(grams[hit].view(np.int64))],
                            names=["doc_id", "copy", "n", "at", "seed"],
                        )

    return run


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of rows (doc_id, text, places array<struct<item, length, at, seed>>)."""
    for batch in batches:
        for b in text_slices(batch, 1, SLICE):
            first, words = hashed_words(b.column(1))
            places = b.column(2)
            fields = places.flatten()
            item, length, at, seed = (np.asarray(fields.field(k)).astype(np.int64) for k in range(4))
            doc = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets)))
            if len(at):
                yield _cut(b.column(0), first, words, doc, at + first[doc], item, length, seed.view(np.uint64))


def _joined_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    seeds = items.select("item", "n", F.size("words").alias("length"), F.explode("seeds").alias("seed"))
    lengths = [r.n for r in seeds.select("n").distinct().collect()]  # SEED_WORDS at most
    place = F.col("seed").bitwiseAND(FILTER_BITS - 1)
    words = seeds.select(F.shiftrightunsigned(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[np.asarray(table.column("word")).astype(np.int64)] = np.asarray(table.column("bits")).astype(np.int64).view(np.uint64)
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("copy"), "text").distinct()
    found = texts.mapInArrow(_possible(bits, lengths), "doc_id long, copy long, n int, at long, seed long")
    places = found.join(seeds, ["n", "seed"]).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("item", F.col("length").cast("long").alias("length"), "at", "seed")).alias("places"))
    places = places.withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    both = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")))
    return both.select("doc_id", "text", "places").mapInArrow(_cutting, PASSAGES)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two arrays of word hashes, a row at a time.

    Within a row a gap in b is a running maximum: subtracting the gap's cost a
    cell turns the recurrence into one accumulated maximum.
    """
    if not len(a) or not len(b):
        return 0
    above = np.zeros(len(b) + 1, np.int64)
    slope = -GAP * np.arange(len(b) + 1)
    best = 0
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        best = max(best, int(row.max()))
        above = row
    return best


ALIGNED = "item long, w1 long, w2 long, score double"


def _score(own: np.ndarray, text: np.ndarray, threshold: float) -> float:
    """The share of an item that a passage holds, 0 where words in common, an upper bound of the matches, are too few."""
    return smith_waterman(own, text) / (MATCH * len(own)) if np.isin(own, text).sum() >= threshold * len(own) else 0.0


def _aligned(words_of, threshold: float):
    """The passages (item, w1, w2, words, ...) that reach the threshold; ``words_of`` tells a row's item's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [_score(words_of(b, i), np.asarray(words.values).view(np.uint64), threshold) for i, words in enumerate(b.column(3))]
            scores = np.array(scores, float)
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), pa.array(scores)], names=["item", "w1", "w2", "score"]).filter(pa.array(scores >= threshold))
            if out.num_rows:
                yield out

    return run


def _load(rows: DataFrame, threshold: float) -> tuple[Items, list[int]]:
    table = rows.orderBy("i", "t").toArrow()
    first, words = hashed_words(table.column("t").combine_chunks() if table.num_rows else pa.array([], pa.string()))
    ids = table.column("i").to_pylist()
    return Items(np.arange(len(ids)), first, words, threshold), ids


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, rarest_seed_docs): each document that holds an item, and the item.

    Only documents that hold an item have rows. Rows that repeat a document id
    are one document, whose best passage counts; items that repeat an id, too.
    Null ids of documents are returned as null; null or wordless texts and items
    match nothing, and null item ids are left out. Other columns aren't read.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"))
    items = items.where("i is not null and t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 8), F.lit(0))).first()[0]
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if size <= PART_BYTES:
        own, ids = _load(items, threshold)
        words_of = lambda b, i: own.words[own.first[b.column(0)[i].as_py()]:own.first[b.column(0)[i].as_py() + 1]]
        aligned = lambda distinct: distinct.mapInArrow(_aligned(words_of, threshold), ALIGNED)
        found = _leaks_of(docs.mapInArrow(_passages(own), PASSAGES), aligned)
        named = F.broadcast(small_table(spark, list(enumerate(ids)), "item long, item_id long"))
    else:
        rows = items.select("i", F.xxhash64("i", "t").alias("item"), "t").mapInArrow(_item_rows(threshold), "item_id long, item long, words array<long>, n int, seeds array<long>")
        rows = materialise(rows.where(F.size("words") > 0), "items")
        words_of = lambda b, i: np.asarray(b.column(4)[i].values).view(np.uint64)
        with_own = lambda distinct: distinct.join(rows.select("item", F.col("words").alias("own")), "item").select("item", "w1", "w2", "words", "own")
        found = _leaks_of(_joined_passages(docs, rows), lambda distinct: with_own(distinct).mapInArrow(_aligned(words_of, threshold), ALIGNED))
        named = rows.select("item", "item_id")
    return found.join(named, "item").groupBy("doc_id", "item_id").agg(
        F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"), F.min("rarest_seed_docs").alias("rarest_seed_docs")
    )


def _leaks_of(passages: DataFrame, align: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, item, score, n_seeds, rarest_seed_docs) of the passages; ``align`` scores distinct ones, (item, w1, w2, words)."""
    passages = materialise(passages.select("*", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(1), "words").alias("w2")), "passages")
    # a document counts once for a seed
    frequency = (
        passages.select("doc_id", F.explode("seeds").alias("seed")).groupBy("seed", "doc_id").agg(F.lit(1).alias("_one"))
        .groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    )
    distinct = passages.groupBy("item", "w1", "w2").agg(F.first("words").alias("words")).select("item", "w1", "w2", "words")
    aligned = materialise(align(distinct), "alignments")
    held = passages.join(aligned, ["item", "w1", "w2"]).select("doc_id", "item", "score", F.size("seeds").alias("n_seeds"), "seeds", "w1", "w2")
    rarest = (
        held.select("doc_id", "item", F.explode("seeds").alias("seed")).join(frequency, "seed")
        .groupBy("doc_id", "item").agg(F.min("n").alias("rarest_seed_docs"))
    )
    best = held.groupBy("doc_id", "item").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))
    same = best.doc_id.eqNullSafe(rarest.doc_id) & (best.item == rarest.item)
    return best.join(rarest, same).select(best.doc_id, best.item, "score", "n_seeds", "rarest_seed_docs")


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows without those whose document id holds an item; null ids stay."""
    leaks = find_leaks(df, benchmark, id_col, **names).select(F.col("doc_id").alias("_leak")).distinct()
    return df.join(leaks, df[id_col] == F.col("_leak"), "left_anti")
