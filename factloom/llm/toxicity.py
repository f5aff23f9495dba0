"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The labelled examples' words (A-Z lower-cased), all of them, are the vocabulary, as
hashes; so are those prefixes of longer words that go with the label beyond chance,
by a likelihood ratio test at a level corrected for the number of terms tested.
A document's vector has (1 + ln tf) * idf for each vocabulary term of its whole
text; document frequencies count all documents. A term that passes the
test weighs ``LEAN`` times as much, so that a few words of abuse in a long text bear on
who its neighbours are; every other term keeps its weight, so every text that
shares a word with any example has neighbours.

The index holds the examples' postings in blocks of similar examples. For a query, the
best possible cosine of each block is bounded by its terms' largest weights there; blocks
are scored from the best bound down, and none is skipped that could still hold one of
the k nearest. Examples tied with the k-th count as well, so ids decide nothing.

A score is the neighbours' labels weighted by closeness, calibrated by an isotonic
fit of the same vote for each example among the others. A text without a
vocabulary term has cosine 0 with every example; its score is the rate of the
label among the examples.

Labels are learnt from a bounded sample (``MOST_EXAMPLES`` of the smallest hashes of
ids, whole texts of ``MOST_BYTES`` together), so vocabulary and index don't grow with the
corpus and are small enough to go to every executor; all documents are counted and scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import discard, drop_what_is_kept, give_back, materialise
from factloom.llm.wordhash import hashed_prefixes, text_slices

#: Labelled examples learnt from, and bytes of their texts, at most; both bound what is broadcast.
MOST_EXAMPLES, MOST_BYTES = 4096, 64 << 20
PREFIXES = (4, 5, 6, 7)
NEIGHBOURS, BLOCK = 5, 256
LEVEL, LEAN = 0.01, 40.0
FOLDS, HELD_OUT = 5, 0
#: Bytes of text whose words are hashed at once.
SLICE = 1 << 20
#: Added to a distance before it divides a vote.
NEAR = 0.05
#: (row, term) entries that are searched at once, and the number of blocks at which each round of a search begins.
ENTRIES, ROUNDS = 100_000, (0, 1, 3)
#: Cosines count to so many digits, which hides the order in which they were summed.
DIGITS = 9


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that is never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, whole, toxic, clean): examples of each kind that hold a word or a prefix, for each slice of rows (text, y)."""
    for batch in batches:
        for b in text_slices(batch, 0, SLICE):
            first, hashes = hashed_prefixes(b.column(0), PREFIXES)
            rows = np.repeat(np.repeat(np.arange(b.num_rows), np.diff(first)), hashes.shape[1])
            whole = np.tile(np.arange(hashes.shape[1]) == 0, len(hashes))
            terms = hashes.reshape(-1)
            order = np.lexsort((rows, terms))
            rows, terms, whole = rows[order], terms[order], whole[order]
            new = np.r_[True, (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])][: len(terms)] & (terms != 0)
            rows, terms, whole = rows[new], terms[new], whole[new]
            if not len(terms):
                continue
            toxic = np.asarray(b.column(1))[rows] == 1
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            a = np.add.reduceat(toxic.astype(np.int64), starts)
            n = np.diff(np.r_[starts, len(terms)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms[starts].view(np.int64)), pa.array(whole[starts]), pa.array(a), pa.array(n - a)],
                names=["term", "whole", "toxic", "clean"],
            )


def _hits(vocabulary: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in hashes, places in the sorted vocabulary) of those hashes that it holds."""
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == hashes)
    return hit, at[hit]


def _vectors(shared: Broadcast):
    """For each row of (id, text) the vocabulary terms it holds and how often; words are numbered first, then prefixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_what_is_kept()
        words, prefixes = shared.value
        size = max(1, len(words) + len(prefixes))
        for batch in batches:
            for b in text_slices(batch, 1, SLICE):
                first, hashes = hashed_prefixes(b.column(1), PREFIXES if len(prefixes) else ())
                rows = np.repeat(np.arange(b.num_rows), np.diff(first))
                hit, at = _hits(words, np.ascontiguousarray(hashes[:, 0]))
                keys = [rows[hit] * size + at]
                for k in range(1, hashes.shape[1]):
                    hit, at = _hits(prefixes, np.ascontiguousarray(hashes[:, k]))
                    keys.append(rows[hit] * size + len(words) + at)
                key, counts = np.unique(np.concatenate(keys), return_counts=True)
                row, term = np.divmod(key, size)
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, counts))
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "terms", "counts"])

    return run


def chance_bar(tests: int, level: float = LEVEL) -> float:
    """The likelihood ratio that one of so many terms without any bearing passes with this probability."""
    p, low, high = level / max(1, tests), 0.0, 500.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return high


def _likelihood_ratio(toxic: int, clean: int) -> Column:
    a, c, n1, n0 = F.col("toxic").cast("double"), F.col("clean").cast("double"), float(toxic), float(clean)
    n = n1 + n0
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    held = a + c
    return 2 * (part(a, held * n1 / n) + part(c, held * n0 / n) + part(n1 - a, (n - held) * n1 / n) + part(n0 - c, (n - held) * n0 / n))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class BlockMaxIndex:
    """Exact nearest neighbours among unit vectors given as (terms, weights), by blocks of examples.

    Postings lie by term, then example. For each term and block there are the place of its
    postings and their largest weight. What many examples of a block hold lies there as a
    dense row instead. Queries are searched in groups: in each round every query scores the
    blocks with its next best bounds, and those that could no longer change its result are left out.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block, self.n_terms = len(vectors), block, n_terms
        term = np.concatenate([t for t, _ in vectors] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        order = np.lexsort((example, term))
        self.postings = term[order].astype(np.int32), example[order].astype(np.int32), weight[order]
        self._lay_out()

    def _lay_out(self) -> None:
        term, example, weight = self.postings
        self.n_blocks = max(1, -(-self.n // self.block))
        cell = term.astype(np.int64) * self.n_blocks + example // self.block
        size = np.bincount(cell, minlength=self.n_terms * self.n_blocks).astype(np.int32)
        self.most = np.zeros((self.n_terms, self.n_blocks), np.float32)
        np.maximum.at(self.most.reshape(-1), cell, np.nextafter(weight.astype(np.float32), np.float32(2)))
        dense = size >= max(2, self.block // 8)
        sparse = ~dense[cell]
        self.example, self.weight = example[sparse], weight[sparse]
        self.place = np.zeros(len(size) + 1, np.int32)
        np.cumsum(np.where(dense, np.int32(0), size), out=self.place[1:])
        dense_term, dense_block = np.divmod(np.flatnonzero(dense), self.n_blocks)
        self.dense_terms = np.unique(dense_term)
        row = np.searchsorted(self.dense_terms, dense_term)
        self.rows = [row[dense_block == b] for b in range(self.n_blocks)]
        self.tables = [np.zeros((len(r), self.block)) for r in self.rows]
        at = np.searchsorted(self.dense_terms, term[~sparse])
        e, w = example[~sparse], weight[~sparse]
        for b in range(self.n_blocks):
            own = e // self.block == b
            self.tables[b][np.searchsorted(self.rows[b], at[own]), e[own] % self.block] = w[own]

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("n", "block", "n_terms", "postings")}  # the rest is made again where it arrives

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._lay_out()
        del self.postings

    def _scores(self, query: np.ndarray, block: np.ndarray, term: np.ndarray, weight: np.ndarray, first: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Cosines (pairs x examples of the block) of pairs of a query and a block."""
        entry = _spread(first[query], sizes[query])
        cells = term[entry] * self.n_blocks + np.repeat(block, sizes[query])
        start = self.place[cells].astype(np.int64)
        size = self.place[cells + 1] - start
        some = np.flatnonzero(size)
        pair = np.repeat(np.arange(len(query)), sizes[query])[some]
        start, size = start[some], size[some]
        at = _spread(start, size)
        slot = np.repeat(pair * self.block, size) + self.example[at] % self.block
        sums = np.bincount(slot, np.repeat(weight[entry[some]], size) * self.weight[at], len(query) * self.block).astype(float).reshape(-1, self.block)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(self.n_blocks + 1))
        for b in range(self.n_blocks):
            own = order[cuts[b]:cuts[b + 1]]
            if len(own) and len(self.rows[b]):
                sums[own] += dense[np.ix_(query[own], self.rows[b])] @ self.tables[b]
        return np.round(sums, DIGITS)

    def search(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, entries ends[i] to ends[i + 1], the (examples, cosines) of all whose cosine is above 0 and at
        least the k-th best; ``skip`` names an example that a query leaves out. Best first, ties by example."""
        out = [(np.empty(0, np.int64), np.empty(0))] * (len(ends) - 1)
        sizes = np.diff(ends)
        asked = np.flatnonzero(sizes)
        if not self.n or not len(asked):
            return out
        groups = np.cumsum(sizes[asked]) // ENTRIES
        for own in np.split(asked, np.flatnonzero(np.diff(groups)) + 1):
            found = self._search(ends[own].astype(np.int64), sizes[own].astype(np.int64), terms, weights, k, None if skip is None else skip[own])
            for i, x in zip(own.tolist(), found):
                out[i] = x
        return out

    def _search(self, begin, sizes, terms, weights, k, skip) -> list[tuple[np.ndarray, np.ndarray]]:
        n = len(sizes)
        at = _spread(begin, sizes)
        term, weight = terms[at].astype(np.int64), weights[at]
        first = np.cumsum(sizes) - sizes
        bound = np.add.reduceat(weight.astype(np.float32)[:, None] * self.most[term], first, axis=0) * np.float32(1 + 1e-4)
        order = np.argsort(-bound, axis=1, kind="stable")
        hit, to = _hits(self.dense_terms, term)
        dense = np.zeros((n, len(self.dense_terms)))
        dense[np.repeat(np.arange(n), sizes)[hit], to] = weight[hit]
        kth = np.zeros(n)
        found = np.empty((3, 0))  # query, example, cosine
        for lo, hi in zip(ROUNDS, (*ROUNDS[1:], self.n_blocks)):
            query, c = np.nonzero((np.take_along_axis(bound, order[:, lo:hi], 1) > 0) & (np.take_along_axis(bound, order[:, lo:hi], 1) >= kth[:, None]))
            if not len(query):
                break
            block = order[query, lo + c]
            chunks = np.cumsum(sizes[query]) // ENTRIES
            parts = [found]
            for own in np.split(np.arange(len(query)), np.flatnonzero(np.diff(chunks)) + 1):
                q, b = query[own], block[own]
                sums = self._scores(q, b, term, weight, first, sizes, dense)
                if skip is not None:
                    self_ = np.flatnonzero((skip[q] >= 0) & (skip[q] // self.block == b))
                    sums[self_, skip[q][self_] % self.block] = 0
                low = np.partition(sums, self.block - k, axis=1)[:, self.block - k] if self.block > k else np.zeros(len(q))
                i, j = np.nonzero((sums > 0) & (sums >= np.maximum(low, kth[q])[:, None]))
                parts.append(np.stack([q[i], b[i] * self.block + j, sums[i, j]]))
            found = np.concatenate(parts, 1)
            found = found[:, np.lexsort((found[1], -found[2], found[0]))]
            cuts = np.searchsorted(found[0], np.arange(n + 1))
            full = np.flatnonzero(np.diff(cuts) >= k)
            kth[full] = found[2, cuts[full] + k - 1]
            found = found[:, found[2] >= kth[found[0].astype(np.int64)]]
        cuts = np.searchsorted(found[0], np.arange(n + 1))
        example = found[1].astype(np.int64)
        return [(example[x:y], found[2, x:y]) for x, y in zip(cuts, cuts[1:])]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, example) of one query, best first, ties by example."""
        (found, scores), = self.search(np.array([0, len(terms)]), np.asarray(terms), np.asarray(weights), k, np.array([skip]))
        return list(zip(scores.tolist(), found.tolist()))[:k]


def _by_likeness(vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, clusters: int, dimensions: int = 256, rounds: int = 8) -> np.ndarray:
    """An order of vectors in which like ones stand together, by spherical k-means over the heaviest terms; it bears on the cost alone."""
    if not vectors:
        return np.empty(0, np.int64)
    term, weight = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
    row = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    mass = np.bincount(term, weight * weight, n_terms)
    heavy = np.sort(np.argsort(-mass, kind="stable")[:dimensions])
    hit, at = _hits(heavy, term)
    x = np.zeros((len(vectors), len(heavy)))
    x[row[hit], at] = weight[hit]
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return np.lexsort((np.arange(len(x)), (x @ centres.T).argmax(1)))


class Scorer:
    """What goes to the executors: term weights, the index and labels."""

    def __init__(self, weight_of: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray, int]], k: int = NEIGHBOURS):
        """examples: (key, doc_id, terms, counts, label); those without terms only count for the rate."""
        self.weight_of, self.k = weight_of, k
        labels = [y for *_, y in examples]
        self.rate = (sum(labels) + 1) / (len(labels) + 4)
        full = [(key, i, self._unit(t, c), y) for key, i, t, c, y in examples if len(t)]
        likely = _by_likeness([v for _, _, v, _ in full], len(weight_of), max(1, len(full) // BLOCK))
        full = [full[j] for j in likely]
        self.place_of = {key: j for j, (key, *_) in enumerate(full)}
        self.ids, self.labels = [i for _, i, _, _ in full], np.array([y for *_, y in full], float)
        self.index = BlockMaxIndex([v for _, _, v, _ in full], len(weight_of))

    def _unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight_of[terms]
        return terms, w / math.sqrt(float((w * w).sum()))

    def neighbours(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, keys: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each row of vectors; ``keys`` names the examples that the rows are themselves, which are left out."""
        w = (1 + np.log(counts)) * self.weight_of[terms]
        sizes = np.diff(ends)
        length = np.ones(len(sizes))
        some = np.flatnonzero(sizes)
        if len(some):
            length[some] = np.sqrt(np.add.reduceat(w * w, ends[some]))
        own = None if keys is None else np.array([self.place_of.get(x, -1) for x in keys], np.int64)
        return self.index.search(ends, terms, w / np.repeat(length, sizes), self.k, own)

    def vote(self, found: tuple[np.ndarray, np.ndarray]) -> float | None:
        """The neighbours' mean label, the closer the heavier."""
        examples, cosines = found
        if not len(examples):
            return None
        w = 1 / (np.maximum(0.0, 1 - cosines) + NEAR)
        return float((w * self.labels[examples]).sum() / w.sum())

    def score(self, found: tuple[np.ndarray, np.ndarray], steps: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[dict]]:
        """The calibrated vote and its evidence; ``steps`` is what ``isotonic`` has fitted."""
        vote = self.vote(found)
        if vote is None:
            return self.rate, []
        value = float(np.interp(vote, *steps)) if len(steps[0]) else vote
        return value, [{"doc_id": self.ids[i], "cosine": s, "label": int(self.labels[i])} for i, s in zip(found[0].tolist(), found[1].tolist())]


def isotonic(pairs: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the rising rates of the label that fit them best, each pool with half an example of either label more."""
    pools: list[list[float]] = []  # lowest vote, highest vote, label sum, number
    for v, same in groupby(sorted(pairs), lambda p: p[0]):  # equal votes are one from the start, whatever their labels' order
        ys = [y for _, y in same]
        pools.append([v, v, sum(ys), len(ys)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low, high = pools[-2], pools.pop()
            pools[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    x = [v for p in pools for v in p[:2]]
    rates = [(p[2] + 0.5) / (p[3] + 1) for p in pools]
    return np.array(x), np.maximum.accumulate(np.array([r for r in rates for _ in range(2)]))


EVIDENCE = "array<struct<doc_id:long,cosine:double,label:int>>"


def _rows_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, terms, counts) of a batch's second and third column."""
    lists = b.column(1)
    ends = np.asarray(lists.offsets).astype(np.int64)
    x, y = int(ends[0]), int(ends[-1])
    return ends - x, np.asarray(lists.values)[x:y], np.asarray(b.column(2).values)[x:y]


def _scoring(shared: Broadcast, steps: tuple[np.ndarray, np.ndarray]):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                scores, evidence = zip(*(scorer.score(x, steps) for x in scorer.neighbours(*_rows_of(b))))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"]
                )
        give_back()

    return run


def _voting(shared: Broadcast):
    """(vote, y) of the examples (key, terms, counts, y), each among the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in batches:
            votes = [scorer.vote(x) for x in scorer.neighbours(*_rows_of(b), keys=b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(3)], names=["vote", "y"])

    return run


def _sample(labels: DataFrame, source: DataFrame) -> DataFrame:
    """(key, doc_id, text, y) of the examples: distinct texts, ``key`` is their hash."""
    given = labels.where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_EXAMPLES)
    texts = source.where("text is not null").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("y").alias("y"))
    texts = materialise(texts, "labelled")
    so_far = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("doc_id"), "key").rowsBetween(W.unboundedPreceding, 0))
    within = texts.select("key", so_far.alias("bytes")).where(F.col("bytes") <= MOST_BYTES).select("key")
    return texts.join(F.broadcast(within), "key", "left_semi").select("key", "doc_id", "text", F.when(F.col("y") == 1, 1).otherwise(0).alias("y"))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each row, from its whole text alone.

    ``evidence`` has the neighbours that voted, nearest first. ``learn_from`` has
    the labelled documents' texts where those aren't in ``df`` (default: ``df``).
    Null texts count as empty; null ids are scored. Labels with a null id or
    label are left out, and of several for one id the highest counts, as it does
    for equal texts, which are one example. Equal texts have equal scores.
    Without any labels every score is 1/4, so nothing is rejected. Other columns
    aren't read.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = docs if learn_from is None else learn_from.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = _sample(labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")), source)
    toxic, clean = examples.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.when(F.col("y") == 0, 1))).first()

    counts = examples.select("text", "y").mapInArrow(_term_counts, "term long, whole boolean, toxic long, clean long")
    counts = materialise(counts.groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "terms")
    leaning = F.lit(False)
    if toxic and clean:
        bar = chance_bar(counts.where("toxic + clean >= 3").count())
        leaning = (_likelihood_ratio(toxic, clean) > bar) & (F.col("toxic") * clean > F.col("clean") * toxic) & (F.col("toxic") + F.col("clean") >= 3)
    terms = counts.withColumn("leans", leaning).where("whole or leans").select("term", "whole", "leans").toArrow()  # of the bounded sample
    term, whole, leans = (np.asarray(terms.column(c)) for c in ("term", "whole", "leans"))
    order = np.lexsort((term.astype(np.int64).view(np.uint64), ~whole.astype(bool)))
    term, whole, leans = term.astype(np.int64).view(np.uint64)[order], whole.astype(bool)[order], leans.astype(bool)[order]
    vocabulary = context.broadcast((term[whole], term[~whole]))

    kinds = "doc_id long, terms array<int>, counts array<int>"
    vectors = materialise(docs.mapInArrow(_vectors(vocabulary), kinds), "term-vectors")
    total = vectors.count()
    held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each vocabulary term
    frequency = np.zeros(len(term))
    frequency[np.asarray(held.column("t")).astype(np.int64)] = np.asarray(held.column("n"))
    weight_of = (np.log((1 + total) / (1 + frequency)) + 1) * np.where(leans, LEAN, 1.0)

    own = examples.select(F.col("key").alias("doc_id"), "text").mapInArrow(_vectors(vocabulary), kinds).withColumnRenamed("doc_id", "key")
    own = materialise(own.join(F.broadcast(examples.select("key", "doc_id", "y")), "key"), "example-vectors")
    table = own.select("key", "terms", "counts", "doc_id", "y").orderBy("key").toArrow().combine_chunks()
    learnt = [
        (b.column(0)[i].as_py(), b.column(3)[i].as_py(), terms[x:y], counts[x:y], b.column(4)[i].as_py())
        for b in table.to_batches() for ends, terms, counts in [_rows_of(b)] for i, (x, y) in enumerate(zip(ends, ends[1:]))
    ]
    scorer = context.broadcast(Scorer(weight_of, learnt))
    votes = own.select("key", "terms", "counts", "y").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_voting(scorer), "vote double, y int")
    steps = isotonic([(r.vote, r.y) for r in votes.where("vote is not null").collect()])  # a row for each example

    scored = materialise(vectors.mapInArrow(_scoring(scorer, steps), f"doc_id long, score double, evidence {EVIDENCE}"), "scores")
    for shared in (vocabulary, scorer):
        shared.destroy()
    for table in (vectors, own, counts):
        discard(table)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows whose document isn't predicted toxic; of rows that share an id, one toxic text rejects all. Null ids stay."""
    bad = score_toxicity(df, labels, id_col, **names).where("predicted = 1").select(F.col("doc_id").alias("_toxic_id")).distinct()
    return df.join(bad, df[id_col] == F.col("_toxic_id"), "left_anti")
