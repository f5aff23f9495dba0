"""Packing of tokenized documents into sequences: a configuration linear program over the histogram of lengths.

A configuration is a multiset of piece lengths that fit in a sequence. The
program asks for the fewest configurations that cover the number of pieces of
each length. It has one row for each length, so its size doesn't depend on the
number of documents, and only the histogram is brought to the driver.

Multiplicative weights solve it: each round prices lengths by their weights, a
knapsack dynamic program over token counts finds the configuration worth most,
that configuration is used as often as its scarcest length allows, and the
weights of the lengths it covers fall. The value of the prices gives a lower
bound in each round. The amounts are scaled to the total length and rounded
down to whole sequences; what is left of the histogram is filled largest first,
each gap with the largest length that fits, again in whole amounts, so that each
step uses up a length. The result is a list of configurations with counts, of
bounded size. The k-th piece of a length then finds its sequence and its
place in it by a search in that list; k comes from a distributed numbering.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import give_back, materialise, small_table
from factloom.llm.tokenizing import tokenizer

CAPACITY, END_ID = 2048, 0
ROUNDS, RATE = 400, 0.25
#: Each length's pieces are numbered in independent parts: of LEAST_PART pieces up to FEW_PARTS of them, then of MOST_PART.
FEW_PARTS, LEAST_PART, MOST_PART = 32, 1024, 1_000_000


@dataclass
class Plan:
    """Configurations (pieces by falling length, how often), and a lower bound of the number of sequences."""

    capacity: int
    configurations: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    lower_bound: int = 0

    @property
    def n_sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def dearest(values: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The multiset of lengths (index of values; 0 is unused) of total length up to capacity whose values sum highest."""
    back = np.zeros(capacity + 1)  # back[capacity - c] is the best value of c, so that its slices run with the lengths
    choice = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = back[capacity - c + 1:] + values[1:c + 1]
        k = int(worth.argmax())
        if worth[k] > back[capacity - c + 1]:
            back[capacity - c], choice[c] = worth[k], k + 1
        else:
            back[capacity - c] = back[capacity - c + 1]
    used, c = Counter(), capacity
    while c > 0:
        if choice[c]:
            used[int(choice[c])] += 1
            c -= int(choice[c])
        else:
            c -= 1
    return float(back[0]), used


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """A plan that places exactly the histogram's pieces (length -> how many, lengths 1 to capacity)."""
    plan = Plan(capacity)
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {capacity}")
        left[length] = n
    area = int((left * np.arange(capacity + 1)).sum())
    whole = int(left[capacity])
    plan.lower_bound = -(-area // capacity)
    if whole:
        plan.configurations.append(((capacity,), whole))
        left[capacity] = 0
    demand = left.astype(float)
    has = demand > 0
    if has.any():
        lengths = np.arange(capacity + 1)
        log_weight = np.where(has, np.log(np.maximum(lengths, 1) * np.maximum(demand, 1)), -np.inf)
        amounts: Counter = Counter()
        for _ in range(rounds):
            weight = np.exp(log_weight - log_weight.max())
            prices = np.where(has, weight / np.maximum(demand, 1), 0.0)
            worth, used = dearest(prices, capacity)
            plan.lower_bound = max(plan.lower_bound, whole + int(np.ceil((prices * demand).sum() / worth - 1e-6)))
            share = min(demand[k] / n for k, n in used.items())
            amounts[tuple(sorted(used.elements(), reverse=True))] += share
            for k, n in used.items():
                log_weight[k] -= RATE * n * share / demand[k]
        scale = (demand * lengths).sum() / sum(sum(c) * x for c, x in amounts.items())
        for c, x in sorted(amounts.items(), key=lambda y: (-y[1], y[0])):
            own = Counter(c)
            n = min(int(x * scale), min(int(left[k]) // m for k, m in own.items()))
            if n:
                plan.configurations.append((c, n))
                for k, m in own.items():
                    left[k] -= m * n
    present = [int(k) for k in np.flatnonzero(left)]
    while present:
        room, own = capacity, Counter()
        while room:
            at = int(np.searchsorted(present, room, "right")) - 1
            while at >= 0 and own[present[at]] >= left[present[at]]:
                at -= 1
            if at < 0:
                break
            own[present[at]] += 1
            room -= present[at]
        n = min(int(left[k]) // m for k, m in own.items())
        plan.configurations.append((tuple(sorted(own.elements(), reverse=True)), n))
        for k, m in own.items():
            left[k] -= m * n
        present = [k for k in present if left[k]]
    return plan


class Places:
    """For each length, the runs of its pieces' numbers and where each run's pieces go."""

    def __init__(self, plan: Plan):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        seen: Counter = Counter()
        base = 0
        for pieces, n in plan.configurations:
            at = 0
            for length, times in Counter(pieces).items():
                runs.setdefault(length, []).append((seen[length], base, times, at))
                seen[length] += times * n
                at += length * times
            base += n
        self.runs = {k: np.array(v, np.int64).T for k, v in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces numbered rank, from 0, among those of their length."""
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for k in np.unique(length):
            own = length == k
            first, base, times, at = self.runs[int(k)]
            run = np.searchsorted(first, rank[own], "right") - 1
            inside = rank[own] - first[run]
            sequence[own] = base[run] + inside // times[run]
            offset[own] = at[run] + inside % times[run] * k
        return sequence, offset


PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def _cutting(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                rows = []
                texts = some.column(1).to_pylist()
                for doc_id, text, ids in zip(some.column(0).to_pylist(), texts, encode.many(texts)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    copy = zlib.crc32((text or "").encode())
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * x:4 * y]
                        rows.append((doc_id, copy, k, x, y - x, zlib.crc32(part), *([part] if with_ids else [])))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        give_back()

    return run


def pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' pieces; a document longer than a sequence is cut so that only its first piece is short."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_cutting(vocabulary, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else ""))


def _placing(places: Places, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            out = b.select(columns)
            yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of each piece.

    Null texts count as empty, so every row has a piece at least: its end id.
    Null ids are kept; rows that repeat an id are packed each on its own. Other
    columns aren't read. An empty table gives no piece. Sequences are filled
    from 0 without gaps.
    """
    cut = materialise(pieces(df, vocabulary, capacity, end_id, with_ids, id_col, text_col), "pieces")
    spark = df.sparkSession
    sizes = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
    dealt = [(r.length, max(min(FEW_PARTS, -(-r.n // LEAST_PART)), -(-r.n // MOST_PART))) for r in sizes]
    dealt = F.broadcast(small_table(spark, dealt, "length long, _parts int"))
    cut = cut.join(dealt, "length").withColumn("_part", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.col("_parts")).cast("int"))
    counts = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    sums = [(r.length, r._part, r.n) for r in counts.collect()]  # capacity x FEW_PARTS rows, and one for each MOST_PART pieces
    histogram: Counter = Counter()
    starts = []
    for length, part, n in sorted(sums):
        starts.append((length, part, histogram[length]))
        histogram[length] += n
    places = Places(plan_packing(dict(histogram), capacity))
    offsets = F.broadcast(small_table(spark, starts, "length long, _part int, _start long"))
    inside = W.partitionBy("length", "_part").orderBy("doc_id", "copy", "piece")
    ranked = (
        cut.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, ["length", "_part"])
        .withColumn("rank", (F.col("_k") + F.col("_start")).cast("long"))
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return ranked.select(*columns, "rank").mapInArrow(_placing(places, columns), kinds + ", sequence_id long, offset long")
