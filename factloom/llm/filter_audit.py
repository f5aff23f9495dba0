"""How filters interact: for every order of them, what each removes, what it only seems to, and what good it costs.

A document is reduced to a mask of the filters it fails. Four look at its text
alone; the fifth asks whether a smaller id has the same text, which is found by routing:
texts go to the partition that their xxhash names, where a chain of the
texts of one hash is kept, each whole and with its smallest id. Whatever isn't
smallest is emitted as it is met. Copies are folded where they are read, by the same
chains, so a text is shuffled once for each stretch of input that holds it, however many copies there are.

Masks are then counted by part, good and toxic, as vectors that are merged by key. All orders and
steps are sums over such a vector.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import whole_text

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of distinct texts that a task folds before it sends them on, and that a routed partition is to hold.
FOLD_BYTES, ROUTED_BYTES = 16 << 20, 32 << 20
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")


def text_mask(raw: bytes) -> int:
    """The bits of the filters A to D that a text (UTF-8) fails: few words, repeated words, capitals, marks."""
    words = raw.split()  # at ASCII's white space
    few = len(words) < 50
    repeated = 100 * len(set(words)) < 65 * len(words)
    points = len(raw.decode()) if not raw.isascii() else len(raw)
    loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 5 * points
    marked = _MARKS.search(raw) is not None
    return few | repeated << 1 | loud << 2 | marked << 3


class Chains:
    """Texts by fingerprint: for each text its mask, the smallest id met and that id's rows by part."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def meet(self, print_: int, raw: bytes, doc_id: int, parts: dict[str, int], mask: int | None = None) -> Iterator[tuple]:
        """Take rows of a text in; the rows (id, mask, parts) that now have a smaller id beside them come out."""
        chain = self.chains.setdefault(print_, [])
        for entry in chain:
            if entry[0] == raw:
                break
        else:
            chain.append([raw, text_mask(raw) if mask is None else mask, doc_id, dict(parts)])
            self.held += len(raw)
            return
        if doc_id == entry[2]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
        elif doc_id > entry[2]:
            yield doc_id, entry[1] | COPY, parts
        else:
            yield entry[2], entry[1] | COPY, entry[3]
            entry[2], entry[3] = doc_id, dict(parts)

    def drain(self) -> Iterator[tuple[int, list]]:
        for print_, chain in self.chains.items():
            for entry in chain:
                yield print_, entry
        self.chains, self.held = {}, 0


def _folding(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(route, row): texts with their smallest id go by fingerprint, all other rows wherever it is even."""
    chains, turn = Chains(), 0
    for doc_id, part, text in rows:
        raw = text.encode()
        if doc_id is None:
            out = [(None, text_mask(raw), {part: 1})]
        else:
            out = chains.meet(xxhash.xxh64_intdigest(raw), raw, doc_id, {part: 1})
        for row in out:
            turn += 1
            yield turn, row
        if chains.held >= FOLD_BYTES:
            yield from ((print_, (doc, mask, parts, raw)) for print_, (raw, mask, doc, parts) in chains.drain())
    yield from ((print_, (doc, mask, parts, raw)) for print_, (raw, mask, doc, parts) in chains.drain())


def _settling(routed: Iterable) -> Iterator[tuple]:
    """(id, mask, parts) of all rows, from the routed ones of a partition."""
    chains = Chains()
    for print_, row in routed:
        if len(row) == 3:
            yield row
        else:
            doc_id, mask, parts, raw = row
            yield from chains.meet(print_, raw, doc_id, parts, mask)
    yield from ((doc_id, mask, parts) for _, (_, mask, doc_id, parts) in chains.drain())


def masked_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> RDD:
    """(id, mask, {part: rows}) such that each row of the table is counted once."""
    text = whole_text(text_col)
    rows = df.select(F.col(id_col).cast("long"), whole_text(part_col), text)
    held = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    routes = max(df.sparkSession.sparkContext.defaultParallelism, -(-held // ROUTED_BYTES))
    return rows.rdd.mapPartitions(_folding).partitionBy(routes, lambda key: key).mapPartitions(_settling)


def _by_id(row: tuple) -> tuple:
    doc_id, mask, parts = row
    return doc_id, (0, {(part, mask): n for part, n in parts.items()})


def _both(a: tuple, b: tuple) -> tuple:
    counts = Counter(a[1])
    counts.update(b[1])
    return a[0] | b[0], dict(counts)


def _by_part(row: tuple) -> Iterator[tuple]:
    _, (flags, counts) = row
    for (part, mask), n in counts.items():
        yield part, (mask, flags, n)


def _vector(value: tuple) -> np.ndarray:
    return _counted(np.zeros((1 << len(FILTERS), 4), np.int64), value)


def _counted(vector: np.ndarray, value: tuple) -> np.ndarray:
    mask, flags, n = value
    vector[mask, flags] += n
    return vector


def mask_counts(rows: RDD, labels: DataFrame, id_col: str = "doc_id") -> RDD:
    """(part, vector): documents by mask (32) and flags (bit 0: labelled good, bit 1: labelled toxic)."""
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    flagged = labels.where(F.col(id_col).isNotNull() & (good | toxic)).select(F.col(id_col).cast("long"), good.cast("int") + 2 * toxic.cast("int"))
    told = flagged.rdd.map(lambda r: (r[0], (r[1], {})))
    same = lambda x: x
    ids = rows.map(_by_id).union(told).combineByKey(same, _both, _both, rows.getNumPartitions())
    return ids.flatMap(_by_part).combineByKey(_vector, _counted, np.add, max(1, min(64, rows.getNumPartitions())), lambda part: zlib.crc32(part.encode()))


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def _report(row: tuple) -> Iterator[tuple]:
    part, vector = row
    n, masks = vector.sum(axis=1), np.arange(len(vector))
    good, toxic = vector[:, 1] + vector[:, 3], vector[:, 2] + vector[:, 3]
    found, shapley = [], Counter()
    for order in permutations(FILTERS):
        gone = np.zeros(len(masks), bool)
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = (masks & bit) > 0
            here = fails & ~gone
            redundant = int(n[fails & gone].sum())
            gone = gone | fails
            removed = int(n[here].sum())
            shapley[name] += removed
            found.append((name, ["".join(order), step, int(n[~gone].sum()), removed, redundant, int(n[bit]), int(good[here].sum()), int(toxic[here].sum())]))
    for name, values in found:
        yield (part, *values, shapley[name])


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """REPORT: a row for each part, order of the five filters and step of it.

    A null part is the empty string, a null text the empty one. A null id has no
    smaller one and is none, so such rows are never copies, nor labelled. Rows that repeat an
    id and a text are counted each. A document is good (toxic) if any label row of its
    id says so. Columns beyond those named aren't read. An empty table has no part.
    """
    rows = mask_counts(masked_rows(df, id_col, text_col, part_col), labels).flatMap(_report)
    return df.sparkSession.createDataFrame(rows, REPORT, verifySchema=False)
