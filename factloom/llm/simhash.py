"""SimHash fingerprints and exact linking of those within two bits, by deletion variants.

Cut a 64-bit fingerprint in two segments: of two fingerprints that differ in at
most two bits, one segment differs in at most one. Each segment is indexed 32
times, with one bit position left open; segments that differ in at most one bit
meet under an equal key. A bucket is verified by opening one bit more:
in it the fingerprints are sorted with each further bit left open, and those
that are then equal differ in at most two bits, so all of such a run are linked.
No pair is ever listed; a bucket of m fingerprints costs m log m, and it yields
at most m - 1 links to smallest members. Equal fingerprints are one beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import similar
from factloom.llm.common import materialise, one_row_each
from factloom.llm.graph import components

SHINGLE_WORDS, SEED = 3, 42
HALF = 32


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned number; without words it is 0."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, and white space is ASCII's
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(words) - width + 1)
    firsts = starts[:n].tolist()
    lasts = (starts + lengths)[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # a very long text isn't held as bits all at once
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(firsts[k:k + (1 << 16)], lasts[k:k + (1 << 16)])], ">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.array([fingerprint(x or "") for x in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long). A null text is an empty one, whose fingerprint is 0."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _closed(x: np.ndarray, bit: int) -> np.ndarray:
    return x & ~np.uint64(1 << bit)


#: Rows of shared buckets that are linked in one go, and the numbers that may be kept between passes over a large bucket.
CHUNK_ROWS, KEPT_NUMBERS = 400_000, 40_000_000


def _runs(group: np.ndarray, fp: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, sizes): runs of rows of one bucket that are equal with one more bit left open."""
    def equal(rows: np.ndarray, masked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.lexsort((masked, group[rows]))
        g, m = group[rows][order], masked[order]
        starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        if (sizes > 1).any():
            kept = np.repeat(sizes > 1, sizes)
            sizes = sizes[sizes > 1]
            yield rows[order][kept], np.r_[0, np.cumsum(sizes)[:-1]], sizes

    closed = fp & ~(np.uint64(1) << code.astype(np.uint64))
    for low in (0, HALF):  # one bit of each segment
        rows = np.flatnonzero((code >= low) & (code < low + HALF))
        for bit in range(HALF - low, 2 * HALF - low) if len(rows) > 1 else ():
            yield from equal(rows, _closed(closed[rows], bit))
    for low in (0, HALF):  # two bits of one segment: the other is equal, and one of its keys is enough
        rows = np.flatnonzero(code == HALF - low)
        for i in range(low, low + HALF) if len(rows) > 1 else ():
            one = _closed(fp[rows], i)
            for j in range(i + 1, low + HALF):
                yield from equal(rows, _closed(one, j))


def _link(group: np.ndarray, fp: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rows (a, b): each member of a bucket that another is linked with, and the smallest member it reaches there."""
    order = np.argsort(fp.view(np.int64), kind="stable")
    group, fp, code = group[order], fp[order], code[order]
    label = np.arange(len(fp))
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = []
    moved, held = True, 0
    while moved:
        before, first = label.copy(), kept is not None and not held
        for run in _runs(group, fp, code) if first or kept is None else kept:
            rows, starts, sizes = run
            label[rows] = np.minimum(label[rows], np.repeat(np.minimum.reduceat(label[rows], starts), sizes))
            if first and kept is not None:
                kept.append(run)
                held += len(rows)
                kept = kept if held <= KEPT_NUMBERS else None
        label = label[label]
        moved = not np.array_equal(before, label)
    far = np.flatnonzero(label != np.arange(len(fp)))
    return np.unique(np.stack([fp[far].view(np.int64), fp[label[far]].view(np.int64)], 1), axis=0)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted; the last one of a batch may go on in the next. Buckets of one fingerprint are passed over."""
    held: list[list[np.ndarray]] = []  # the last bucket's parts, joined when it ends
    waiting: list[tuple[np.ndarray, ...]] = []
    number = 0

    def linked() -> pa.RecordBatch:
        group, fp, code = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        pairs = _link(group, fp.view(np.uint64), code)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def whole(code: np.ndarray, key: np.ndarray, fp: np.ndarray) -> None:
        nonlocal number
        same = (code[1:] == code[:-1]) & (key[1:] == key[:-1])
        several = np.r_[False, same] | np.r_[same, False]
        if several.any():
            group = np.cumsum(np.r_[1, ~same]) + number
            number = int(group[-1])
            waiting.append((group[several], fp[several], code[several]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
        if held and (cut or (held[-1][0][-1], held[-1][1][-1]) != (cols[0][-1], cols[1][-1])):
            whole(*(np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols])))
            held = []
        elif cut:
            whole(*(c[:cut] for c in cols))
        held.append([c[cut:] for c in cols])
        if sum(len(x[0]) for x in waiting) >= CHUNK_ROWS:
            yield linked()
    if held:
        whole(*(np.concatenate(x) for x in zip(*held)))
    if waiting:
        yield linked()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links within two bits that connect what any links within two bits connect, of distinct ``fp`` longs."""
    fp = F.col("fp")
    mask = lambda p: ((1 << HALF) - 1) & ~(1 << p)
    variants = [
        F.struct(F.lit(p).cast("long").alias("code"), fp.bitwiseAND(mask(p)).alias("key")) for p in range(HALF)
    ] + [
        F.struct(F.lit(HALF + p).cast("long").alias("code"), F.shiftrightunsigned(fp, HALF).bitwiseAND(mask(p)).alias("key"))
        for p in range(HALF)
    ]
    keyed = distinct.select("fp", F.inline(F.array(*variants))).select("code", "key", "fp")
    dealt = keyed.repartition("code", "key").sortWithinPartitions("code", "key")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; texts without words have fingerprint 0 and are one group.

    Rows that repeat an id have a row each. Null ids are returned, but name no
    component unless all ids of it are null. Other columns aren't read.
    """
    rows = materialise(fingerprints(df, id_col, text_col), "fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = materialise(links(least.select("fp")), "links")
    classes = components(joined)
    merged = (
        least.join(classes, least.fp == classes.node, "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("class"))
    )
    smallest = merged.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = merged.join(smallest, "class").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """One row of each group: that of the smallest id. Rows with a null id all stay; of rows that repeat the smallest id, that whose text has the smallest hash stays.

    By default groups are linked by fingerprints within two bits. With a ``similarity`` they are
    linked by that Jaccard similarity of shingles of ``width`` words: at 0.8, texts differ by some ten bits
    of 64, so segments of several fingerprints link what they reach and an exact join finds the rest (``similar``).
    """
    if similarity is not None:
        return similar.drop_similar(df, id_col, text_col, similarity, width)
    if width != SHINGLE_WORDS:
        raise ValueError(f"fingerprints are of {SHINGLE_WORDS} words")
    classes = materialise(near_duplicates(df, id_col, text_col), "classes")
    keep = classes.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept"))
    n, different = keep.agg(F.count("_kept"), F.count_distinct("_kept")).first()
    kept = df.join(keep.distinct(), df[id_col] == F.col("_kept"), "left_semi")
    if n > different:  # only then must rows be told apart, which moves the texts
        kept = one_row_each(kept, id_col, text_col)
    return kept.unionByName(df.where(F.col(id_col).isNull()))
