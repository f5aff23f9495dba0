"""Secrets in texts: an inverted index of trigrams says which texts a rule can match in, and only those are searched.

Documents are dealt into segments of about a megabyte, each with the posting
lists of the trigrams that the rules ask for (``index``); a segment is a row of
its own, so an index can be written and searched again, and nothing is
shuffled. A rule's condition on trigrams (``trigrams``) is evaluated on the posting lists by intersecting and uniting
them, in Spark's array functions; candidates are verified by the expression itself. A rule
that no trigram is sure for is held against all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import trigrams
from factloom.llm.common import whole_text
from factloom.llm.wordhash import text_slices


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, of which those stay whose group is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, then formats that issuers of keys publish. Fixed values.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # as [0-9a-f]+ of 32 characters or more, since a match is a whole run
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,250}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]{1,100}:[A-Za-z0-9._~%!*-]{1,100}@"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}"),
)
BASE_KINDS = ("assign", "access", "hex")
SEGMENT_BYTES = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def _postings(texts: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, place), sorted, each once; ``wanted`` is a table over all trigrams."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = _FOLD[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]] if data is not None and data.size else np.empty(0, np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = raw[:-2].astype(np.int32) << 16 | raw[1:-1].astype(np.int32) << 8 | raw[2:]
    at = np.flatnonzero(wanted[codes])
    place = np.searchsorted(ends - ends[0], at, "right") - 1
    inside = at + 3 <= (ends - ends[0])[place + 1]  # not across two texts
    pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | place[inside])
    return pairs >> 32, pairs & 0xFFFFFFFF


def _indexing(codes: list[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.full(1 << 24, codes is None)
        wanted[codes or []] = True
        for whole in batches:
            for b in text_slices(whole, 1, SEGMENT_BYTES):
                trigram, place = _postings(b.column(1), wanted)
                first = np.flatnonzero(np.diff(trigram, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(place)), pa.int32()), pa.array(place, pa.int32()))
                n = len(first)
                postings = pa.MapArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(trigram[first], pa.int32()), lists)
                rows = [0, b.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.concat_arrays([c])) for c in b.columns), postings], names=["ids", "texts", "postings"],
                )

    return run


def index(df: DataFrame, wanted: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments (ids, texts, postings): for each trigram the places in the segment's lists of the texts that hold it.

    ``wanted`` are the trigrams to index, all by default. A segment has
    one text at least, whatever its length. Null texts are empty; ids may be null or repeat.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    codes = None if wanted is None else sorted(map(trigrams.code, wanted))
    return rows.mapInArrow(_indexing(codes), "ids array<long>, texts array<string>, postings map<int, array<int>>")


def candidates(segments: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, text, rules) of every indexed text: the numbers of the rules whose conditions its trigrams meet."""
    every = F.transform(F.col("ids"), lambda _, k: k)
    lists = F.array(*[trigrams.postings_of(trigrams.condition(r.pattern), F.col("postings"), every) for r in rules])
    found = segments.select("ids", "texts", lists.alias("_places"))
    texts = found.select(F.posexplode(F.arrays_zip("ids", "texts")).alias("_place", "_doc"), "_places")
    fitting = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda k: F.array_contains(F.get("_places", k), F.col("_place")))
    return texts.select(F.col("_doc.ids").alias("doc_id"), F.col("_doc.texts").alias("text"), fitting.alias("rules"))


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _verifying(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        for whole in batches:
            for b in text_slices(whole, 1):
                out = []
                for text, which in zip(b.column(1), b.column(2).to_pylist()):
                    text = text.as_py() if which else ""
                    found = sorted((start, k, end) for k in which for start, end in spans_of(text, rules[k], compiled[k]))
                    out.append([{"kind": rules[k].kind, "start": start, "end": end} for start, k, end in found])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _SPANS.field(1).type)], schema=_SPANS)

    return run


def find_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SPANS of each row: what the rules find in its whole text, in code points with the end left out, by start and then by the rules' order.

    A null or empty text has none. Each row is searched on its own, so repeated
    rows and ids, and null ids, have a row each. Other columns aren't read.
    """
    wanted = set().union(*(trigrams.trigrams_of(trigrams.condition(r.pattern)) for r in rules))
    return search(index(df, wanted, id_col, text_col), rules)


def search(segments: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """SPANS of an index's texts; it must hold the trigrams of the rules' conditions."""
    return candidates(segments, rules).mapInArrow(_verifying(rules), SPANS)
