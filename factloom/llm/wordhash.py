"""Words of a batch of texts as 64-bit hashes, in whole-array numpy steps.

A word is a run of ASCII letters, digits and bytes from 0x80 up, so of UTF-8
text beyond ASCII every character is a word character; A-Z count as a-z. A
word's hash is a polynomial in its bytes modulo 2^64, mixed; equal words of any
two batches have equal hashes. Collisions can be had only by design, and what
uses the hashes counts or aligns words, so one would cost a slightly wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _table() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        t[b] = b
    for b in range(0x41, 0x5B):
        t[b] = b + 32
    return t


_FOLD = _table()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have, step = 1, base
    while have < n:  # doubles: p^(have + i) = p^have * p^i
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_POWERS = {"up": _powers(_P, 1), "down": _powers(_P_INVERSE, 1)}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_P, n), _powers(_P_INVERSE, n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Texts are hashed in runs of about this many bytes, which bounds the arrays.
RUN_BYTES = 1 << 20


def _string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return ends, raw


def _hash_run(raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hashes) of each word of a run, a column for the word and one for each prefix; text ends are marked by a byte that is no word's."""
    folded = _FOLD[raw]
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(folded, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _upto(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(folded.astype(np.uint64) * up[:len(raw)], out=total[1:])
    out = np.zeros((len(start), 1 + len(prefixes)), np.uint64)
    out[:, 0] = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k, n in enumerate(prefixes, 1):
        longer = np.flatnonzero(end - start > n)
        begin = start[longer]
        out[longer, k] = mix((total[begin + n] - total[begin]) * down[begin] + np.uint64(n << 32))
    return start, out


def _hash_pieces(raw: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_hash_run``, in pieces that end between words, so that a very long text takes no more memory than a run."""
    if len(raw) <= 2 * RUN_BYTES:
        return _hash_run(raw, prefixes)
    starts, parts, at = [], [], 0
    while at < len(raw):
        end = min(at + RUN_BYTES, len(raw))
        while end < len(raw) and _FOLD[raw[end]]:
            gap = np.flatnonzero(_FOLD[raw[end:end + 4096]] == 0)
            end = min(len(raw), end + (int(gap[0]) if len(gap) else 4096))
        start, hashes = _hash_run(raw[at:end], prefixes)
        starts.append(start + at)
        parts.append(hashes)
        at = end
    return np.concatenate(starts), np.concatenate(parts)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): the words of text i are hashes[first[i]:first[i + 1]], in order. A null has none."""
    first, hashes = hashed_prefixes(texts, ())
    return first, np.ascontiguousarray(hashes[:, 0])


def hashed_prefixes(texts: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As hashed_words, with a further column for each length in bytes: the hash of a longer word's prefix, else 0."""
    ends, raw = _string_buffers(texts)
    n = len(texts)
    first, parts, have, i = np.zeros(n + 1, np.int64), [], 0, 0
    while i < n:
        j = int(max(i + 1, np.searchsorted(ends, ends[i] + RUN_BYTES, "right") - 1))
        lengths = np.diff(ends[i:j + 1])
        run = np.zeros(int(lengths.sum()) + j - i, np.uint8)  # one byte 0 after each text
        keep = np.ones(len(run), bool)
        stops = np.cumsum(lengths + 1) - 1
        keep[stops] = False
        run[keep] = raw[ends[i]:ends[j]]
        start, hashes = _hash_pieces(run, prefixes)
        first[i + 1:j + 1] = have + np.searchsorted(start, stops, "right")
        parts.append(hashes)
        have += len(hashes)
        i = j
    return first, np.concatenate(parts) if parts else np.empty((0, 1 + len(prefixes)), np.uint64)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many bytes of text, at least a row each, so that long texts don't add up."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    piece = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the hashes of the words; the caller leaves out those across texts."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[:len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + hashes[k:len(hashes) - n + 1 + k]
    return mix(out)
