"""FLAC media columns: encode samples, decode them to PCM blocks with sample offsets, verify every checksum.

Streams have 1 to 8 channels of 4 to 24 bits a sample, as RFC 9639 lays them down; what is
written here is mono. Frames of many documents
are coded together: bit fields are scattered and gathered by whole arrays, and
where a stream is serial (Rice codes, predictors, checksums) all frames advance
in step, a sample or a byte of each at a time. So the work per sample is a few
array operations, and memory is bounded by the bytes taken at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import whole_text
from factloom.llm.wordhash import text_slices

RATE, BLOCK, PAYLOAD_UNIT = 8000, 1024, 64
#: Coefficients of the fixed predictors, newest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LPC_ORDER, LPC_BITS = 4, 12
CONSTANT, VERBATIM = 0, 1
#: Bytes of payload that are coded at a time.
AT_A_TIME = 3 << 20


class FlacError(ValueError):
    """A stream that isn't FLAC, uses what isn't supported, or whose checksum is wrong."""


def _crc_table(bits: int, polynomial: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table & top, (table << 1) ^ polynomial, table << 1) & full
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(_CRC8[crc ^ b])
    return crc


def _crc16(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksum of each stretch of the buffer, all advancing by a byte at a time."""
    order = np.argsort(-length, kind="stable")
    at, crc = start[order].copy(), np.zeros(len(order), np.int64)
    active = np.searchsorted(-length[order], -np.arange(1, length.max(initial=0) + 1), "right")
    for n in active.tolist():
        crc[:n] = (crc[:n] << 8 & 0xFF00) ^ _CRC16[(crc[:n] >> 8) ^ buffer[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size) & 0xFF) | n, *reversed(tail)])


_SIZES = {8: 1, 12: 2, 16: 4}


@lru_cache(1 << 16)
def _frame_header(number: int, n: int, bps: int) -> bytes:
    head = bytes([0xFF, 0xF8, 0x70 | 4, _SIZES.get(bps, 0) << 1]) + _coded_number(number) + (n - 1).to_bytes(2, "big")
    return head + bytes([_crc8(head)])


# -- encoding ---------------------------------------------------------------


def _scatter(out: np.ndarray, at: np.ndarray, value: np.ndarray, width) -> None:
    """Or fields of up to 17 bits, most significant first, into bytes at bit places; fields don't overlap."""
    first = at >> 3
    v = value.astype(np.int64) << (24 - (at & 7) - width)
    low, high = int(first.min()), int(first.max()) + 3
    for k in range(3):
        part = np.bincount(first - low + k, weights=v >> (16 - 8 * k) & 0xFF, minlength=high - low)
        out[low:high] |= part.astype(np.uint8)


def _zigzag(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 31)


def _linear_predictors(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer coefficients (order x frames) and shifts of each frame (samples x frames), by autocorrelation."""
    y = x.astype(np.float64)
    r = np.stack([(y[k:] * y[:len(y) - k]).sum(0) for k in range(order + 1)])
    a, error = np.zeros((order, x.shape[1])), r[0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        reflection = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - reflection * a[:i][::-1], reflection
        error = np.maximum(error * (1 - reflection**2), 1e-9)
    limit = (1 << (LPC_BITS - 1)) - 1
    shift = np.clip(np.floor(np.log2(limit / np.maximum(np.abs(a).max(0), 1e-6))), 0, 15).astype(np.int64)
    return np.clip(np.round(a * 2.0**shift), -limit - 1, limit).astype(np.int64), shift


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order, n = len(coefficients), len(x)
    guess = sum((coefficients[j] * x[order - 1 - j:n - 1 - j] for j in range(order)), np.zeros_like(x[order:]))
    return x[order:] - (guess >> shift)


def _encode_frames(x: np.ndarray, bps: int) -> list[bytes]:
    """The subframes of equally long frames (samples x frames), from the subframe header up to the padding."""
    n, frames = x.shape
    x = x.astype(np.int64)
    best = np.full(frames, n * bps)  # verbatim
    kind, rice = np.full(frames, VERBATIM), np.zeros(frames, np.int64)
    kind[(x == x[0]).all(0)] = CONSTANT
    best[kind == CONSTANT] = 0
    coded: dict[int, np.ndarray] = {}
    lpc, shift = _linear_predictors(x, LPC_ORDER) if n > LPC_ORDER else (None, None)
    tries = [(8 | o, np.array(FIXED[o], np.int64).reshape(-1, 1) * np.ones((1, frames), np.int64), np.zeros(frames, np.int64), 0) for o in range(3) if o < n]
    if lpc is not None:
        tries.append((32 | LPC_ORDER - 1, lpc, shift, 9 + LPC_BITS * LPC_ORDER))
    for code, coefficients, by, extra in tries:
        u = coded[code] = _zigzag(_residual(x, coefficients, by))
        for k in range(9):
            bits = len(u) * (k + 1) + (u >> k).sum(0) + len(coefficients) * bps + extra + 10
            better = bits < best
            best[better], kind[better], rice[better] = bits[better], code, k
    # places of all fields, in bits from each frame's start
    order = np.select([kind < 2, kind < 32], [0, kind - 8], kind - 31)
    linear = kind >= 32
    warm = np.select([kind == CONSTANT, kind == VERBATIM], [1, n], order)
    params = 8 + warm * bps + np.where(linear, 9 + LPC_BITS * order, 0)
    length = np.where(kind < 2, 8 + warm * bps, 8 + best)
    size = (length + 7) // 8
    start = np.concatenate([[0], np.cumsum(size)]) * 8
    out = np.zeros(int(size.sum()) + 3, np.uint8)
    begin = start[:-1]
    _scatter(out, begin, kind << 1, 8)
    for i in range(int(warm.max())):
        own = np.flatnonzero(warm > i)
        _scatter(out, begin[own] + 8 + i * bps, x[i, own] & ((1 << bps) - 1), bps)
    own = np.flatnonzero(linear)
    if len(own):
        at = begin[own] + 8 + warm[own] * bps
        _scatter(out, at, np.full(len(own), LPC_BITS - 1), 4)
        _scatter(out, at + 4, shift[own], 5)
        for j in range(LPC_ORDER):
            _scatter(out, at + 9 + j * LPC_BITS, lpc[j, own] & ((1 << LPC_BITS) - 1), LPC_BITS)
    for code in np.unique(kind[kind > 1]).tolist():
        own = np.flatnonzero(kind == code)
        u, k = coded[code][:, own], rice[own]
        _scatter(out, begin[own] + params[own] + 6, k, 4)  # two bits of coding method and four of partition order are 0
        end = begin[own] + params[own] + 10 + np.cumsum((u >> k) + 1 + k, axis=0)
        field = (1 << k) | (u & ((1 << k) - 1))
        width = np.broadcast_to(k + 1, u.shape).reshape(-1)
        _scatter(out, end.reshape(-1) - width, field.reshape(-1), width)
    data = out.tobytes()
    return [data[a:b] for a, b in zip((begin // 8).tolist(), (start[1:] // 8).tolist())]


def encode_streams(streams: list[np.ndarray], bps: int = 8, block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """A FLAC stream of each array of signed samples, with a seek point for every frame."""
    if rate != RATE:
        raise FlacError(f"only {RATE} samples a second are written")
    by: dict[int, list[tuple[int, int]]] = {}
    for s, x in enumerate(streams):
        for k in range(-(-len(x) // block)):
            by.setdefault(min(block, len(x) - k * block), []).append((s, k))
    bodies: dict[tuple[int, int], bytes] = {}
    for n, own in by.items():
        x = np.stack([streams[s][k * block:k * block + n] for s, k in own], axis=1)
        bodies |= {f: _frame_header(f[1], n, bps) + b for f, b in zip(own, _encode_frames(x, bps))}
    order = [(s, k) for s, x in enumerate(streams) for k in range(-(-len(x) // block))]
    lengths = np.array([len(bodies[f]) for f in order], np.int64)
    everything = np.frombuffer(b"".join(bodies[f] for f in order), np.uint8)
    crcs = _crc16(everything, np.cumsum(lengths) - lengths, lengths).tolist()
    frames: list[list[bytes]] = [[] for _ in streams]
    for (s, k), crc in zip(order, crcs):
        frames[s].append(bodies[s, k] + crc.to_bytes(2, "big"))
    out = []
    for x, own in zip(streams, frames):
        sizes = [len(f) for f in own] or [0]
        raw = x.astype("<i2" if bps > 8 else "i1").tobytes()
        largest = min(block, max(16, len(x)))
        info = (
            largest.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
            + ((rate << 44) | (0 << 41) | ((bps - 1) << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(raw).digest()
        )
        points, at = [], 0
        for k, f in enumerate(own):
            points.append((k * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(x) - k * block).to_bytes(2, "big"))
            at += len(f)
        table = b"".join(points)
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *own]))
    return out


# -- decoding ---------------------------------------------------------------


@dataclass
class Stream:
    channels: int
    bps: int
    rate: int
    n_samples: int
    md5: bytes
    frames: int  # the byte where they begin
    points: list[tuple[int, int, int]]  # first sample, byte from there on, samples


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("the metadata end early")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1:at + 4], "big")
        body = data[at + 4:at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            found = ((int.from_bytes(body[i:i + 8], "big"), int.from_bytes(body[i + 8:i + 16], "big"), int.from_bytes(body[i + 16:i + 18], "big")) for i in range(0, len(body), 18))
            points = [p for p in found if p[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None or len(info) != 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18], "big")
    bps = (packed >> 36 & 31) + 1
    if bps > 24:
        raise FlacError("only samples of up to 24 bits are supported")
    return Stream((packed >> 41 & 7) + 1, bps, packed >> 44, packed & ((1 << 36) - 1), info[18:34], at, points)


_BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}


#: How a frame's two channels are told when neither stands for itself: which of them is a difference, one bit wider.
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _read_header(data: bytes, at: int) -> tuple[int, int, int, int]:
    """(frame or sample number, samples, byte of the subframes, layout of channels) of the frame there."""
    if data[at:at + 1] != b"\xff" or data[at + 1] & 0xFC != 0xF8:
        raise FlacError("no frame where one should be")
    size, rate, place = data[at + 2] >> 4, data[at + 2] & 15, at + 4
    layout = data[at + 3] >> 4
    if layout > MID_SIDE:
        raise FlacError("a reserved layout of channels")
    first = data[place]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    number = first & (0x7F >> more if more else 0x7F) if not more else first & ((1 << (6 - more)) - 1)
    for b in data[place + 1:place + 1 + more]:
        number = number << 6 | b & 0x3F
    place += 1 + more
    if size == 6:
        n, place = data[place] + 1, place + 1
    elif size == 7:
        n, place = int.from_bytes(data[place:place + 2], "big") + 1, place + 2
    elif size in _BLOCK_SIZES:
        n = _BLOCK_SIZES[size]
    else:
        raise FlacError("a reserved block size")
    place += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if _crc8(data[at:place]) != data[place]:
        raise FlacError("a frame header's checksum is wrong")
    return number, n, place + 1, layout


@lru_cache(1 << 16)
def _known_header(head: bytes) -> tuple[int, int, int, int]:
    return _read_header(head, 0)


def _frames_of(data: bytes, s: Stream) -> list[tuple[int, int, int, int]]:
    """(byte, bytes, first sample, samples) of each frame: by the seek table if it has them all, else by scanning."""
    starts = [s.frames + p[1] for p in s.points]
    if not (s.points and s.points[0][:2] == (0, 0) and sum(p[2] for p in s.points) == s.n_samples):
        starts, at, due = [], s.frames, 0
        while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
            try:
                number, n, *_ = _read_header(data, at)
            except (FlacError, IndexError):
                number = -1
            if number == due or data[at + 1] & 1 and number >= 0:
                starts.append(at)
                due += 1
            at += 1
    out, sample = [], 0
    for a, b in zip(starts, [*starts[1:], len(data)]):
        _, n, *_ = _known_header(data[a:a + 16]) if b - a >= 16 else _read_header(data, a)
        out.append((a, b - a, sample, n))
        sample += n
    if sample != s.n_samples:
        raise FlacError(f"{sample} samples where {s.n_samples} are due")
    return out


#: Leading zero bits of 16-bit numbers.
_ZEROS = np.array([16, *(16 - int(k).bit_length() for k in range(1, 1 << 16))], np.int64)


class _Bits:
    """Fields of up to 25 bits anywhere in a buffer, for many places at once."""

    def __init__(self, raw: np.ndarray):
        b = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.int64)
        self.window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 32 bits, of which the first 25 at least are right."""
        return self.window[at >> 3] << (at & 7) & 0xFFFFFFFF

    def take(self, at: np.ndarray, width) -> np.ndarray:
        return np.where(np.asarray(width) > 0, self.peek(at) >> (32 - np.maximum(width, 1)), 0)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.take(at, width)
        return np.where(np.asarray(width) > 0, v - ((v >> (np.maximum(width, 1) - 1) & 1) << width), 0)


def _residuals(bits: _Bits, at: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice-coded residuals (samples x frames) behind the warm-up samples, and the bit places behind them; each frame's place moves in step."""
    frames = len(at)
    method = bits.take(at, 2)
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    wide = 4 + method
    part = n >> bits.take(at + 2, 4)
    at = at + 6
    k, raw, next_part = np.zeros(frames, np.int64), np.full(frames, -1), order.copy() * 0
    out = np.zeros((n, frames), np.int64)
    next_part = order.copy()  # the first partition lacks the warm-up samples
    plain = True
    for i in range(n):
        new = np.flatnonzero((next_part == i) & (i >= order)) if i <= order.max() or (part < n).any() else ()
        if len(new):
            p = bits.take(at[new], wide[new])
            escaped = p == (1 << wide[new]) - 1
            at[new] += wide[new]
            raw[new] = np.where(escaped, bits.take(at[new], 5), -1)
            at[new] += 5 * escaped
            k[new] = np.where(escaped, 0, p)
            next_part[new] = (i // part[new] + 1) * part[new]
            plain = bool((raw < 0).all())
        window = bits.peek(at)
        zeros = _ZEROS[window >> 16]
        used = zeros
        if plain and int(zeros.max()) + 1 + int(k.max()) <= 25 and int(zeros.max()) < 16 and i >= int(order.max()):
            low = np.where(k > 0, (window << (zeros + 1) & 0xFFFFFFFF) >> (32 - np.maximum(k, 1)), 0)
            u = zeros << k | low
            at = at + zeros + 1 + k
            out[i] = (u >> 1) ^ -(u & 1)
            continue
        live = i >= order
        used, open_ = zeros.copy(), np.flatnonzero((zeros == 16) & live & (raw < 0))
        while len(open_):
            more = _ZEROS[bits.peek(at[open_] + used[open_]) >> 16]
            used[open_] += more
            open_ = open_[more == 16]
        u = used << k | bits.take(at + used + 1, k)
        value = np.where(raw < 0, (u >> 1) ^ -(u & 1), bits.signed(at, np.maximum(raw, 0)))
        out[i] = np.where(live, value, 0)
        at = at + np.where(live, np.where(raw < 0, used + 1 + k, raw), 0)
    return out, at


def _decode_group(bits: _Bits, at: np.ndarray, n: int, bps: int) -> np.ndarray:
    """Samples (samples x frames) of subframes of one length that begin at bit places."""
    return _decode_subframes(bits, at, n, bps)[0]


def _decode_subframes(bits: _Bits, at: np.ndarray, n: int, bps: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_decode_group``, with the bit places behind the subframes."""
    head = bits.take(at, 8)
    kind, wasted = head >> 1 & 63, head & 1
    if (head >> 7).any():
        raise FlacError("no subframe where one should be")
    at = at + 8
    lower = np.flatnonzero(wasted)
    open_ = lower
    while len(open_):  # bits that are 0 in every sample, told in unary
        zeros = _ZEROS[bits.peek(at[open_]) >> 16]
        wasted[open_] += zeros
        at[open_] += zeros
        open_ = open_[zeros == 16]
    at[lower] += 1
    bps = bps - wasted
    if (bps < 1).any():
        raise FlacError("more wasted bits than a sample has")
    out = np.zeros((n, len(at)), np.int64)
    own = np.flatnonzero(kind == CONSTANT)
    out[:, own] = bits.signed(at[own], bps[own])
    at[own] += bps[own]
    own = np.flatnonzero(kind == VERBATIM)
    for i in range(n) if len(own) else ():
        out[i, own] = bits.signed(at[own] + i * bps[own], bps[own])
    at[own] += n * bps[own]
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if ((kind > 1) & ~fixed & ~linear).any():
        raise FlacError("a reserved subframe")
    rest = np.flatnonzero(fixed | linear)
    if len(rest):
        out[:, rest], at[rest] = _predicted(bits, at[rest], n, bps[rest], np.where(fixed, kind - 8, kind - 31)[rest], linear[rest])
    return out << wasted, at


def _predicted(bits: _Bits, place: np.ndarray, n: int, bps: np.ndarray, order: np.ndarray, is_linear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (samples x frames) of predicted subframes, from their warm-up samples on, and the bit places behind them."""
    warm = np.zeros((int(order.max()), len(place)), np.int64)
    for i in range(len(warm)):
        warm[i] = np.where(order > i, bits.signed(place + i * bps, bps), 0)
    place = place + order * bps
    coefficients, shift = np.zeros((int(order.max()), len(place)), np.int64), np.zeros(len(place), np.int64)
    for o in range(min(4, len(coefficients)) + 1):
        for j, c in enumerate(FIXED[o]):
            coefficients[j, ~is_linear & (order == o)] = c
    if is_linear.any():
        precision = np.where(is_linear, bits.take(place, 4) + 1, 0)
        shift = np.where(is_linear, bits.signed(place + 4, 5), 0)
        if (shift < 0).any() or (precision == 16).any():
            raise FlacError("a reserved predictor")
        place = place + 9 * is_linear
        for j in range(len(coefficients)):
            has = is_linear & (order > j)
            coefficients[j] = np.where(has, bits.signed(place, precision), coefficients[j])
            place = place + precision * has
    x, place = _residuals(bits, place, order, n)
    deepest = int(order.max())
    for i in range(min(deepest, n)):
        x[i] = np.where(order > i, warm[i], x[i])
    for i in range(1, n):
        depth = min(deepest, i)
        guess = (coefficients[:depth] * x[i - depth:i][::-1]).sum(0) >> shift if depth else 0
        x[i] += np.where(order <= i, guess, 0) if i < deepest else guess
    return x, place


def _decode_frames(bits: _Bits, at: np.ndarray, n: int, bps: int, layout: int) -> np.ndarray:
    """Samples (frames x samples x channels) of frames of one length and layout, whose subframes begin at bit places."""
    channels = []
    for c in range(2 if layout >= LEFT_SIDE else layout + 1):
        wider = (layout in (LEFT_SIDE, MID_SIDE) and c == 1) or (layout == SIDE_RIGHT and c == 0)
        x, at = _decode_subframes(bits, at, n, bps + wider)
        channels.append(x)
    if layout == LEFT_SIDE:
        channels[1] = channels[0] - channels[1]
    elif layout == SIDE_RIGHT:
        channels[0] = channels[1] + channels[0]
    elif layout == MID_SIDE:
        middle, side = channels
        whole = middle << 1 | side & 1
        channels = [(whole + side) >> 1, (whole - side) >> 1]
    return np.stack([x.T for x in channels], axis=-1)


def pcm_bytes(x: np.ndarray, bps: int) -> bytes:
    """Samples, channels side by side, as little-endian signed PCM of as many bytes as the bits need."""
    if bps > 16:
        return x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    return x.astype("<i2" if bps > 8 else "i1").tobytes()


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks (first sample, samples); frame, header and whole-stream checksums are verified.

    Samples of several channels are an array of samples x channels.
    """
    metadata = [read_metadata(d) for d in streams]
    base = np.concatenate([[0], np.cumsum([len(d) for d in streams])]).tolist()
    raw = np.frombuffer(b"".join(streams), np.uint8)
    rows = [(s, b, size, first, n) for s, (d, m) in enumerate(zip(streams, metadata)) for b, size, first, n in _frames_of(d, m)]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    if not rows:
        return out
    start = np.array([base[s] + b for s, b, *_ in rows])
    size = np.array([r[2] for r in rows])
    told = raw[start + size - 2].astype(np.int64) << 8 | raw[start + size - 1]
    if (_crc16(raw, start, size - 2) != told).any():
        raise FlacError("a frame's checksum is wrong")
    bits = _Bits(raw)
    by: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    for i, (s, b, size_, _, n) in enumerate(rows):
        head = _known_header(streams[s][b:b + 16]) if size_ >= 16 else tuple(v - (b if k == 2 else 0) for k, v in enumerate(_read_header(streams[s], b)))
        if (2 if head[3] >= LEFT_SIDE else head[3] + 1) != metadata[s].channels:
            raise FlacError("a frame has other channels than its stream")
        by.setdefault((n, metadata[s].bps, head[3]), []).append((i, (base[s] + b + head[2]) * 8))
    samples: dict[int, np.ndarray] = {}
    for (n, bps, layout), own in by.items():
        decoded = _decode_frames(bits, np.array([at for _, at in own]), n, bps, layout)
        decoded = np.ascontiguousarray(decoded[:, :, 0] if layout == 0 else decoded)
        samples |= dict(zip([i for i, _ in own], decoded))
    for i, (s, _, _, first, _) in enumerate(rows):
        out[s].append((first, samples[i]))
    for blocks, m in zip(out, metadata):
        pcm = b"".join(pcm_bytes(x, m.bps) for _, x in blocks)
        if any(m.md5) and hashlib.md5(pcm).digest() != m.md5:
            raise FlacError("the decoded samples aren't those encoded")
    return out


# -- tables -----------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text with bytes 0 behind it up to a positive multiple of 64."""
    return text + bytes((-len(text)) % PAYLOAD_UNIT or (0 if text else PAYLOAD_UNIT))


def _samples(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).astype(np.int16) - 128


def _encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in text_slices(batch, 1, AT_A_TIME):
            texts = [(x or "").encode() for x in b.column(1).to_pylist()]
            media = encode_streams([_samples(payload_of(t)) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )


def texts_to_flac(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a FLAC stream of 8-bit samples, byte b as b - 128.

    A null or empty text is 64 bytes 0. Null and repeated ids are kept as they
    are; other columns aren't read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_encoding, "doc_id long, n_bytes long, media binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in text_slices(batch, 1, AT_A_TIME):
            rows = []
            has = [(i, m) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m is not None]
            for (doc_id, media), blocks in zip(has, decode_streams([m for _, m in has])):
                bps = read_metadata(media).bps
                rows += [(doc_id, k, first, len(x), pcm_bytes(x, bps)) for k, (first, x) in enumerate(blocks)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "block", "first_sample", "n_samples", "pcm"])


def flac_to_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, block, first_sample, n_samples, pcm): the PCM blocks of each stream, little-endian, channels side by side, with where each begins.

    Null and repeated ids are kept; other columns aren't read. A null stream has no blocks. A stream that is damaged or not supported fails
    the job with ``FlacError``: silence in its place would look like data.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(_blocks, "doc_id long, block int, first_sample long, n_samples int, pcm binary")


def feature_of(x: np.ndarray) -> str:
    """Whole-number features of samples: how many, sum, energy, zero crossings, peak."""
    v = x.astype(np.int64)
    crossings = int(((v[1:] < 0) != (v[:-1] < 0)).sum())
    return f"n={len(v)};sum={int(v.sum())};energy={int((v * v).sum())};crossings={crossings};peak={int(np.abs(v).max(initial=0))}"


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_blocks int"
)


def _payload(blocks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The samples of a stream's PCM blocks, each where its offset says."""
    due = 0
    for first, x in blocks:
        if first != due:
            raise FlacError(f"a block begins at sample {first}, not at {due}")
        due += len(x)
    return np.concatenate([x for _, x in blocks]) if blocks else np.empty(0, np.int64)


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks"]
    for batch in batches:
        for b in text_slices(batch, 2, AT_A_TIME):
            media = b.column(2).to_pylist()
            decoded = iter(decode_streams([m for m in media if m is not None]))
            rows = []
            for m in media:
                if m is None:
                    rows.append((None,) * 7)
                    continue
                blocks = next(decoded)
                x = _payload(blocks)
                payload = (x + 128).astype(np.uint8).tobytes()
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]),
                    len(m), hashlib.sha256(m).hexdigest(), feature_of(x), len(blocks),
                ))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)


def payload_digests(media: DataFrame) -> DataFrame:
    """What the stored streams of ``texts_to_flac`` hold, each decoded to its PCM blocks, verified and put together by their offsets.

    ``media`` needs doc_id, n_bytes and media; other columns aren't read. Null and
    repeated ids are kept. A null stream has null digests; one without samples has
    those of no bytes. A stream that is damaged or not mono of 8 bits fails the job.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digesting, DIGESTS)
