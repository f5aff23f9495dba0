import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from factloom.llm import flac


def streams(seed=0):
    rnd = np.random.default_rng(seed)
    t = np.arange(5000)
    yield np.zeros(64, np.int16)
    yield np.full(3000, -7, np.int16)
    yield rnd.integers(-128, 128, 2500).astype(np.int16)  # verbatim
    yield np.round(90 * np.sin(t / 9)).astype(np.int16)  # linear prediction
    yield (t % 100).astype(np.int16)  # fixed predictors
    yield np.where(t % 997 == 0, 127, 0).astype(np.int16)  # long runs of zeros in codes
    yield np.array([3, -4], np.int16)
    yield np.frombuffer("Plain text, wie ein Satz; été. ".encode() * 90, np.uint8).astype(np.int16) - 128


@pytest.mark.parametrize("bps", [8, 16])
def test_round_trip(bps):
    given = list(streams()) if bps == 8 else [x * 200 for x in streams()]
    coded = flac.encode_streams(given, bps)
    for x, blocks in zip(given, flac.decode_streams(coded)):
        assert np.array_equal(np.concatenate([b for _, b in blocks]), x)
        assert [f for f, _ in blocks] == list(range(0, len(x), flac.BLOCK))
    assert len(coded[3]) < len(given[3]) * bps / 8 * 0.8


def test_frames_are_found_without_a_seek_table():
    x = np.round(60 * np.sin(np.arange(200_000) / 7)).astype(np.int16)
    coded = flac.encode_streams([x])[0]
    s = flac.read_metadata(coded)
    bare = b"fLaC" + b"\x80" + coded[5:42] + coded[s.frames:]
    got = np.concatenate([b for _, b in flac.decode_streams([bare])[0]])
    assert np.array_equal(got, x)


def plain_subframe(bits, n, bps):
    """A bit-by-bit decoder of one subframe, for comparison."""
    at = 0

    def take(k):
        nonlocal at
        v = int(bits[at:at + k] or "0", 2)
        at += k
        return v

    def signed(k):
        v = take(k)
        return v - (1 << k) if k and v >> (k - 1) else v

    kind = take(8) >> 1
    if kind == 0:
        return [signed(bps)] * n
    if kind == 1:
        return [signed(bps) for _ in range(n)]
    order = kind - 8 if kind < 32 else kind - 31
    x = [signed(bps) for _ in range(order)]
    c, shift = list(flac.FIXED[order]) if kind < 32 else [], 0
    if kind >= 32:
        p = take(4) + 1
        shift = take(5)
        c = [signed(p) for _ in range(order)]
    take(2)
    parts = 1 << take(4)
    for k in range(parts):
        rice = take(4)
        raw = take(5) if rice == 15 else None
        for _ in range(n // parts - (order if k == 0 else 0)):
            if raw is not None:
                e = signed(raw)
            else:
                q = 0
                while not take(1):
                    q += 1
                u = q << rice | take(rice)
                e = (u >> 1) ^ -(u & 1)
            x.append(e + (sum(a * b for a, b in zip(c, reversed(x))) >> shift))
    return x


def test_own_frames_read_by_a_plain_decoder():
    for x in streams():
        n = min(len(x), 700)
        body = flac._encode_frames(x[:n].reshape(-1, 1), 8)[0]
        assert plain_subframe("".join(f"{b:08b}" for b in body), n, 8) == x[:n].tolist()


def random_subframe(rnd, n):
    """Bits of a subframe with partitions, escapes and any predictor, and nothing known of its samples."""
    order = rnd.randint(0, 4)
    out = f"{(8 | order) << 1:08b}"
    if rnd.random() < 0.5:
        order = rnd.randint(1, 6)
        out = f"{(32 | order - 1) << 1:08b}"
    out += "".join(f"{rnd.randrange(256):08b}" for _ in range(order))
    if out[0:8] >= f"{64:08b}":
        p = rnd.randint(3, 9)
        out += f"{p - 1:04b}" + f"{rnd.randint(2, 8):05b}" + "".join(f"{rnd.randrange(1 << p):0{p}b}" for _ in range(order))
    parts = rnd.choice([0, 1, 2])
    out += "00" + f"{parts:04b}"
    for k in range(1 << parts):
        count = (n >> parts) - (order if k == 0 else 0)
        if rnd.random() < 0.3:
            w = rnd.randint(0, 8)
            out += "1111" + f"{w:05b}" + "".join(f"{rnd.randrange(1 << w):0{w}b}" if w else "" for _ in range(count))
        else:
            r = rnd.randint(0, 5)
            out += f"{r:04b}" + "".join("0" * rnd.choice([0, 1, 2, 3, 20, 40]) + "1" + (f"{rnd.randrange(1 << r):0{r}b}" if r else "") for _ in range(count))
    return out


def test_partitions_escapes_and_long_codes():
    rnd = random.Random(4)
    n = 64
    subframes = [random_subframe(rnd, n) for _ in range(60)]
    padded = [s + "0" * (-len(s) % 8) for s in subframes]
    raw = np.array([int(s[i:i + 8], 2) for s in padded for i in range(0, len(s), 8)], np.uint8)
    starts = np.cumsum([0] + [len(s) for s in padded[:-1]])
    got = flac._decode_group(flac._Bits(raw), starts, n, 8)
    for k, s in enumerate(subframes):
        want = plain_subframe(s, n, 8)
        if max(map(abs, want)) < 1 << 55:  # a made-up predictor can run away
            assert got[:, k].tolist() == want


def test_damage_is_noticed():
    coded = bytearray(flac.encode_streams([next(iter(streams(3)))])[0])
    coded[-4] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode_streams([bytes(coded)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([b"RIFF...."])


def test_table_digests(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType())])
    rows = [(1, None, "x"), (2, "", None), (3, "x" * 64, None), (4, "été " * 5000, None), (4, "été " * 5000, None), (None, "a\x00b", None), (6, "long " * 300_000, None)]
    frame = spark.createDataFrame(rows, schema)
    got = flac.payload_digests(flac.texts_to_flac(frame)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        payload = flac.payload_of(data)
        r = by[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    blocks = flac.flac_to_blocks(flac.texts_to_flac(frame.where("doc_id = 6"))).orderBy("block").collect()
    assert b"".join((np.frombuffer(b.pcm, "i1").astype(np.int16) + 128).astype(np.uint8).tobytes() for b in blocks)[:10] == b"long long "
    assert [b.first_sample for b in blocks] == [k * 1024 for k in range(len(blocks))]
    assert flac.flac_to_blocks(flac.texts_to_flac(spark.createDataFrame([], schema))).count() == 0


def written_stream(channels, bps, layout, wasted=0):
    """A stream of one frame, written bit by bit with verbatim or constant subframes, and its samples (samples x channels)."""
    left, right = channels
    told = {1: (left, right), 8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}[layout]
    wide = {1: (0, 0), 8: (0, 1), 9: (1, 0), 10: (0, 1)}[layout]
    out = ""
    for x, more in zip(told, wide):
        width = bps + more - wasted
        field = lambda v, w=width: f"{(int(v) >> wasted) & ((1 << w) - 1):0{w}b}"
        constant = len(set(x.tolist())) == 1
        out += f"0{0 if constant else 1:06b}{int(wasted > 0)}" + ("0" * (wasted - 1) + "1" if wasted else "")
        out += field(x[0]) if constant else "".join(map(field, x))
    out += "0" * (-len(out) % 8)
    n = len(left)
    head = bytes([0xFF, 0xF8, 0x70 | 4, layout << 4]) + bytes([0]) + (n - 1).to_bytes(2, "big")
    frame = head + bytes([flac._crc8(head)]) + bytes(int(out[i:i + 8], 2) for i in range(0, len(out), 8))
    raw = np.frombuffer(frame, np.uint8)
    frame += int(flac._crc16(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")
    samples = np.stack(channels, 1)
    info = n.to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (1 << 41) | ((bps - 1) << 36) | n).to_bytes(8, "big")
    info += hashlib.md5(flac.pcm_bytes(samples, bps)).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame, samples


@pytest.mark.parametrize("bps", [8, 16, 24])
def test_layouts_of_two_channels_and_wasted_bits(bps):
    rnd = np.random.default_rng(bps)
    high = 1 << (bps - 1)
    cases = []
    for layout in (1, 8, 9, 10):
        for wasted in (0, 1, 3):
            if layout == 10 and wasted:
                continue  # a middle of shifted samples need not be one
            x = rnd.integers(-high >> wasted, high >> wasted, (2, 40)) << wasted
            cases.append(written_stream(list(x), bps, layout, wasted))
    cases.append(written_stream([np.full(30, -5), np.full(30, -5)], bps, 8))
    for (_, want), blocks in zip(cases, flac.decode_streams([c for c, _ in cases])):
        assert [f for f, _ in blocks] == [0] and np.array_equal(blocks[0][1], want)


def test_null_and_empty_media_and_every_digest(spark):
    empty = flac.encode_streams([np.empty(0, np.int16)])[0]
    x = np.frombuffer(flac.payload_of(b"some text, some more"), np.uint8).astype(np.int16) - 128
    coded = flac.encode_streams([x])[0]
    rows = [(1, 5, None), (2, 0, empty), (None, 20, coded), (3, 20, coded)]
    got = {r.doc_id: r for r in flac.payload_digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].payload_sha256 is None and got[1].media_bytes is None and got[1].n_bytes == 5
    assert got[2].payload_bytes == 0 and got[2].n_blocks == 0 and got[2].feature == "n=0;sum=0;energy=0;crossings=0;peak=0"
    v = x.astype(int).tolist()
    crossings = sum((a < 0) != (b < 0) for a, b in zip(v, v[1:]))
    assert got[3].feature == got[None].feature == f"n=64;sum={sum(v)};energy={sum(a * a for a in v)};crossings={crossings};peak={max(map(abs, v))}"
    assert got[3].media_sha256 == hashlib.sha256(coded).hexdigest() and got[3].media_bytes == len(coded)
    blocks = {r.doc_id: r for r in flac.flac_to_blocks(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert set(blocks) == {None, 3} and blocks[3].pcm == x.astype("i1").tobytes() and blocks[3].first_sample == 0
