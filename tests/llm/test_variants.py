import random

import corpus_pipeline
import numpy as np

from factloom.llm import similar, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
signed = lambda x: x - (1 << 64) if x >> 63 else x


def segments(prints):
    return [x >> s & 0xFFFFFFFF for x in prints for s in (0, 32)]


def brute_candidates(rows):
    """Pairs of keys by comparing every segment with every other."""
    pairs = set()
    for k in range(2 * variants.PRINTS):
        first = {}
        for key, prints in sorted(rows):
            value = segments(prints)[k]
            if value in first:
                pairs.add((first[value], key))
            first.setdefault(value, key)
        for v, a in first.items():
            pairs |= {(min(a, b), max(a, b)) for w, b in first.items() if a != b and (v ^ w).bit_count() == 1}
    return pairs


def test_candidates_equal_brute_force(spark):
    rnd = random.Random(8)
    rows, keys = [], [rnd.getrandbits(64) - (1 << 63) for _ in range(300)]
    for base in range(30):
        prints = [rnd.getrandbits(64) for _ in range(variants.PRINTS)]
        for i in range(10):
            now = list(prints)
            for _ in range(rnd.randrange(80)):
                now[rnd.randrange(variants.PRINTS)] ^= 1 << rnd.choice([0, 31, 32, 63, rnd.randrange(64)])
            rows.append((keys[base * 10 + i], now if i else [0, (1 << 64) - 1] * (variants.PRINTS // 2)))
    frame = spark.createDataFrame([(k, [signed(x) for x in p]) for k, p in rows], "key long, prints array<long>")
    got = [(r.a, r.b) for r in variants.candidates(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_candidates(rows) and len(got) > 200
    assert variants.candidates(frame.limit(0)).count() == 0


def test_fingerprints_are_the_majority_of_bits():
    rnd = random.Random(9)
    for n in (0, 1, 2, 7, 40, (1 << 14) + 5):
        s = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
        got = variants.fingerprints(s)
        for k in (0, variants.PRINTS - 1):
            hashes = variants.mix(s + variants._SEEDS[k]).tolist()
            assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))
    assert len({int(x) for x in got}) == variants.PRINTS


def test_near_dedup_stage_links_by_fingerprints_first(spark, monkeypatch):
    """What deletion variants bring together is verified and linked before the exact join, which gets the rest."""
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = {}
    for base in range(40):
        own = [word() for _ in range(200)]
        texts[base * 10] = " ".join(own)
        own[rnd.randrange(5, 195)] = word()  # similarity 0.95
        texts[base * 10 + 1] = " ".join(own)
    sets = {similar._key(s): s for s in map(similar.shingles, texts.values())}
    linked = []

    def spy(edges, *more, whole=similar.components):
        linked.append({(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()})
        return whole(edges, *more)

    monkeypatch.setattr(similar, "components", spy)
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect()}
    assert got == {base * 10 for base in range(40)}
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert len(linked[0]) >= 36 and all(share(a, b) >= 0.8 for a, b in linked[0])
    assert linked[0] <= linked[-1] and len(linked[-1]) == 40
