from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import simhash
from factloom.llm.graph import components


def brute_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_classes(fps):
    """id -> smallest id reachable over links of two bits or fewer."""
    own = {i: i for i in fps}

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(fps)
    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                own[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_classes(fps)


def test_links_are_complete_on_dense_clusters(spark):
    import random

    rnd = random.Random(5)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, (1 << 63) | (1 << 31)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.links(frame).collect()
    own = {x: x for x in signed}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in found:
        own[max(find(a), find(b))] = min(find(a), find(b))
        assert True
    mine = defaultdict(set)
    for x in signed:
        mine[find(x)].add(x % (1 << 64))
    theirs = defaultdict(set)
    for x, c in brute_classes({x: x for x in fps}).items():
        theirs[c].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_nulls_empty_texts_repeats_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("fp", T.StringType()), ("component_id", T.LongType()))])
    rows = [(3, None, "x", 1), (2, "", None, None), (5, " \t\n", "y", 2), (7, "A b c d", "z", 1), (7, "a B c d", "z", 1), (None, "a b c d", None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in got) == [(-1, 7), (2, 2), (3, 2), (5, 2), (7, 7), (7, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
