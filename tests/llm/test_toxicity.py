import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from factloom.llm import toxicity


def brute(vectors, terms, weights, k, skip=-1):
    q = dict(zip(terms.tolist(), weights.tolist()))
    all_ = [(round(sum(q.get(t, 0) * w for t, w in zip(ts.tolist(), ws.tolist())), 12), i) for i, (ts, ws) in enumerate(vectors) if i != skip]
    return [x for x in sorted(all_, key=lambda x: (-x[0], x[1])) if x[0] > 0][:k]


@pytest.mark.parametrize("seed", range(5))
def test_nearest_equal_brute_force(seed):
    rnd = np.random.default_rng(seed)

    def vector(n):
        t = np.sort(rnd.choice(50, n, replace=False))
        w = rnd.integers(1, 4, n).astype(float)
        return t, w / np.sqrt((w * w).sum())

    vectors = [vector(int(rnd.integers(1, 9))) for _ in range(700)]
    vectors += vectors[:40]  # ties
    index = toxicity.BlockMaxIndex(vectors, 50, block=16)
    for q in range(120):
        terms, weights = vectors[q] if q % 2 else vector(int(rnd.integers(1, 12)))
        skip = q if q % 2 else -1
        got, want = index.nearest(terms, weights, 7, skip), brute(vectors, terms, weights, 7, skip)
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_isotonic_rises_and_fits():
    x, y = toxicity.isotonic([(0.0, 0), (0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.9, 0), (1.0, 1), (1.0, 1)])
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < 0.5 < y[-1] < 1


def test_a_clean_example_among_the_highest_votes_does_not_level_the_fit():
    """Its equals are pooled with each other, not with all the clean ones below them."""
    x, y = toxicity.isotonic([(0.0, 0)] * 300 + [(0.2, 0)] * 5 + [(1.0, 1)] * 60 + [(1.0, 0)] * 2)
    assert np.interp(0.0, x, y) < 0.01 and np.interp(1.0, x, y) == pytest.approx(60.5 / 63)
    assert np.unique(toxicity.isotonic([(0.5, 0), (0.5, 1)])[1]).tolist() == [0.5]


def test_held_out_rows_of_label_1_rank_above_label_0_despite_wrong_labels(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(15)] + ["rotter", "scoundrel"] * (i % 4 == 0) + ["fine"])) for i in range(500)]
    labels = [(i, int(i % 4 == 0 and i not in (4, 8))) for i in range(500)]  # two that look toxic are marked clean
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    bad, good = ([r.score for r in got if (r.doc_id % 4 == 0) == b] for b in (True, False))
    assert bad and good and min(bad) > max(good)


def test_held_out_accuracy_on_a_table(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.8 * sum(r.toxic for r in rows)


def test_learns_from_the_right_rows_and_stands_odd_ones(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(20)] + ["Rotter"] * (2 * bad) + ["fine"]), None))
        labels.append((i, int(bad)))
    rows += [(1000, None, "x"), (1001, "", None), (None, "a Rotter and a rotter", None), (1002, "rotter " * 200_000, None), (1002, "nothing", None)]
    labels += [(None, 1), (5, None), (1001, 0)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        bad = r.doc_id is None or r.doc_id == 1002 or (r.doc_id < 400 and r.doc_id % 4 == 0)
        if r.doc_id != 1002:
            assert r.predicted == bad, r
    assert sorted(r.predicted for r in got if r.doc_id == 1002) == [0, 1]
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()}
    assert None in kept and 1002 not in kept and 1001 in kept and 0 not in kept
    assert toxicity.score_toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0
