import random
import re
from collections import defaultdict

import numpy as np
import pytest

from factloom.llm import decontaminate


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())


def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 2, row[j] - 2))
        best, above = max(best, *row), row
    return best


@pytest.mark.parametrize("seed", range(20))
def test_alignment_equals_plain_dynamic_programming(seed):
    rnd = np.random.default_rng(seed)
    a, b = rnd.integers(0, 5, rnd.integers(1, 30)).astype(np.uint64), rnd.integers(0, 5, rnd.integers(1, 60)).astype(np.uint64)
    assert decontaminate.smith_waterman(a, b) == plain_alignment(a.tolist(), b.tolist())


def test_seeds_are_guaranteed_at_the_threshold():
    for n in range(1, 200):
        for lost in range(n):  # words changed; the rest of the points goes to insertions
            if 3 * lost <= 0.4 * n + 1e-9:
                breaks = lost + int((0.4 * n - 3 * lost) / 2 + 1e-9)
                assert decontaminate.seed_length(n) <= -(-(n - lost) // (breaks + 1))
        assert 4 <= decontaminate.seed_length(n) <= 5 or n < 15


def brute(docs, items, threshold=0.8):
    out = defaultdict(float)
    for d, t in docs:
        w = words(t)
        for i, q in items:
            own = words(q)
            if own and len(set(own) & set(w)) >= 0.5 * len(set(own)):
                score = plain_alignment(own, w) / (2 * len(own))
                if score >= threshold:
                    out[d, i] = max(out[d, i], score)
    return dict(out)


def found(spark, docs, items):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(frame, marks).collect()}


def test_edited_copies_short_items_and_odd_rows(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 6, 9, 16, 30, 45])))) for i in range(25)] + [(25, None), (26, ""), (None, "no id here at all"), (3, "second text of item three, quite other"), (27, "a a a a a a a a a a a a")]
    docs = []
    for d in range(160):
        own = words(items[d % 25][1])
        for _ in range(rnd.randint(0, 4)):  # substitutions, insertions and losses
            at = rnd.randrange(len(own)) if own else 0
            own[at:at + rnd.randint(0, 1)] = [word().encode()] * rnd.randint(0, 1)
        docs.append((d, " ".join([word() for _ in range(30)] + [w.decode().upper() + "," for w in own] + [word() for _ in range(30)])))
    docs += [(200, None), (201, ""), (202, "a " * 40), (203, items[4][1]), (203, "other"), (204, " ".join(word() for _ in range(60_000)) + " " + items[5][1]), (205, "second text of item three, quite other")]
    want = brute(docs, [i for i in items if i[0] is not None])
    got = found(spark, docs, items)
    assert set(got) == set(want) and len(want) > 60
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    monkeypatch.setattr(decontaminate, "PART_BYTES", 900)  # in parts
    assert set(found(spark, docs, items)) == set(want)


def test_empty_tables(spark):
    assert found(spark, [(1, "some words in a row here")], []) == {} and found(spark, [], [(1, "some words in a row here")]) == {}


def test_table_and_drop(spark):
    d = "/root/testdata/sf0.001"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in marks.collect()])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, marks).collect()} == set(want)
    kept = {r.doc_id for r in decontaminate.drop_leaks(docs, marks).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {i for i, _ in want}
