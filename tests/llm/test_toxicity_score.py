import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.llm import toxicity

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, toxic int, quality int"


def terms_of(text):
    """(kind, term) -> times: whole words, and the prefixes of longer ones."""
    out = Counter()
    for w in re.findall(r"[0-9a-z]+", text.lower()):
        out["word", w] += 1
        for n in toxicity.PREFIXES:
            if len(w) > n:
                out[n, w[:n]] += 1
    return out


def leaning(held, n, toxic, clean, bar):
    """The likelihood ratio of holding the term among toxic and clean examples, and that it leans to the toxic."""
    a, c = held
    seen = a + c
    parts = [(a, seen * toxic / n), (c, seen * clean / n), (toxic - a, (n - seen) * toxic / n), (clean - c, (n - seen) * clean / n)]
    ratio = 2 * sum(x * math.log(x / due) for x, due in parts if x > 0)
    return ratio > bar and a * clean > c * toxic and seen >= 3


def brute(docs, labels):
    """{id: score} by every cosine of every document with every example."""
    told = defaultdict(int)
    for i, y, _ in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            told[i] = max(told[i], y)
    examples = {}
    for i, text, _ in docs:
        if i in told and text is not None:
            y, least = examples.get(text, (0, i))
            examples[text] = max(y, told[i]), min(least, i)
    n, toxic = len(examples), sum(y for y, _ in examples.values())
    held = defaultdict(lambda: [0, 0])
    for text, (y, _) in examples.items():
        for t in terms_of(text):
            held[t][0 if y == 1 else 1] += 1
    lean = set()
    if 0 < toxic < n:
        bar = toxicity.chance_bar(sum(a + c >= 3 for a, c in held.values()))
        lean = {t for t, x in held.items() if leaning(x, n, toxic, n - toxic, bar)}
    vocabulary = {t for t in held if t[0] == "word"} | lean
    rows = [(i, {t: k for t, k in terms_of(text or "").items() if t in vocabulary}) for i, text, _ in docs]
    frequency = Counter(t for _, v in rows for t in v)
    weight = {t: (math.log((1 + len(rows)) / (1 + frequency[t])) + 1) * (toxicity.LEAN if t in lean else 1) for t in vocabulary}

    def unit(v):
        w = {t: (1 + math.log(k)) * weight[t] for t, k in v.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()} if size else {}

    known = [(text, y, unit({t: k for t, k in terms_of(text).items() if t in vocabulary})) for text, (y, _) in examples.items()]

    def vote(v, without=None):
        near = [(round(sum(x * u[t] for t, x in v.items() if t in u), toxicity.DIGITS), y) for text, y, u in known if text != without]
        near = sorted(((c, y) for c, y in near if c > 0), reverse=True)
        if not near:
            return None
        bar = near[min(toxicity.NEIGHBOURS, len(near)) - 1][0]  # all that tie with the last one vote
        chosen = [(1 / (max(0.0, 1 - c) + toxicity.NEAR), y) for c, y in near if c >= bar]
        return sum(w * y for w, y in chosen) / sum(w for w, _ in chosen)

    pairs = [(vote(u, text), y) for text, y, u in known]
    steps = toxicity.isotonic([(v, y) for v, y in pairs if v is not None])
    out = []
    for i, v in rows:
        own = vote(unit(v)) if v else None
        out.append((i, (toxic + 1) / (n + 4) if own is None else float(np.interp(own, *steps)) if len(steps[0]) else own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    plain = ["river", "table", "window", "garden", "letter", "winter", "orange", "market", "silver", "planet", "copper", "basket"]
    insults = ["blockheaded", "blockheads", "dunderous", "dunderhead"]
    docs, labels = [], []
    for i in range(160):
        bad = rng.random() < 0.35
        words = [rng.choice(plain) for _ in range(rng.randrange(3, 25))] + [rng.choice(insults) for _ in range(rng.randrange(1, 4))] * bad
        rng.shuffle(words)
        docs.append((i, " ".join(words), "s"))
        if rng.random() < 0.7:
            labels.append((i, int(bad) if rng.random() < 0.95 else int(not bad), 1))
    docs += [(500, None, None), (501, "", "s"), (502, "unheard words only", "s"), (None, docs[3][1], "s"), (503, docs[3][1], "t"), (3, docs[3][1], "s"), (504, docs[7][1].upper(), "s")]
    return docs, labels + [(None, 1, 0), (5, None, 1), (999, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_equal_every_cosine(spark, seed):
    docs, labels = corpus(seed)
    got = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    mine, theirs = sorted(((r.doc_id, r.score) for r in got), key=key), sorted(want, key=key)
    assert [i for i, _ in mine] == [i for i, _ in theirs]
    assert [s for _, s in mine] == pytest.approx([s for _, s in theirs], abs=1e-9)
    assert len({round(s, 6) for _, s in mine}) > 2 and any(s >= 0.5 for _, s in mine)
    by_text = defaultdict(set)
    text_of = {i: t for i, t, _ in docs}
    for r in got:
        if r.doc_id is not None:
            by_text[(text_of[r.doc_id] or "").lower()].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # equal texts, equal scores


def test_labels_of_one_kind_alone(spark):
    docs, labels = corpus(3)
    for only in (0, 1):
        some = [x for x in labels if x[1] == only and x[0] is not None]
        got = sorted((r.doc_id or -1, r.score) for r in toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(some, LABELS)).collect())
        assert [s for _, s in got] == pytest.approx([s for _, s in sorted((i or -1, s) for i, s in brute(docs, some))], abs=1e-9)
