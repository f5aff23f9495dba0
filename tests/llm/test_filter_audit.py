import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import types as T

from factloom.llm import filter_audit, queries
from tests.oracle import both

SCHEMA = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("quality", T.StringType()), ("part", T.StringType()))])
LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    out = [""]
    for c in text:
        if c in " \t\n\r\x0b\x0c":
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def fails(text, doc_id, least):
    w = words_of(text)
    return (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text),
            doc_id is not None and doc_id > least)


def brute(rows, labels):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = [(source or "", dict(zip("ABCDE", fails(text or "", i, least.get(text or "", 0)))), i in good, i in toxic) for i, text, source, *_ in rows]
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                redundant = sum(d[0][f] for d in own) - len(gone)
                left = [d for d in left if not d[0][f]]
                only = sum(d[0][f] and sum(d[0].values()) == 1 for d in own)
                shapley[part, f] += len(gone)
                out.append(((part, "".join(order), step), (len(left), len(gone), redundant, only, sum(d[1] for d in gone), sum(d[2] for d in gone)), f))
    return {k: (*v, shapley[k[0], f]) for k, v, f in out}


def found(df, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(df, labels).collect()}


def random_rows(seed, n):
    rng = random.Random(seed)
    texts = [None, "", "word " * 60, " ".join(f"w{k}" for k in range(70)), " ".join(f"w{k}" for k in range(70)) + " #", "CAPS " * 3, "  é x " * 30, "a\x1cb " * 55, " ".join(f"Q{k}" for k in range(60)), "x" * 200_000]
    return [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "a", "b"]), "1", "z") for _ in range(n)]


@pytest.mark.parametrize("fold", [0, 1 << 24])
def test_equals_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(filter_audit, "FOLD_BYTES", fold)
    rows = random_rows(fold, 300)
    labels = [(k % 45 if k % 7 else None, k % 3 if k % 5 else None, k % 2 if k % 4 else None) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(df, spark.createDataFrame(labels, LABELS)) == brute(rows, labels)


def test_texts_of_one_fingerprint_stay_apart(spark):
    chains = filter_audit.Chains()
    out = [x for i, raw in ((5, b"a"), (4, b"b"), (3, b"a"), (9, b"b"), (3, b"a")) for x in chains.meet(1, raw, i, {"p": 1})]
    assert [(i, mask & filter_audit.COPY > 0) for i, mask, _ in out] == [(5, True), (9, True)]
    assert sorted((entry[0], entry[2], entry[3]) for _, entry in chains.drain()) == [(b"a", 3, {"p": 2}), (b"b", 4, {"p": 1})]


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert found(empty, labels) == {}
    rows = random_rows(3, 20)
    assert found(spark.createDataFrame(rows, SCHEMA), labels) == brute(rows, [])


def test_many_copies_are_folded_before_they_are_routed():
    rows = [(k, "p", "one text that repeats") for k in range(10_000)]
    folded = list(filter_audit._folding(rows))
    with_text = [x for _, x in folded if len(x) == 4]
    assert len(with_text) == 1 and len(folded) == 10_000
    counted = defaultdict(int)
    for doc_id, mask, parts in filter_audit._settling(folded):
        counted[mask & filter_audit.COPY > 0] += sum(parts.values())
    assert counted == {True: 9999, False: 1}


def test_query_equals_its_sql(spark):
    mine, theirs = both(spark, queries.op13_filter_audit, queries.OP13_SQL)
    assert mine and mine == theirs
