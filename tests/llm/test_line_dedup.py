import string
from collections import defaultdict

from pyspark.sql import types as T

from factloom.llm import line_dedup

UPPER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs=3):
    """[(id, kept text, lines, dropped)] of rows (id, text)."""
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def same(spark, rows, schema="doc_id long, text string, bitmap string"):
    frame = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = [(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in line_dedup.dedup_lines(frame).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_odd_lines(spark):
    a, b = "This line is shared by several texts", "  ÉTÉ: another shared line, long enough\t"
    rows = [
        (1, f"{a}\nown one\n{b}\n{a}"), (2, f"x\n {a.upper()} \r\n{b}"), (3, f"{a}\n{b}\n{a}\nend"), (4, f"{a}"), (5, None), (6, ""), (None, f"{a}\n{b}"),
        (7, "short line\n\n\n"), (8, "short line"), (9, "short line"), (10, b.lower()), (4, "same id, other text\n" + a), (4, "same id, other text\n" + a),
        (11, "\n".join([a] + [f"line number {k} of a very long document" for k in range(5000)] + [b])),
        (12, "\n".join(f"line number {k} of a very long document" for k in range(0, 5000, 3))), (13, "\n".join(f"line number {k} of a very long document" for k in range(0, 5000, 2))),
    ]
    same(spark, rows)


def test_a_line_in_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", 20)
    rows = [(k, "\n".join(["a very frequent line, in so many documents"] * (k % 3 == 0) + [f"a line that three documents share {k // 3}", f"only here {k}" * 4])) for k in range(300)]
    same(spark, rows)


def test_whole_table_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    same(spark, [tuple(r) for r in docs])
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_are_cut_and_hold_a_bit_per_line(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    shared = "a line that all three documents share"
    rows = [(k, "\n".join(["x"] * 130 + [shared] + ["y"] * 500)) for k in range(3)]
    got = {r.doc_id: r.bitmap for r in line_dedup.drop_bitmaps(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: [0, 0, 4], 1: [0, 0, 4]}


def test_keep_bitmaps_are_compressed(spark):
    long = "a line that is long enough to count"
    own = [f"line number {k} of its own, long enough" for k in range(400)]
    rows = [(1, "\n".join([*own[:200], long, *own[200:], long]), None), (2, long, None), (3, long, None), (4, "\n".join(own[:3]) + " alone", None)]
    got = {r.doc_id: [tuple(x) for x in r.kept] for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    clear = lambda p: ~(1 << p) if p < 63 else (1 << 63) - 1
    assert got == {1: [(200 // 64, clear(200 % 64)), (401 // 64, clear(401 % 64))], 2: [(0, clear(0))]}
