import importlib

import corpus_pipeline
from factloom.llm import toxicity
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_similar import brute_groups

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_on_its_predecessor_s_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, now = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        now = spark.createDataFrame(out.collect(), out.schema)
        old = texts(before)
        if name != "packing":
            assert now.columns == docs.columns
            new = texts(now)
            assert now.count() == len(new) and all(r.n_chars == len(r.text) for r in now.collect())
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
            assert new == {k: v for k, v in old.items() if k not in bad}
        elif name == "line_dedup":
            assert new == {i: t for i, t, *_ in brute_lines(list(old.items()))}
        elif name == "simhash_near_dedup":
            classes = brute_groups(list(old.items()))  # the stage's own rule: five-word shingles at 0.8, not op8's two bits
            assert new == {i: t for i, t in old.items() if classes[i] == i}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {d for d, _ in brute_leaks(old.items(), items)}
            assert new == {k: v for k, v in old.items() if k not in leaks}
        else:
            assert check_packing(now.collect(), list(old.items())) > 0
        before = now
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(now)


def test_stages_stand_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, "s", None), (3, "same text twice", "x", "y", 15), (3, "same text twice", "x", "y", 15), (4, "w " * 30_000, None, None, 60_000)], schema)
    for frame in (odd, odd.limit(0)):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            if name == "packing":
                assert (out.count() > 0) == (frame is odd)
                break
            now = spark.createDataFrame(out.collect(), schema)
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
