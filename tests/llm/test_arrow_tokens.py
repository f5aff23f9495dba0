import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from factloom.llm import arrow_tokens
from factloom.llm.tokenizing import tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> it's '  don't 'tis 've\n\n  a  b\t\tc ", "½ x² ", "İstanbul ΣΑΣ", "  ", "", "a_b__c 12 345", "É'sa 'S",
       " x\xa0\xa0 y\x1c z", "ªº µ ß ŉ DŽ", "a\n b\n\nc \r\n d", "\x85\x85q", "日本語 text", "x" * 3000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library_s(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    got = tokenizer(path).many(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids for x in ODD]


def truth(rows):
    plain = Tokenizer.from_file(WORDS)
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [tuple(r) for r in arrow_tokens.round_trip(docs, WORDS).collect()]
    assert sorted(got) == sorted(truth([(r.doc_id, r.text) for r in docs.collect()]))


def test_odd_rows_and_empty_table(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])
    rows = [(i, x, None) for i, x in enumerate(ODD)] + [(None, "a b", "s"), (3, None, None), (3, "again", None), (99, "long words " * 200_000, None)]
    got = [tuple(r) for r in arrow_tokens.round_trip(spark.createDataFrame(rows, schema), WORDS).collect()]
    assert sorted(got, key=lambda r: r[1]) == truth([r[:2] for r in rows])
    assert arrow_tokens.round_trip(spark.createDataFrame([], schema), WORDS).count() == 0


def test_sequences_are_views_and_masked(tmp_path):
    path = str(tmp_path / "x.arrows")
    w = arrow_tokens.FileWriter(pa.OSFile(path, "wb"))
    ids = np.arange(arrow_tokens.SEQUENCE * (arrow_tokens.ROWS + 2) + 5, dtype="<u4")
    w.add(1, ids[:7].tobytes())
    w.add(2, ids[7:].tobytes())
    w.close()
    r = arrow_tokens.FileReader.open(path)
    last = arrow_tokens.ROWS + 2
    got, mask = r.sequence(last)
    assert got[:5].tolist() == ids[-5:].tolist() and mask.true_count == 5
    assert r.sequence(3)[0].tolist() == ids[3 * 2048:4 * 2048].tolist()
    assert r.index.to_pydict() == {"doc_id": [1, 2], "start": [0, 7], "n_tokens": [7, len(ids) - 7]}
