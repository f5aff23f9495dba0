import math
import re

from pyspark.sql import types as T

from factloom.llm import licenses

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(text):
    low = (text or "").translate(FOLD)
    words = WORD.findall(low)
    places = [(label, i) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    labels, best = {x for x, _ in places}, 0.0
    base = ",".join(sorted(labels))
    for line in low.split("\n"):
        held = set(WORD.findall(line))
        for label, t in licenses.TEMPLATES:
            own = set(WORD.findall(t.lower()))
            if len(held & own) >= math.ceil(0.8 * len(own) - 1e-9):
                labels.add(label)
                best = max(best, len(held & own) / len(own))
    at = [i for _, i in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), 1.0 if places else best


def test_texts_against_brute_force(spark):
    gpl = licenses.TEMPLATES[4][1]
    texts = [
        None, "", "...", "mit license", "MIT-License and the mit   LICENSE; apache_license", "gnu general public gnu general public license", "cc by cc by 4.0 été CC-BY",
        "Summit license", "mit licenses", "the mit\nlicense", gpl, gpl.replace("program ", "").replace("free ", "").upper(), " ".join(gpl.split()[:20]), "\n".join(t for _, t in licenses.TEMPLATES),
        "Copyright (c) 2020. All rights reserved.", "word " * 100_000 + "apache license", " ".join(reversed(gpl.split())) + " and more words", "Redistribution and use in source\nand binary forms, with or without modification",
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "mit license", None)], schema)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(frame).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t
    assert got[None] == brute("mit license")
    assert licenses.scan_licenses(frame.limit(0)).count() == 0
