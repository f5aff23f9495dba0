"""License scans: phrases in the words of a text, and an exact containment join of its lines with license templates.

Both use DataFrame functions alone. Words are runs of ASCII letters, digits and
characters beyond ASCII, A-Z lower-cased. The join finds every line that holds
at least ``threshold`` of a template's distinct words: tokens are ordered by how
many lines of the whole corpus hold them, rarest first; a line that reaches the
threshold must hold one of a template's first |T| - a + 1 tokens, where a is the
number needed, must have a of the templates' tokens at all (length), and from
the place of the first shared token on enough must be left on both sides
(position). Only lines that pass are compared whole.

A license that is wrapped over lines is found in windows of a text's words, whatever
its lines: each place of a prefix token is a candidate, the template words around it
must be enough, and then every window over the place that is as long
as the template may be with a fifth of other words in it is compared. The templates are a fixed
list, so their tokens and prefixes, some hundreds of rows, are what is broadcast.

Texts are split in words once. That pass keeps the phrases' places, the template words of each line
and their places in the text, a small part of it, and is written; all else reads it.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, materialise, small_table, whole_text

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = 0.8

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences by which public licenses are known, and labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "Released under the MIT License"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-text", "Distributed under the terms of the GNU General Public License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-text", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-text", "This text is available under the license CC BY 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "Copyright. All rights reserved"),
)


def words_of(text: Column) -> Column:
    """The words of a lower-cased text in order; none for a text without."""
    spaced = F.btrim(F.regexp_replace(text, NOT_WORD, " "), F.lit(" "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(NOT_WORD, text.lower()) if w})


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    same = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.when(F.size(words) >= len(parts), F.filter(starts, same)).otherwise(F.array().cast("array<int>"))


PLACES = "array<struct<label:string,at:int>>"


def _split(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, lines array<array<string>>, words array<string>, spaced) of each row, lower-cased."""
    rows = df.select(F.col(id_col).alias("doc_id"), ascii_lower(whole_text(text_col)).alias("_low"))
    rows = rows.select("doc_id", F.transform(F.split("_low", "\n", -1), lambda x: F.btrim(F.regexp_replace(x, NOT_WORD, " "), F.lit(" "))).alias("_spaced"))
    lines = F.transform("_spaced", lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))
    rows = rows.select("doc_id", lines.alias("lines"), F.array_join("_spaced", " ").alias("spaced"))
    return rows.select("doc_id", "lines", F.flatten("lines").alias("words"), "spaced")


def _places(phrases: dict[str, str]) -> Column:
    """Every place of a phrase in ``words``, sought only in texts that have its first word at all."""
    none = F.array().cast(PLACES)

    def of(phrase: str, label: str) -> Column:
        at = F.transform(_phrase_places(F.col("words"), phrase), lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))
        return F.when(F.col("spaced").contains(phrase.split()[0]), at).otherwise(none)

    return F.concat(*[of(p, label) for p, label in phrases.items()])


def base_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, places array<struct<label, at>>) of each row: every place where a phrase's words stand together."""
    return _split(df, id_col, text_col).select("doc_id", F.size("words").cast("long").alias("n_words"), _places(phrases).alias("places"))


def _scanned(df: DataFrame, id_col: str, text_col: str, vocabulary: list[str], least: int) -> DataFrame:
    """As ``base_scan``, with the vocabulary's words: ``held`` in each line with ``least`` of them or more, and ``known`` with their places; written."""
    rows = _split(df, id_col, text_col)
    held = F.transform("lines", lambda ws, i: F.struct(i.alias("block"), F.array_distinct(F.filter(ws, lambda w: w.isin(vocabulary))).alias("held")))
    known = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("token"))))
    return materialise(rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), _places(PHRASES).alias("places"),
        F.filter(held, lambda x: F.size(x["held"]) >= least).alias("blocks"), F.filter(known, lambda x: x.isNotNull()).alias("known"),
    ), "license-words")


class _Templates:
    """The templates' words, how many of each must be held, and how many words a window of each may have."""

    def __init__(self, templates, threshold: float):
        self.labels = [label for label, _ in templates]
        self.tokens = [_template_words(t) for _, t in templates]
        self.vocabulary = sorted({w for t in self.tokens for w in t})
        self.need = [math.ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.spread = [math.ceil(len([w for w in re.split(NOT_WORD, t.lower()) if w]) / threshold - 1e-9) for _, t in templates]


def template_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, label, template, containment, block): every line that holds the threshold of a template's distinct words.

    Rows without a block are windows over lines; of these each place that reaches the threshold has one with its best.
    """
    own = _Templates(templates, threshold)
    return _blocks_of(_scanned(df, id_col, text_col, own.vocabulary, min(own.need)), own)


def _blocks_of(scanned: DataFrame, own: _Templates) -> DataFrame:
    spark = scanned.sparkSession
    counted = {r.t: r.n for r in scanned.select(F.explode("known.token").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # the vocabulary's size
    rank = {w: k for k, w in enumerate(sorted(own.vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    rows = []
    for k, (label, tokens, need) in enumerate(zip(own.labels, own.tokens, own.need)):
        ordered = sorted(tokens, key=rank.get)
        held = sorted(rank[x] for x in tokens)
        rows += [(w, k, label, i, len(ordered), need, held, own.spread[k], tokens) for i, w in enumerate(ordered[:len(ordered) - need + 1])]
    kinds = "token string, template int, label string, place int, size int, need int, ranks array<int>, spread int, own array<string>"
    prefixes = F.broadcast(small_table(spark, rows, kinds))
    first = sorted({r[0] for r in rows})

    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    candidates = scanned.select("doc_id", F.inline("blocks")).where(F.exists("held", lambda w: w.isin(first)))
    ordered = candidates.select("doc_id", "block", F.array_sort(F.transform("held", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("token")))).alias("held"))
    probes = ordered.select("doc_id", "block", F.transform("held", lambda x: x["rank"]).alias("held"), F.posexplode("held").alias("at", "_t"))
    joined = probes.select("doc_id", "block", "held", "at", F.col("_t.token").alias("token")).join(prefixes, "token").where(
        (F.size("held") >= F.col("need")) & (F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("held", "ranks"))
    found = joined.where(shared >= F.col("need")).select("doc_id", "block", "label", "template", (shared / F.col("size")).alias("containment")).distinct()

    # A word of the vocabulary takes a place in ``known``, so what is within so many words is within so many entries.
    reach = max(own.spread)
    near = lambda k: F.slice("known", F.greatest(k - reach + 2, F.lit(1)), 2 * reach - 1)
    seeds = F.transform("known", lambda x, k: F.when(x["token"].isin(first), F.struct(x["token"].alias("token"), x["at"].alias("at"), near(k).alias("near"))))
    places = scanned.where(F.exists("known", lambda x: x["token"].isin(first))).select("doc_id", F.inline(F.filter(seeds, lambda x: x.isNotNull())))
    around = places.join(prefixes, "token").withColumn("near", F.filter(
        "near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("spread")) & F.array_contains("own", x["token"])
    )).where(F.size(F.array_distinct("near.token")) >= F.col("need"))
    inside = lambda start: F.filter("near", lambda x: (x["at"] >= start["at"]) & (x["at"] < start["at"] + F.col("spread")))
    starts = F.filter("near", lambda x: x["at"] <= F.col("at"))
    best = F.array_max(F.transform(starts, lambda y: F.size(F.array_distinct(F.transform(inside(y), lambda x: x["token"])))))
    windows = around.withColumn("_best", best).where(F.col("_best") >= F.col("need"))
    return found.unionByName(windows.select("doc_id", F.lit(None).cast("int").alias("block"), "label", "template", (F.col("_best") / F.col("size")).alias("containment")))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    ``labels`` has the base phrases' labels and those of the templates found;
    ``score`` is 1 with a base phrase, else the best containment found, else 0.
    A null or empty text has no words. Rows that repeat an id have a row each,
    and share the templates found in any of them; null ids are one id. Other
    columns aren't read.
    """
    templates = _Templates(TEMPLATES, threshold)
    base = _scanned(df, id_col, text_col, templates.vocabulary, min(templates.need))
    found = _blocks_of(base, templates).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")
    )
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    at = F.transform("places", lambda p: p["at"])
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    return base.join(found, base.doc_id.eqNullSafe(found["_id"]), "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        listed(own).alias("base_labels"),
        listed(F.array_union(own, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
