"""Exact removal of lines that many documents share, in DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
A key of ``min_chars`` code points or more that ``min_docs`` documents hold
keeps its lines in the largest document id alone.

Only 128-bit hashes of keys travel. They are range-partitioned and sorted by
hash, document (largest first) and position, so that a window streams over each
key and sees its first document first. Keys that hold more than a fixed share of
all lines, or more than a fixed number, would be one task's work there; they are counted before
the shuffle instead, and only their totals meet the lines again: broadcast while few, else
by a join that Spark can split. What comes back for each document is a compressed bitmap of the lines to keep:
words of 64 lines that all stay aren't written, and documents that lose none have no bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import ascii_lower, materialise, whole_text

MIN_CHARS, MIN_DOCS = 20, 3
#: A key with more than one in HEAVY_KEYS of all lines, or more than LIGHT_LINES, is frequent.
HEAVY_KEYS, LIGHT_LINES = 2000, 2_000_000
#: Frequent keys are broadcast up to this number of them, and joined by shuffles beyond it.
BROADCAST_KEYS = 100_000
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashed_lines(df: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _row, pos, h1, h2): the long keys of each document, without their texts."""
    keys = F.transform(lines_of(ascii_lower(F.col("_text"))), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(
        keys,
        lambda k, i: F.when(
            F.char_length(k) >= min_chars,
            F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
        ),
    )
    return df.where(F.col("_id").isNotNull()).select(
        "_id", "_row", F.inline(F.filter(hashed, lambda x: x.isNotNull()))
    )


def drop_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, _row, bitmap array<long>): bit p % 64 of word p div 64 is set where line p goes. Documents that lose none have no row.

    Rows with a null id neither count nor lose lines. Rows that repeat an id
    count as one document; ``_row``, a hash of the text, tells their texts
    apart. A null or empty text has one empty line, which is too short to go.
    """
    docs = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).withColumn("_row", F.xxhash64("_text"))
    lines = materialise(_hashed_lines(docs, min_chars), "lines")
    total = lines.count()
    bar = min(max(total // HEAVY_KEYS, min_docs), LIGHT_LINES)
    # No more keys than total / bar are frequent, which proves the bound of what is broadcast.
    few = F.broadcast if total // max(bar, 1) <= BROADCAST_KEYS else lambda keys: keys

    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"))
    heavy_keys = counted.where(F.col("_n") > bar).select("h1", "h2")
    # What is left of the frequent keys after a count per document is one row for each.
    heavy = (
        lines.join(few(heavy_keys), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "_id").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
    )
    heavy = materialise(heavy, "frequent-lines")
    many = heavy.where(F.col("_docs") >= min_docs)
    dropped_heavy = (
        lines.join(few(many), ["h1", "h2"])
        .where(F.col("_id") != F.col("_keeper")).select("_id", "_row", "pos")
    )

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = (
        lines.join(few(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti")
        .repartitionByRange(n, "h1", "h2")
        .sortWithinPartitions("h1", "h2", F.desc("_id"), "pos")
    )
    by_document = W.partitionBy("h1", "h2").orderBy(F.desc("_id"))
    ranked = light.withColumn("_rank", F.dense_rank().over(by_document))
    ranked = ranked.withColumn("_docs", F.max("_rank").over(W.partitionBy("h1", "h2")))
    dropped_light = ranked.where((F.col("_rank") > 1) & (F.col("_docs") >= min_docs)).select("_id", "_row", "pos")

    words = (
        dropped_heavy.unionByName(dropped_light)
        .groupBy("_id", "_row", F.floor(F.col("pos") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("bits"))
    )
    listed = words.groupBy("_id", "_row").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("_w"))
    zeros = lambda k: F.array_repeat(F.lit(0).cast("long"), k)
    dense = F.flatten(
        F.transform(
            "_w",
            lambda e, i: F.concat(
                zeros(e["word"] - F.when(i > 0, F.get("_w", i - 1)["word"]).otherwise(F.lit(-1)) - 1), F.array(e["bits"])
            ),
        )
    )
    return listed.select(F.col("_id").alias(id_col), "_row", dense.alias("bitmap"))


ALL = -1  # a word of 64 bits that are set


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, _row, kept array<struct<word, bits>>): bit p % 64 of word p div 64 is set where line p stays.

    Compressed: words all of whose lines stay are left out, and so are documents that lose no line. Rows as in ``drop_bitmaps``.
    """
    bitmaps = drop_bitmaps(df, id_col, text_col, min_chars, min_docs)
    words = F.transform("bitmap", lambda w, k: F.struct(k.alias("word"), F.bitwise_not(w).alias("bits")))
    return bitmaps.select(id_col, "_row", F.filter(words, lambda x: x["bits"] != ALL).alias("kept"))


def _words_of(kept: Column) -> Column:
    """The bitmap with all its words up to the last one that is written; beyond it every line stays."""
    written = F.map_from_entries(kept)
    return F.transform(F.sequence(F.lit(0), F.element_at(kept, -1)["word"]), lambda k: F.coalesce(F.try_element_at(written, k), F.lit(ALL).cast("long")))


def _stays(words: Column, i: Column) -> Column:
    word = F.coalesce(F.get(words, F.floor(i / 64).cast("int")), F.lit(ALL).cast("long"))
    return F.getbit(word, i % 64) == 1


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The input with its text cut to the lines that stay (joined by \\n), and ``_n_lines`` and ``_n_dropped``.

    Columns of the input that have these two names are replaced; any other name may occur.
    """
    free = "_" * (1 + max(map(len, df.columns)))  # no column is called so
    bitmaps = keep_bitmaps(df, id_col, text_col, min_chars, min_docs).select(
        F.col(id_col).alias(free + "id"), F.col("_row").alias(free + "row"), F.col("kept").alias(free)
    )
    same = (df[id_col] == F.col(free + "id")) & (F.xxhash64(whole_text(text_col)) == F.col(free + "row"))
    joined = df.join(bitmaps.hint("shuffle_hash"), same, "left")
    lines = lines_of(whole_text(text_col))
    # the words are made once a document, not once a line
    staying = F.transform(F.array(_words_of(F.col(free))), lambda words: F.filter(lines, lambda _, i: _stays(words, i)))[0]
    kept = F.array_join(staying, "\n")
    dropped = F.aggregate(free, F.lit(0).cast("long"), lambda a, w: a + 64 - F.bit_count(w["bits"]))
    return (
        joined.withColumns(
            {
                "_n_lines": F.size(lines).cast("long"),
                "_n_dropped": F.coalesce(dropped, F.lit(0).cast("long")),
                text_col: F.when(F.col(free).isNull(), whole_text(text_col)).otherwise(kept),
            }
        ).drop(free, free + "id", free + "row")
    )
