"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept. What a stage decides takes effect: rejected documents are
gone, dropped lines are cut out of the texts. Between stages the table is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, line_dedup, packing, simhash, toxicity
from factloom.llm.common import documents, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Labels are learnt from the original texts, whatever an earlier stage kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, learn_from=documents(spark, sf_dir)).select(*COLUMNS)


def cut_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others share; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Links come from SimHash fingerprints by deletion variants and are verified by whole sets; an exact join finds
    what fingerprints leave apart (see the README).
    """
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8).select(*COLUMNS)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids (little-endian, 32 bits) and their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_shared_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", reject_leaks),
    ("packing", pack_sequences),
]

#: Nearest neighbours, fingerprints, alignment and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
