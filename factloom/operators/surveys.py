"""Counting a collection's values without paying for identifiers: distinct values up to a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_DISTINCT, VALUE_CHARS, SALTS = 4000, 120, 64


def _first_seen(facts: DataFrame) -> DataFrame:
    value = F.left(F.col("value").cast("string"), F.lit(VALUE_CHARS))
    return facts.where("value is not null").groupBy("fact", value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def capped_facts(facts: DataFrame, cap: int = MAX_DISTINCT) -> DataFrame:
    """(fact, items, distinct, overflowed, full_at): which facts have too many values to be categories, as one reader of all items in order would find.

    ``facts``: fact, value, at, a number that orders the items. Such a reader counts values until it knows ``cap`` of them (``full_at`` is the
    item that brings the last one) and gives a fact up at its next item, whatever its value. So a fact with just ``cap`` values overflows
    unless no item follows the last first sight. Values count by their first 120 characters; nulls don't. First sights are
    ranked in two levels, so no fact's values are one task's work.
    """
    seen = _first_seen(facts)
    some = W.partitionBy("fact", F.pmod(F.xxhash64("value"), F.lit(SALTS))).orderBy("first")
    early = seen.select("fact", "first", F.row_number().over(some).alias("_k")).where(F.col("_k") <= cap)
    ranked = early.withColumn("_k", F.row_number().over(W.partitionBy("fact").orderBy("first")))
    full = ranked.where(F.col("_k") == cap).select("fact", F.col("first").alias("full_at"))
    whole = seen.groupBy("fact").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("distinct"), F.max("last").alias("_last"))
    joined = whole.join(full, "fact", "left")
    return joined.select("fact", "items", "distinct", F.coalesce(F.col("_last") > F.col("full_at"), F.lit(False)).alias("overflowed"), "full_at")


def capped_values(facts: DataFrame, cap: int = MAX_DISTINCT) -> DataFrame:
    """(fact, value, n) of the facts that don't overflow; several values of one fact and item count each."""
    kept = capped_facts(facts, cap).where("not overflowed").select("fact")
    return _first_seen(facts).join(kept, "fact", "left_semi").select("fact", "value", "n")
