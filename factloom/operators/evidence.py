"""Merging what readers say of an item into one record, in the order they said it.

The merge depends on order, so each fact's readings are gathered, sorted by
their sequence and folded: the first holds the place; an equal value (spelling and
small numeric differences apart) corroborates it, halving the doubt; a different
one replaces it only with strictly more confidence, which forgets the
corroboration; what loses is kept as a conflict. Readings of one fact of one item are
few, and that is what one fold holds. A sum over partial groups can't stand for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<value:string,source:string,confidence:double,corroborated_by:array<string>,conflicts:array<struct<kept:string,kept_source:string,rejected:string,rejected_source:string>>>"


def flatten(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def same(a: Column, b: Column, kind: Column) -> Column:
    """Whether two values of a kind (string, number, boolean) say the same; numbers within 2 %."""
    x, y = a.try_cast("double"), b.try_cast("double")
    near = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) < 0.02
    return (a == b) | F.when(kind == "number", F.coalesce(near, F.lit(False))).when(kind == "string", flatten(a) == flatten(b)).otherwise(F.lit(False))


def merge_facts(facts: DataFrame) -> DataFrame:
    """(item_id, name, value, source, confidence, corroborated_by, conflicts, seq) from (item_id, seq, name, value, vtype, source, confidence).

    Null and empty values are no facts. ``seq`` is the first reading's; ties of seq are ordered by source, then value.
    """
    given = facts.where(F.col("value").isNotNull() & (F.col("value") != ""))
    reading = F.struct("seq", "source", "value", "vtype", "confidence")
    grouped = given.groupBy("item_id", "name").agg(F.array_sort(F.collect_list(reading)).alias("_r"))
    none = F.array().cast("array<struct<kept:string,kept_source:string,rejected:string,rejected_source:string>>")

    def state(value, source, confidence, backers, conflicts):
        return F.struct(value.alias("value"), source.alias("source"), confidence.alias("confidence"), backers.alias("corroborated_by"), conflicts.alias("conflicts")).cast(STATE)

    def conflict(kept, kept_source, lost, lost_source):
        return F.array(F.struct(kept.alias("kept"), kept_source.alias("kept_source"), lost.alias("rejected"), lost_source.alias("rejected_source")))

    def fold(acc, x):
        agrees = same(acc["value"], x["value"], x["vtype"])
        firmer = F.least(F.lit(1.0), acc["confidence"] + (1 - acc["confidence"]) / 2)
        backed = state(acc["value"], acc["source"], firmer, F.array_append(acc["corroborated_by"], x["source"]), acc["conflicts"])
        replaced = state(x["value"], x["source"], x["confidence"], F.array().cast("array<string>"), F.concat(acc["conflicts"], conflict(x["value"], x["source"], acc["value"], acc["source"])))
        refused = state(acc["value"], acc["source"], acc["confidence"], acc["corroborated_by"], F.concat(acc["conflicts"], conflict(acc["value"], acc["source"], x["value"], x["source"])))
        return F.when(agrees, backed).when(x["confidence"] > acc["confidence"], replaced).otherwise(refused)

    first = F.get("_r", F.lit(0))
    start = state(first["value"], first["source"], first["confidence"], F.array().cast("array<string>"), none)
    folded = grouped.select("item_id", "name", F.aggregate(F.slice("_r", 2, F.size("_r")), start, fold).alias("_m"), first["seq"].alias("seq"))
    return folded.select("item_id", "name", "_m.*", "seq")


def wide(records: DataFrame, names: list[str]) -> DataFrame:
    """One row per item with a column for each named fact; absent facts are null."""
    picked = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return records.where(F.col("name").isin(names)).groupBy("item_id").agg(*picked)


def fill_gaps(record: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("item_id", "name")) -> DataFrame:
    """The record with the facts of a later reading that it lacks; what it has stays."""
    return record.unionByName(fresh.join(record.select(*keys), list(keys), "left_anti"))
