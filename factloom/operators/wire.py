"""Records on their way between processes: everything a rule or an explanation can read as one text, and differences that carry what was dropped.

A record that comes back is taken as it is. Merging it anew would count evidence twice because it travelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFLICT = "struct<kept:string,kept_source:string,rejected:string,rejected_source:string>"
FACT = f"struct<seq:bigint,name:string,value:string,vtype:string,source:string,confidence:double,corroborated_by:array<string>,conflicts:array<{CONFLICT}>>"
COLUMNS = ("seq", "name", "value", "vtype", "source", "confidence", "corroborated_by", "conflicts")


def to_wire(records: DataFrame) -> DataFrame:
    """(item_id, wire): each item's merged facts (item_id and COLUMNS, vtype may be missing) as JSON, in the order they were found. An item's facts are few."""
    full = records if "vtype" in records.columns else records.withColumn("vtype", F.lit("string"))
    facts = F.array_sort(F.collect_list(F.struct(*COLUMNS)))
    return full.groupBy("item_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), facts.alias("facts"))).alias("wire"))


def from_wire(wires: DataFrame) -> DataFrame:
    """The facts of (item_id, wire). A text that isn't a record, or is of another version, raises an error when it is read."""
    record = F.from_json("wire", f"struct<version:int,facts:array<{FACT}>>")
    whole = F.when(record["version"] == 1, record["facts"])
    told = wires.select("item_id", F.coalesce(whole, F.raise_error(F.concat(F.lit("not a record: "), F.coalesce(F.left("wire", F.lit(60)), F.lit("null")))).cast(f"array<{FACT}>")).alias("_facts"))
    return told.select("item_id", F.inline("_facts"))


DELTA = ("item_id", *COLUMNS, "dropped")


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """DELTA rows that make ``before`` into ``after``: facts it lacks, and names that are gone (``dropped``, with nulls for the rest). Facts that both have aren't compared: what was there stays."""
    keys = ["item_id", "name"]
    new = after.join(before.select(*keys), keys, "left_anti").select("item_id", *COLUMNS, F.lit(False).alias("dropped"))
    gone = before.select(*keys).join(after.select(*keys), keys, "left_anti")
    return new.unionByName(gone.withColumn("dropped", F.lit(True)), allowMissingColumns=True)


def apply_difference(record: DataFrame, delta: DataFrame) -> DataFrame:
    """The record with a delta's facts where it has none of that name, and without the names that it drops.

    One full outer join on (item, name): what the record has keeps its corroboration and conflicts, whatever the delta says; a dropped name that it lacks is nothing. Of several
    delta rows of one name a fact counts before a drop, and then the first found.
    """
    keys = ["item_id", "name"]
    rest = [c for c in COLUMNS if c != "name"]
    said = delta.groupBy(*keys).agg(F.min(F.struct("dropped", F.struct(*rest).alias("fact"))).alias("_d"))
    own = record.select(*keys, F.struct(*rest).alias("_own"))
    both = own.join(said, keys, "full")
    gone = F.col("_d.dropped")
    kept = F.when(F.col("_own").isNotNull(), F.when(~F.coalesce(gone, F.lit(False)), F.col("_own"))).when(~gone, F.col("_d.fact"))
    return both.select(*keys, kept.alias("_f")).where("_f is not null").select("item_id", "name", "_f.*").select("item_id", *COLUMNS)


def drop(record: DataFrame, *names: str) -> DataFrame:
    """The record without facts of these names, for what is no longer so once another reader has been there."""
    return record.where(~F.col("name").isin(*names)) if names else record
