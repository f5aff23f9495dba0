"""Keeping what is known up to date: readings that needn't be made again, facts of waiting items read anew, queues of roots no longer watched, and what a promotion would do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Facts that come from reading a file, which a better reader changes; all others tell where it was and how it came. Fixed values.
READ_FACTS = (
    "heading", "words_read", "text_layer", "needs_ocr", "read_by", "scan_pixels", "scan_of", "doc_title", "author", "producer", "pages", "creator", "encrypted", "needs_password", "encryption_unread", "title_drawn",
)


def recall_readings(files: DataFrame, readings: DataFrame, tools: list[str]) -> DataFrame:
    """(path, tool, delta, recalled): each file's reading by each tool, where one of the file as it is now was kept; others are to be made.

    ``files``: path, fingerprint; ``readings``: path, tool, fingerprint, delta, made_at. Of several readings of one file, tool and fingerprint the latest counts. An empty or null
    fingerprint is of a file that can't be looked at, and recalls nothing. Files given twice count once, with the greatest fingerprint.
    """
    now = files.groupBy("path").agg(F.nullif(F.max("fingerprint"), F.lit("")).alias("fingerprint"))
    asked = now.withColumn("tool", F.explode(F.array(*map(F.lit, tools))))
    kept = readings.groupBy("path", "tool", "fingerprint").agg(F.max_by("delta", F.struct("made_at", "delta")).alias("delta"), F.lit(True).alias("_kept"))
    return asked.join(kept, ["path", "tool", "fingerprint"], "left").select("path", "tool", "delta", F.col("_kept").isNotNull().alias("recalled"))


def refresh_held(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, facts) of the held moves whose facts a new reading changes: facts that come from reading are taken from it, or go if it lacks them; the rest stays.

    ``held``: id, destination, facts (a map of strings); ``fresh``: path, facts of what can be read now. Moves whose files aren't read now stay as they are.
    """
    reading = lambda keep: lambda k, v: (k.isin(*READ_FACTS) & v.isNotNull()) if keep else ~k.isin(*READ_FACTS)
    empty = F.create_map().cast("map<string,string>")
    new = fresh.groupBy(F.col("path").alias("destination")).agg(F.max_by("facts", F.size("facts")).alias("_fresh"))
    both = held.select("id", "destination", F.coalesce("facts", empty).alias("facts")).join(new, "destination")
    updated = F.map_concat(F.map_filter("facts", reading(False)), F.map_filter(F.coalesce("_fresh", empty), reading(True)))
    sorted_ = lambda m: F.array_sort(F.map_entries(m))
    return both.withColumn("_new", updated).where(~sorted_("_new").eqNullSafe(sorted_("facts"))).select("id", F.col("_new").alias("facts"))


def retain_queue(queue: DataFrame, watched: DataFrame, seen: DataFrame) -> DataFrame:
    """The queue without rows of roots that nobody watches, and without what a whole look at its root didn't see.

    ``queue``: root, last_seen and more; ``watched``: root; ``seen``: root, at, the latest whole look at each root. A root without a look keeps its rows.
    """
    looks = seen.groupBy("root").agg(F.max("at").alias("_at"))
    kept = queue.join(watched.select("root").distinct(), "root", "left_semi").join(looks, "root", "left")
    return kept.where(F.col("_at").isNull() | (F.col("last_seen") >= F.col("_at"))).select(*queue.columns)


def promotion_summary(plan: DataFrame, folders: int = 12) -> DataFrame:
    """(level, name, items): how many items a plan promotes in all, by rule, and by folder for the ``folders`` that get most; ties by name.

    ``plan``: id, rule, destination, one row for each item. All three are one aggregation.
    """
    folder = F.regexp_replace("destination", r"/[^/]*$", "")
    levels = F.array(
        F.struct(F.lit("total").alias("level"), F.lit("").alias("name")), F.struct(F.lit("rule").alias("level"), F.col("rule").alias("name")), F.struct(F.lit("folder").alias("level"), folder.alias("name")),
    )
    counted = plan.select(F.inline(levels)).groupBy("level", "name").agg(F.count(F.lit(1)).alias("items"))
    ranked = counted.withColumn("_k", F.row_number().over(W.partitionBy("level").orderBy(F.desc("items"), "name")))  # a row for each rule and folder
    return ranked.where((F.col("level") != "folder") | (F.col("_k") <= folders)).drop("_k")
