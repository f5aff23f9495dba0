"""Items that belong together: exact duplicates, folders by what they hold, members of a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRONG_SHARE, LIKELY_SHARE = 0.80, 0.60
MIN_SIZE = 4096


def duplicate_groups(items: DataFrame, id_col: str, content_col: str, place: Column, min_size: int = MIN_SIZE) -> DataFrame:
    """(digest, size, copies, keeper, losers, undecided, wasted) of contents that several items hold.

    Sizes go first: only items whose size another one has are hashed. The keeper is in the best
    place, then smallest by id; copies in lesser places are losers, those as well placed are undecided.
    A group is summed, not gathered, so thousands of copies are one row's counts.
    """
    sized = items.select(F.col(id_col).alias("id"), F.octet_length(content_col).cast("long").alias("size"), F.col(content_col).alias("content"), place.alias("place"))
    sized = sized.where(F.col("size") >= min_size)
    several = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    hashed = sized.join(several, "size", "left_semi").select("id", "size", "place", F.sha2("content", 256).alias("digest"))
    groups = hashed.groupBy("digest", "size").agg(
        F.count(F.lit(1)).alias("copies"), F.max("place").alias("best"), F.min(F.struct((-F.col("place")).alias("p"), "id")).alias("k"),
        F.collect_set("place").alias("_places"),
    ).where("copies > 1")
    at_best = hashed.join(groups.select("digest", "size", "best"), ["digest", "size"]).where("place = best").groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n_best"))
    return groups.join(at_best, ["digest", "size"]).select(
        "digest", "size", "copies", F.col("k.id").alias("keeper"), (F.col("copies") - F.col("n_best")).alias("losers"),
        (F.col("n_best") - 1).alias("undecided"), (F.col("size") * (F.col("copies") - F.col("n_best"))).alias("wasted"),
    )


def first_seen(items: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, duplicate_of): the smallest id with the same non-empty content, where that is another one."""
    hashed = items.where(F.octet_length(content_col) > 0).select(F.col(id_col).alias("id"), F.sha2(content_col, 256).alias("digest"), F.octet_length(content_col).alias("size"))
    first = hashed.groupBy("size", "digest").agg(F.min("id").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return hashed.join(first, ["size", "digest"]).where("id <> duplicate_of").select("id", "duplicate_of")


def folder_profiles(items: DataFrame, folder: str, kind: str, size: str) -> DataFrame:
    """(folder, files, bytes, dominant, share, says): the kind with most bytes, by count where there are none; ties by name.

    ``says`` is the kind with its band, or mixed. Two aggregations over sums, so a hot folder costs a row per kind and task.
    """
    per = items.groupBy(folder, kind).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"))
    by = lambda c: F.min(F.struct((-F.col(c)).alias("m"), F.col(kind).alias("k")))
    all_ = per.groupBy(folder).agg(F.sum("n").alias("files"), F.sum("b").cast("long").alias("bytes"), by("b").alias("_b"), by("n").alias("_n"))
    top = F.when(F.col("bytes") > 0, F.col("_b.k")).otherwise(F.col("_n.k"))
    share = F.when(F.col("bytes") > 0, -F.col("_b.m") / F.col("bytes")).otherwise(-F.col("_n.m") / F.col("files"))
    return all_.select(folder, "files", "bytes", top.alias("dominant"), share.alias("share")).withColumn(
        "says", F.when(F.col("share") >= STRONG_SHARE, F.lit("strong")).when(F.col("share") >= LIKELY_SHARE, F.lit("likely")).otherwise(F.lit("mixed"))
    )


def bundle_primaries(members: DataFrame, bundle: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first member of each bundle in an order, with the number of members and the others' total size."""
    ranked = members.withColumn("_rank", F.row_number().over(W.partitionBy(*bundle).orderBy(*order))).withColumn("members", F.count(F.lit(1)).over(W.partitionBy(*bundle)))
    return ranked.where("_rank = 1").select(*bundle, *keep, "members")


def sequences(items: DataFrame, name_col: str, at_least: int = 8) -> DataFrame:
    """(prefix, ext, n, first, last): numbered runs of names, by prefix and extension, with zero-padded numbers of three digits or more."""
    pattern = r"^(.*?)(\d{3,})(\.[A-Za-z0-9]+)?$"
    parts = items.where(F.col(name_col).rlike(pattern)).select(
        F.regexp_extract(name_col, pattern, 1).alias("prefix"), F.regexp_extract(name_col, pattern, 2).alias("number"), F.lower(F.regexp_extract(name_col, pattern, 3)).alias("ext")
    )
    found = parts.groupBy("prefix", "ext").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("number").cast("decimal(38,0)")).alias("first"), F.max(F.col("number").cast("decimal(38,0)")).alias("last"))
    return found.where(F.col("n") >= at_least).select("prefix", "ext", "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
