"""What became of placed items: corrections by hand, undoing a run, items held or still unread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.ledger import placed_moves

#: JSON values that count as no.
NO = ("", "false", "0", "0.0", "[]", "{}")


def corrections(placed: DataFrame, files: DataFrame) -> DataFrame:
    """(id, rule, placed_at, found_at, outcome): placements that are no longer where they were put.

    ``placed``: id, rule, destination, size, digest. ``files``: path, size, digest of what is there now.
    A file of the same name and size with the placement's digest is where it went (of several the smallest path);
    without a digest only a single file of that name and size is. Else the outcome is ``missing``: a guess would teach the wrong lesson.
    Null or empty destinations aren't placements; null paths aren't files. Files are reduced to a row for each
    (name, size) and (name, size, digest) first, so a common name can't multiply rows.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    there = files.where(F.col("path").isNotNull())
    gone = placed.where(F.coalesce(F.col("destination"), F.lit("")) != "").join(there.select(F.col("path").alias("destination")), "destination", "left_anti")
    gone = gone.select("id", "rule", F.col("destination").alias("placed_at"), F.nullif("digest", F.lit("")).alias("_digest"), name(F.col("destination")).alias("_name"), F.col("size").alias("_size"))
    same = there.where(F.coalesce(F.col("digest"), F.lit("")) != "").groupBy(name(F.col("path")).alias("_name"), F.col("size").alias("_size"), F.col("digest").alias("_digest")).agg(F.min("path").alias("_same"))
    alone = there.groupBy(name(F.col("path")).alias("_name"), F.col("size").alias("_size")).agg(F.when(F.countDistinct("path") == 1, F.min("path")).alias("_alone"))
    joined = gone.join(same, ["_name", "_size", "_digest"], "left").join(alone, ["_name", "_size"], "left")
    found = F.when(F.col("_digest").isNotNull(), F.col("_same")).otherwise(F.col("_alone"))
    return joined.select("id", "rule", "placed_at", found.alias("found_at"), F.when(found.isNotNull(), "moved").otherwise("missing").alias("outcome"))


def undo_plan(moves: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, item, id, source, destination, outcome, problem): each run's way back, as if it alone were undone.

    ``moves``: run_id, item, id, source, destination, digest, status, undone_at. Members of an item go back together or not at
    all: an occupied original path, a missing or a changed file stops them all, and ``problem`` is the first in the order of undoing, the last move first.
    A path twice in ``files`` counts once, with its greatest digest; equal null digests are equal.
    """
    back = moves.where((F.col("status") == "done") & F.col("undone_at").isNull()).select(
        "run_id", "item", "id", F.col("destination").alias("source"), F.col("source").alias("destination"), "digest"
    )
    now = files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("digest").alias("_now"))
    checked = back.join(now.select(F.col("path").alias("source"), "_now", F.lit(True).alias("_there")), "source", "left").join(
        now.select(F.col("path").alias("destination"), F.lit(True).alias("_taken")), "destination", "left"
    )
    problem = (
        F.when(F.col("_taken"), F.concat(F.lit("original path is occupied: "), F.col("destination")))
        .when(F.col("_there").isNull(), F.concat(F.lit("moved file is missing: "), F.coalesce("source", F.lit(""))))
        .when(~F.col("_now").eqNullSafe(F.col("digest")), F.concat(F.lit("file changed since it was sorted: "), F.col("source")))
    )
    first = F.max(F.when(F.col("_problem").isNotNull(), F.struct("id", "_problem"))).over(W.partitionBy("run_id", "item"))
    told = checked.withColumn("_problem", problem).withColumn("_first", first)
    return told.select(
        "run_id", "item", "id", "source", "destination", F.when(F.col("_first").isNull(), "restored").otherwise("undo-failed").alias("outcome"),
        F.col("_first._problem").alias("problem"),
    )


def held_moves(moves: DataFrame) -> DataFrame:
    """Placed moves into holding folders whose items are still there; a null ``holding`` is no."""
    return placed_moves(moves).where(F.col("holding") == 1)


def waiting(moves: DataFrame, runs: DataFrame, fact: str, files: DataFrame | None = None, action: str = "sort") -> DataFrame:
    """Placed moves of this action's runs whose facts (JSON) say yes to ``fact``: items that are filed but not read.

    With ``files`` (path) only those still there. Facts that aren't a JSON object, and null facts, don't wait.
    """
    said = F.get_json_object("facts", f"$.{fact}")
    found = placed_moves(moves).where(said.isNotNull() & ~said.isin(*NO))
    found = found.join(runs.where(F.col("action") == action).select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return found if files is None else found.join(files.select(F.col("path").alias("destination")), "destination", "left_semi")


def mirrored(files: DataFrame, folder: Column) -> DataFrame:
    """(folder, files, bytes): how many files a folder holds and their size; files without a folder stand under null."""
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
