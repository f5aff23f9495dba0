"""Plans of what a decision would do: collisions of destinations, members beside their primary, items to pass over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.language import glob_pattern
from factloom.state import cut


#: Suffixes that are tried; a name that is taken so often is given up.
MOST_SUFFIXES = 9_999


def resolve_collisions(plan: DataFrame, existing: DataFrame, id_col: str = "id", path_col: str = "destination", order: list[Column] | None = None) -> DataFrame:
    """The plan with ``final``: a destination that is taken, case apart, gets `` (2)``, `` (3)`` and so on before its extension.

    The first item by ``order`` (default: id) keeps a free name. Suffixed names that clash with other names are moved on
    in further rounds, whose rows are written; a round without a clash is the last, and each round settles at least the first of every name.
    ``existing``: (path) that are there already. An item beyond the last suffix has a null ``final``.
    """
    rank = order or [F.col(id_col)]
    base, ext = F.regexp_replace("_want", r"(\.[^./]{1,10})$", ""), F.regexp_extract("_want", r"(\.[^./]{1,10})$", 1)
    taken = existing.select(F.lower("path").alias("_key")).distinct()
    rest, done = plan.withColumn("_want", F.col(path_col)), []
    while True:
        there = taken.withColumn("_there", F.lit(1))
        keyed = rest.withColumn("_key", F.lower("_want")).join(there, "_key", "left").withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(*rank)) + F.coalesce("_there", F.lit(0)))
        numbered = F.when(F.col("_n") == 1, F.col("_want")).when(F.col("_n") <= MOST_SUFFIXES, F.concat(base, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))
        tried = keyed.withColumn("final", numbered).drop("_key", "_there", "_n")
        first = F.row_number().over(W.partitionBy(F.lower("final")).orderBy(F.col("final") != F.col("_want"), *rank))
        judged = cut(tried.withColumn("_k", first).withColumn("_key", F.lower("final")).join(there, "_key", "left"))
        settled = F.col("final").isNull() | ((F.col("_k") == 1) & F.col("_there").isNull())
        done.append(judged.where(settled).drop("_key", "_k", "_there", "_want"))
        again = judged.where(~settled)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        taken = cut(taken.unionByName(judged.where(settled & F.col("final").isNotNull()).select("_key")).distinct())
        rest = again.select(*plan.columns, F.col("final").alias("_want"))


def member_destinations(members: DataFrame, primary_col: str, member_col: str, destination_col: str) -> DataFrame:
    """``final`` of each member of a bundle: beside its primary's destination, with the primary's new stem in place of the old."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    stem = lambda c: F.regexp_replace(name(c), r"\.[^.]*$", "")
    own, old, new = name(F.col(member_col)), stem(F.col(primary_col)), stem(F.col(destination_col))
    renamed = F.when(own.startswith(old), F.concat(new, F.substring(own, F.char_length(old) + 1, F.char_length(own)))).otherwise(own)
    folder = F.regexp_replace(destination_col, r"/[^/]*$", "")
    return members.withColumn("final", F.when(F.col(member_col) == F.col(primary_col), F.col(destination_col)).otherwise(F.concat(folder, F.lit("/"), renamed)))


#: Hidden names; this engine's own, beside the fixed ones.
HIDDEN = (".*",)
# Names that no plan touches.
BUILT_IN_IGNORES = ("*.part", "*.crdownload", "*.download", "*.tmp", "~$*", ".DS_Store", "Thumbs.db")


def ignored(path: Column, patterns: tuple[str, ...] = BUILT_IN_IGNORES) -> Column:
    """Whether a relative path, its name or any folder of it fits one of the globs, case apart."""
    if not patterns:
        return F.lit(False)
    any_of = "(?s)" + "|".join(f"({glob_pattern(p.lower()).removeprefix('(?s)')})" for p in patterns)
    low = F.lower(path)
    return low.rlike(any_of) | F.exists(F.split(low, "/"), lambda p: p.rlike(any_of))


def ignored_by_rules(path: Column, lines: list[str]) -> Column:
    """Ordered ignore lines, ``!`` negating: the last line that fits decides."""
    out = F.lit(False)
    for line in lines:
        pattern = line.strip()
        if not pattern or pattern.startswith("#"):
            continue
        keep = pattern.startswith("!")
        fits = ignored(path, (pattern.lstrip("!").rstrip("/"),))
        out = F.when(fits, F.lit(not keep)).otherwise(out)
    return out


def skip_reason(path: Column, age_seconds: Column, settle_seconds: float, link: Column | None = None, ignore: tuple[str, ...] = HIDDEN + BUILT_IN_IGNORES) -> Column:
    """Why an item isn't planned, null if it is: ignored, a link, or still changing."""
    return F.coalesce(
        F.when(ignored(path, ignore), "ignored"), F.when(link if link is not None else F.lit(False), "symbolic link"), F.when(age_seconds.isNull(), "could not be read"),
        F.when(age_seconds < settle_seconds, "not settled"),
    )


def source_root(path: Column, roots: list[str]) -> Column:
    """The longest watched folder that holds a path."""
    out = F.lit(None).cast("string")
    for root in sorted(roots, key=lambda r: (len(r), r)):
        out = F.when((path == root) | path.startswith(root.rstrip("/") + "/"), root).otherwise(out)
    return out


def stem_key(name: Column) -> Column:
    """The name that sidecars share: extension, copy-free language and flag tags gone, case apart."""
    bare = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,10}$", "")
    return F.regexp_replace(bare, r"(\.(?:[a-z]{2}(?:-[a-z]{2,4})?|forced|sdh|cc|hi|default|thumb|poster|fanart))+$", "")


# Extensions that only accompany another file, and the order of those that lead.
SIDECARS = ("srt", "vtt", "ass", "sub", "idx", "xmp", "nfo", "txt", "json", "aae", "thm")
LEADING = ("mkv", "mp4", "mov", "avi", "cr2", "nef", "dng", "jpg", "jpeg", "png", "flac", "mp3", "pdf")
ARCHIVE_PARTS = r"(?i)^(.+?)(?:\.part\d+\.rar|\.r\d{2}|\.z\d{2}|\.7z\.\d{3}|\.zip\.\d{3}|\.\d{3})$"


def bundles(files: DataFrame, dir_col: str = "dir", name_col: str = "name", size_col: str = "size") -> DataFrame:
    """(dir, key, primary, members, n, size, reason): archives in parts, and files that share a stem with a sidecar.

    A file alone is a bundle of itself. Primaries: no sidecar, then the leading formats' order, then the largest, then by name.
    """
    ext = F.regexp_extract(F.lower(name_col), r"\.([a-z0-9]{1,10})$", 1)
    part = F.regexp_extract(F.lower(name_col), ARCHIVE_PARTS, 1)
    sidecar = ext.isin(*SIDECARS)
    place = F.array_position(F.array(*map(F.lit, LEADING)), ext)
    rows = files.select(
        F.col(dir_col).alias("dir"), F.col(name_col).alias("name"), F.col(size_col).alias("size"), part.alias("_part"), sidecar.alias("_side"), F.when(place == 0, 99).otherwise(place).alias("_lead"), stem_key(F.col(name_col)).alias("_stem"),
    )
    with_side = rows.groupBy("dir", "_stem").agg(F.max("_side").alias("_has"), F.count(F.when(~F.col("_side"), 1)).alias("_mains")).where("_has and _mains >= 1")
    tagged = rows.join(with_side, ["dir", "_stem"], "left")
    parts = rows.where("_part <> ''").groupBy("dir", "_part").agg(F.count(F.lit(1)).alias("_parts")).where("_parts >= 2")
    tagged = tagged.join(parts, ["dir", "_part"], "left")
    key = F.when(F.col("_parts").isNotNull(), F.concat(F.lit("part:"), "_part")).when(F.col("_has").isNotNull(), F.concat(F.lit("stem:"), "_stem")).otherwise(F.concat(F.lit("file:"), "name"))
    reason = F.when(F.col("_parts").isNotNull(), "archive in parts").when(F.col("_has").isNotNull(), "sidecars").otherwise("single")
    lead = F.struct(F.col("_side").cast("int").alias("a"), F.col("_lead").alias("b"), (-F.col("size")).alias("c"), F.lower("name").alias("d"), F.col("name").alias("name"))
    return tagged.withColumn("key", key).withColumn("reason", reason).groupBy("dir", "key", "reason").agg(
        F.min(lead)["name"].alias("primary"), F.array_sort(F.collect_list("name")).alias("members"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")
    ).select("dir", "key", "primary", "members", "n", "size", "reason")


