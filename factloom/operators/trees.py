"""Trees of paths: digests of folders, folders that are one thing and hide what is below, subtitles given back to what they subtitle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.state import cut

#: Hex digits of a name's hash that deal a folder's children out, so that no folder is gathered in one task.
DEALT = 4


def parent_of(path: Column) -> Column:
    """The folder of a relative path; the root is the empty path."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth_of(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def ancestors(path: Column) -> Column:
    """The folders above a path without the root, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folder_digests(entries: DataFrame) -> DataFrame:
    """(path, files, digest) of every folder, the root (the empty path) too: equal digests are equal trees.

    ``entries``: path, kind ("dir", "file", "symlink" or any other), digest of what it holds. Folders that only their contents name
    are made; a folder without any is given by a row of kind "dir". A digest covers its entries' names, kinds and digests and their folders' in turn, sorted by name.
    Folders are folded by levels, the deepest first. Children are gathered by a hash of their names and these
    groups by folder, so a folder of any size is many small groups. A path given twice counts once, with the greatest (kind, digest).
    """
    given = entries.where(F.coalesce(F.col("path"), F.lit("")) != "").groupBy("path").agg(F.max(F.struct(F.coalesce("kind", F.lit("file")).alias("kind"), F.coalesce("digest", F.lit("")).alias("digest"))).alias("_e"))
    given = cut(given.select("path", "_e.kind", "_e.digest", depth_of(F.col("path")).alias("depth")))
    deepest = given.agg(F.max("depth")).first()[0] or 0
    empty = F.sha2(F.lit("directory").cast("binary"), 256)
    leaves = given.where("kind <> 'dir'").select("path", "kind", F.lit(1).cast("long").alias("files"), "digest", "depth")
    made: DataFrame | None = None
    levels = []
    for depth in range(deepest, 0, -1):
        bare = given.where((F.col("kind") == "dir") & (F.col("depth") == depth)).select("path", F.lit(0).cast("long").alias("files"), empty.alias("digest"))
        folders = bare if made is None else made.unionByName(bare.join(made.select("path"), "path", "left_anti"))
        if made is not None:
            levels.append(made)
        levels.append(bare if made is None else bare.join(made.select("path"), "path", "left_anti"))
        children = leaves.where(F.col("depth") == depth).drop("depth").unionByName(folders.select("path", F.lit("dir").alias("kind"), "files", "digest"))
        named = children.select(parent_of(F.col("path")).alias("folder"), name_of(F.col("path")).alias("name"), "kind", "files", "digest")
        written = lambda listed, x: F.array_join(F.transform(F.array_sort(F.collect_list(listed)), x), "")
        some = named.groupBy("folder", F.left(F.sha2("name", 256), F.lit(DEALT)).alias("part")).agg(
            F.sum("files").alias("files"), F.sha2(written(F.struct("name", "kind", "digest"), lambda c: F.concat(c["name"], F.lit("/"), c["kind"], F.lit("/"), c["digest"], F.lit("/"))), 256).alias("digest"),
        )
        whole = F.concat(F.lit("directory"), written(F.struct("part", "digest"), lambda c: F.concat(c["part"], F.lit(":"), c["digest"], F.lit("/"))))
        made = cut(some.groupBy("folder").agg(F.sum("files").alias("files"), F.sha2(whole, 256).alias("digest")).withColumnRenamed("folder", "path"))
    return reduce(DataFrame.unionByName, levels + [made]) if made is not None else given.select("path", F.lit(0).cast("long").alias("files"), "digest")


# Folders that a system shows as one document, by the end of the name in lower case or by the whole name.
PACKAGE_ENDS = (
    ".app", ".bundle", ".framework", ".plugin", ".kext", ".prefpane", ".qlgenerator", ".component", ".mdimporter", ".xpc", ".pages", ".numbers", ".key", ".rtfd", ".textbundle",
    ".sparsebundle", ".photoslibrary", ".aplibrary", ".migpkg", ".fcpbundle", ".imovielibrary", ".theater", ".logicx", ".band", ".xcodeproj", ".xcworkspace", ".playground",
    ".lrcat", ".lrdata", ".aedoc", ".scriv", ".graffle", ".sketch", ".download", ".abbu", ".mpkg", ".pkg", ".idml",
)
PACKAGE_NAMES = ("bdmv", "video_ts", "audio_ts", "certificate", "__macosx", "certificate.stream")
# What in a folder makes it a project, whole names and ends of names, and what kind; the first kind that has one wins.
PROJECT_MARKERS = (
    ("repository", (".git", ".hg", ".svn"), ()),
    ("code", ("package.json", "pyproject.toml", "setup.py", "cargo.toml", "go.mod", "makefile", "cmakelists.txt", "build.gradle", "pom.xml", "gemfile", "composer.json", "dockerfile"), (".sln", ".csproj")),
    ("latex", ("latexmkrc",), (".latexmkrc",)),
    ("audio", (), (".rpp", ".als", ".flp", ".ptx", ".cpr")),
    ("video", (), (".kdenlive", ".prproj", ".aep", ".veg", ".drp")),
    ("3d", (), (".blend", ".uproject", ".godot", ".unity")),
    ("artwork", (), (".kra", ".psd", ".afdesign")),
)
LATEX_COMPANIONS = (".cls", ".sty", ".bib", ".bst", ".bbx", ".cbx")


def _ends(name: Column, ends: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [name.endswith(e) for e in ends], F.lit(False))


def project_kinds(entries: DataFrame) -> DataFrame:
    """(folder, project): folders whose contents only work together, by what lies in them; a LaTeX document needs company and a document class at its head."""
    low = F.lower(name_of(F.col("path")))
    marks = [F.when(low.isin(*names) | _ends(low, ends), k) for k, (_, names, ends) in enumerate(PROJECT_MARKERS)]
    rooted = low.endswith(".tex") & F.coalesce(F.col("head").contains("\\documentclass"), F.lit(False))
    seen = entries.groupBy(parent_of(F.col("path")).alias("folder")).agg(
        F.min(F.least(*marks, F.lit(None).cast("int"))).alias("_k"), F.max(_ends(low, LATEX_COMPANIONS)).alias("_company"), F.max(rooted).alias("_rooted"),
    )
    kind = F.get(F.array(*[F.lit(kind) for kind, *_ in PROJECT_MARKERS]), F.col("_k"))
    return seen.select("folder", F.coalesce(kind, F.when(F.col("_company") & F.col("_rooted"), "latex")).alias("project")).where("project is not null")


def walk(entries: DataFrame, max_depth: int = 3, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, is_dir, reason, project): what a walk of the tree hands out, the loose files (no reason) and whole folders.

    ``entries``: path relative to the root, is_dir, head (the beginning of a .tex file, else null). Packages and projects are handed out whole, and nothing
    in them; hidden and ignored folders hide what they hold. Of such folders on one path the outermost decides. Folders are entered down to ``max_depth``; at 0
    the top-level folders are handed out whole, too. The root is never a project. Paths are judged by folder: each folder's ancestors
    are exploded and joined with the folders that stop, and files follow their folder. Paths given twice count once.
    """
    known = entries.where(F.coalesce(F.col("path"), F.lit("")) != "").groupBy("path").agg(F.max("is_dir").alias("is_dir"), F.max("head").alias("head"))
    above = known.select(parent_of(F.col("path")).alias("path")).distinct().where("path <> ''")
    folders = above.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).unionByName(known.where("is_dir").select("path")).distinct()
    folders = cut(folders)
    everything = known.select("path", "head").unionByName(folders.join(known.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("head")))
    projects = project_kinds(everything)
    low, name = F.lower(name_of(F.col("path"))), name_of(F.col("path"))
    package = low.isin(*PACKAGE_NAMES) | _ends(low, PACKAGE_ENDS)
    reason = F.when(package, "package directory").when(name.startswith(".") | name.isin(*ignore), "").when(F.col("project").isNotNull(), "project folder")
    told = folders.join(projects.withColumnRenamed("folder", "path"), "path", "left").withColumn("reason", reason)
    stops = cut(told.where("reason is not null").select("path", "reason", F.when(F.col("reason") == "project folder", F.col("project")).alias("project")))
    each = folders.select("path", F.explode(ancestors(F.col("path"))).alias("stop"))
    hidden = each.join(stops.select(F.col("path").alias("stop")), "stop", "left_semi").select("path").distinct()
    whole = stops.where((F.col("reason") != "") & (depth_of(F.col("path")) <= max_depth + 1)).join(hidden, "path", "left_anti")
    blocked = hidden.unionByName(stops.select("path")).distinct()
    if max_depth == 0:
        inbox = folders.where(depth_of(F.col("path")) == 1).join(blocked, "path", "left_anti")
        whole = whole.unionByName(inbox.select("path", F.lit("top-level inbox folder").alias("reason"), F.lit(None).cast("string").alias("project")))
    files = known.where(~F.coalesce("is_dir", F.lit(False))).join(folders, "path", "left_anti").select("path", parent_of(F.col("path")).alias("_folder"))
    loose = files.where(depth_of(F.col("_folder")) <= max_depth).join(blocked.withColumnRenamed("path", "_folder"), "_folder", "left_anti")
    none = F.lit(None).cast("string")
    return loose.select("path", F.lit(False).alias("is_dir"), none.alias("reason"), none.alias("project")).unionByName(whole.select("path", F.lit(True).alias("is_dir"), "reason", "project"))


# What a sidecar's stem leaves off, subtitles' extensions, and extensions that only accompany another file.
DECORATION = r"(?i)[-_](poster|fanart|banner|thumb|cover|folder|art|backdrop|logo|clearart|proof)$"
LANGUAGE_TAG = r"(?i)\.(?:[a-z]{2,3}(?:-[a-z]{2,4})?)(?:\.(?:forced|sdh|cc|hi|default))?$"
SUBTITLES = ("srt", "vtt", "ass", "ssa", "sub", "sbv", "ttml", "smi", "lrc")
COMPANIONS = (
    "srt", "vtt", "ass", "ssa", "sub", "idx", "sup", "smi", "sbv", "ttml", "lrc", "nfo", "sfv", "md5", "sha1", "sha256", "cue", "m3u", "m3u8", "aae", "thm", "xmp", "mtl", "bif", "torrent",
    "url", "txt", "log", "jpg", "jpeg", "png", "webp",
)
ONE_TAG = r"^(.+)\.[a-z][a-z0-9-]{1,15}$"


def shared_stem(name: Column) -> Column:
    """The part of a name that a sidecar shares: without extension, one decoration and one language tag, in lower case."""
    bare = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.regexp_replace(name, r"(?s)\.[^.]*$", "")).otherwise(name)
    return F.lower(F.regexp_replace(F.regexp_replace(bare, DECORATION, ""), LANGUAGE_TAG, ""))


def stems_with_adopted(files: DataFrame, dir_col: str = "dir", name_col: str = "name") -> DataFrame:
    """The files with ``stem``, by which those of a folder belong together.

    Subtitles that share a stem among themselves alone, with one more tag than something that isn't a companion file, take
    that one's stem: a tag may be anything, so it comes off only where it leads to what is subtitled.
    """
    ext = F.when(F.instr(F.substring(F.col(name_col), 2, 1 << 20), ".") > 0, F.lower(F.substring_index(name_col, ".", -1))).otherwise("")
    named = files.withColumns({"stem": shared_stem(F.col(name_col)), "_ext": ext})
    groups = named.groupBy(dir_col, "stem").agg(F.min(F.col("_ext").isin(*SUBTITLES)).alias("_only"), F.max(~F.col("_ext").isin(*COMPANIONS)).alias("_leads"))
    tagged = groups.where("_only").select(F.col(dir_col).alias("_dir"), F.col("stem").alias("_stem"), F.regexp_extract("stem", ONE_TAG, 1).alias("_parent")).where("_parent <> ''")
    leaders = groups.where("_leads").select(F.col(dir_col).alias("_dir"), F.col("stem").alias("_parent"))
    adopted = tagged.join(leaders, ["_dir", "_parent"]).select("_dir", "_stem", "_parent")
    joined = named.join(adopted, (F.col(dir_col) == F.col("_dir")) & (F.col("stem") == F.col("_stem")), "left")
    return joined.withColumn("stem", F.coalesce("_parent", "stem")).drop("_dir", "_stem", "_parent", "_ext")
