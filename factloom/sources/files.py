"""Files as items: a folder's tree with the facts that a listing and the first bytes give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import derive
from factloom.functions.names import name_facts
from factloom.sources.signatures import sniff

# Folders that are one thing to their owner, by suffix.
PACKAGES = (".app", ".photoslibrary", ".framework", ".bundle", ".logicx", ".band", ".xcodeproj")
# Extensions by kind and format; a caller may give a table of its own in their place.
EXTENSIONS = (
    ("image", "jpeg", "jpg jpeg"), ("image", "png", "png"), ("image", "gif", "gif"), ("image", "tiff", "tif tiff"), ("image", "webp", "webp"), ("image", "heif", "heic heif"), ("image", "svg", "svg"),
    ("video", "mp4", "mp4 m4v"), ("video", "quicktime", "mov"), ("video", "matroska", "mkv"), ("video", "webm", "webm"), ("video", "avi", "avi"), ("audio", "mp3", "mp3"), ("audio", "flac", "flac"), ("audio", "wav", "wav"),
    ("audio", "ogg", "ogg oga"), ("audio", "m4a", "m4a m4b"), ("document", "pdf", "pdf"), ("document", "docx", "docx"), ("document", "odt", "odt"), ("document", "rtf", "rtf"), ("document", "markdown", "md markdown"),
    ("document", "plain", "txt text log"), ("document", "html", "html htm"), ("document", "xlsx", "xlsx"), ("document", "pptx", "pptx"), ("document", "epub", "epub"), ("subtitle", "subrip", "srt"), ("subtitle", "webvtt", "vtt"),
    ("archive", "zip", "zip"), ("archive", "gzip", "gz tgz"), ("archive", "tar", "tar"), ("archive", "7z", "7z"), ("archive", "rar", "rar"), ("archive", "zstd", "zst"), ("font", "truetype", "ttf"), ("font", "opentype", "otf"),
    ("code", "python", "py"), ("code", "shell", "sh"), ("code", "scala", "scala"), ("data", "json", "json jsonl"), ("data", "delimited", "csv tsv"), ("data", "columnar", "parquet orc avro"), ("data", "sqlite", "sqlite db"),
)


def extension_table(spark: SparkSession, rows=EXTENSIONS) -> DataFrame:
    """(ext, kind, format): a dimension table of fixed size. An extension that several formats use has no row."""
    flat = [(e, k, f) for k, f, exts in rows for e in exts.split()]
    seen = [e for e, *_ in flat]
    return spark.createDataFrame([r for r in flat if seen.count(r[0]) == 1], "ext string, kind string, format string")


def read_items(spark: SparkSession, root: str, max_depth: int = 3, with_bytes: bool = True) -> DataFrame:
    """A row for each file under a folder, down to a depth: stat and name facts, kind and format by bytes, else by extension.

    Hidden files and the insides of packages are left out. With ``with_bytes`` off, contents aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if with_bytes else []))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    inside = F.substr(F.col("path"), F.lit(len(whole) + 2))  # the root is a prefix of every path, whatever characters it has
    parts = F.split(inside, "/")
    packaged = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.lower(p).rlike("(" + "|".join(x.replace(".", r"\.") for x in PACKAGES) + ")$"))
    kept = files.where((F.size(parts) <= max_depth + 1) & ~packaged & ~F.exists(parts, lambda p: p.startswith(".")))
    named = kept.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    facts = named.select("path", "dir", "name", "size", "modified", derive.size_class(F.col("size")).alias("size_class"), *name_facts(F.col("name")), *([sniff(F.col("content")).alias("_s")] if with_bytes else [F.lit(None).cast("struct<kind:string,format:string,confidence:double>").alias("_s")]))
    joined = facts.join(F.broadcast(extension_table(spark).withColumnsRenamed({"kind": "_k", "format": "_f"})), "ext", "left")
    lies = F.col("_s.kind").isNotNull() & (F.col("_s.kind") != F.col("_k")) & (F.col("_s.format") != F.col("_f"))
    return joined.withColumns(
        {"kind": F.coalesce("_s.kind", "_k", F.lit("unknown")), "format": F.coalesce("_s.format", "_f"), "kind_confidence": F.coalesce("_s.confidence", F.when(F.col("_k").isNotNull(), derive.LIKELY)), "extension_lies": F.coalesce(lies, F.lit(False))}
    ).drop("_s", "_k", "_f")
