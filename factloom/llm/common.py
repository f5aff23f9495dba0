"""What the training-data operators share: text expressions and a scratch area."""

from __future__ import annotations

import atexit
import ctypes
import string
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take the JVM's byte loop."""
    only_ascii = F.octet_length(c) == F.char_length(c)
    mapped = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(only_ascii, F.lower(c)).otherwise(mapped)


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where that is unset, a local one on a local master and an error on any other."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = context._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: Dictionaries in which operators keep things in an executor's Python process from task to task.
kept_in_process: list[dict] = []


def drop_what_is_kept() -> None:
    """Empty those dictionaries; tasks that need much memory themselves begin with this, as processes serve many operators."""
    for kept in kept_in_process:
        kept.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library can; a worker that has served a heavy operator holds on to it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what lies there goes when the application ends, as results may read it until then."""
    _scratch.append(f"{scratch_root(spark)}/factloom/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def _delete(context: SparkContext, folder: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear_scratch() -> None:
    context = SparkContext._active_spark_context
    for folder in _scratch if context else ():
        try:
            _delete(context, folder)
        except (Py4JError, OSError):  # the JVM is gone; the folder's owner sweeps what is left
            return


#: While tables are written: a query's shuffle files go when it ends, and Python gets texts in batches of a few megabytes (64 by default), which lie in both processes.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
_lock, _before, _writers = threading.Lock(), {}, 0


@contextmanager
def _settings(spark: SparkSession, batch: str) -> Iterator[None]:
    """Those settings, from the first of several writes at a time to the end of the last; the first one's batches hold for all."""
    global _writers
    with _lock:
        if not _writers:
            for k, v in ((_CLEANUP, "true"), (_BATCH, batch)):
                _before[k] = spark.conf.get(k)
                spark.conf.set(k, v)
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                for k, v in _before.items():
                    spark.conf.set(k, v)


def materialise(df: DataFrame, name: str, codec: str = "snappy", batch: str = "4m") -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts its lineage for good.

    ``codec`` compresses its files; zstd is worth its time for binary values, of which snappy makes nothing less. What was shuffled for it isn't needed again, as the table is whole, so its files go at once.
    ``batch`` bounds the Arrow batches that Python functions get; what works on many rows in step wants larger ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _settings(spark, batch):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a list that the driver holds. It goes to the JVM as Arrow: rows given as a list are read by Python workers, of a second pool beside that of mapInArrow."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows) if rows else [[]] * len(kind)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind))


def one_row_each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the rows that share an id, that whose text has the smallest hash; the other columns of equal texts may come from any of them."""
    free = "_" * (1 + max(map(len, df.columns)))  # no column is called so
    first = F.row_number().over(W.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))
    return df.withColumn(free, first).where(F.col(free) == 1).drop(free)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession.sparkContext, folder)
