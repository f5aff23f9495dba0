"""Cutting a plan's lineage where rounds build on each other."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local master without one takes a temporary folder, any other is refused."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    given = context._jsc.sc().getCheckpointDir()
    if not root and given.isDefined():
        root = given.get()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if not given.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()
