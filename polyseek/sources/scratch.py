"""A folder for intermediate tables, shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: The folders that steps() has opened, one inside the other.
_inside: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. A local session without that setting (tests) gets a temporary folder;
    on a cluster, where executors would not share it, the setting must be there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):  # local-cluster has executors of their own
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="polyseek-")
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([f"{base.rstrip('/')}/polyseek", *_inside, uuid.uuid4().hex])


def step(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """What ``made`` returns, written to the shared folder and read again; all that it wrote on the way is deleted."""
    path, own = folder(spark), uuid.uuid4().hex
    outer = "/".join([path.rsplit("/", 1)[0], own])
    _inside.append(own)
    try:
        df = made()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _inside.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(outer)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete all that was written to the shared folder: for the end of a job whose results are elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/polyseek")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
