"""Shared storage: cutting a lineage by a written table, dropping it, and checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a local one, for a local master
    only: executors elsewhere would not see it."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file:///tmp/checkpoints/pairwright-{context.applicationId}"
        context.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/pairwright/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, so a lost executor costs no recomputation
    and every later use sees the same rows."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete what `cut` wrote, once nothing reads it any more; tables that `cut` didn't return are left alone."""
    for df in tables:
        path = None if df is None else vars(df).get("_written")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within the stated bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df
