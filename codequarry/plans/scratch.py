"""Cutting lineage with tables in the cluster's shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, whose files go when the session's JVM ends. Only
    a session on one machine may leave that unset; its warehouse serves."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    where = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # else it can't be registered
    fs.deleteOnExit(path)
    return where


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read again."""
    where = folder(df.sparkSession, name)
    df.write.mode("append").parquet(where)
    return df.sparkSession.read.parquet(where)
