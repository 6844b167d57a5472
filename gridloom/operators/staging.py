"""Small tables written to the folder that all executors share, in place of cached ones.

A staged table survives lost executors, its rows (and any numbers given to them) never
change, and its files go when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where it may be unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            root = context.getCheckpointDir().get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def at_end(spark: SparkSession, path: str) -> None:
    """Delete the path when the application ends, if it can still be reached then."""

    def run():
        with contextlib.suppress(Exception):
            delete(spark, path)

    atexit.register(run)


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
