"""Written tables that cut lineage, kept in the folder the cluster names.

``spark.checkpoint.dir`` is read from the session. Where it is unset the tables go below
``spark.sql.warehouse.dir``, which every executor sees too; never to a folder of one machine.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{shared.rstrip('/')}/geoloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it to be on, for tasks that open it themselves."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", store.makeQualified(target).toString())


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    The written table survives the loss of any executor, and its size is known to the
    optimizer, so later joins can choose a broadcast only when it really is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # remembered for discard()
    return out


def growing(df: DataFrame) -> DataFrame:
    """Marks the side of a join whose both sides grow with the input, so neither is broadcast.

    The optimizer takes the compressed size of a written table for its size: one of a few MB may fill hundreds in
    the driver and in every task. Not for joins with a side that stays small.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the written table behind ``df`` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
