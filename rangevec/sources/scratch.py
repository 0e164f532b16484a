"""Scratch tables in the folder that driver and executors share.

A scratch table cuts lineage: its files stay when an executor is lost, so a
later stage never recomputes what went before, and two readers of it see the
same rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one (tests, one machine) a folder of our own, noted in the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.rangevec.scratch.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), f"rangevec-{uuid.uuid4().hex}")
        spark.conf.set("spark.rangevec.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/rangevec/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that read them must be written before."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rangevec/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
