"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch may hold: texts can be very long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts within a Python worker's memory: a batch ends with the row that reaches either bound.

    These are settings of the session; vector searches put short batches together themselves.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def long_batches(spark: SparkSession) -> None:
    """Arrow's own bounds again, for jobs over rows of a few numbers; ``short_batches`` comes after."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, under names of its own, so that no other column can clash; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Stands for a null id in Python workers, where a null would turn a batch's ids into floats.
NO_ID = -(1 << 63)


def python_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_and_text`` for Python workers, with the columns of ``keep``; ``real_ids`` undoes what it does to null ids."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def real_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
