"""Exact dedup by skew-safe combining, with DataFrame functions alone.

Equal texts (identical after ASCII white space is deleted) meet in three
steps, and each step groups by the digest *and the full content*:

1. locally: the map side of the first aggregate leaves one row for each text,
   salt and input partition;
2. salted: one row for each text and salt;
3. globally: the salt winners, at most ``salts`` of a text, are combined.

So a text with a third of all rows never lands in one task. The way back to the
documents joins on the digest, whose group side has one narrow row; AQE splits
the document side where it is skewed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import id_and_text, table
from rangevec.sources.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
_ID = Decimal(10) ** 20
_TOP = Decimal(10) ** 19


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = id_and_text(docs, id_col, text_col).withColumn("norm", F.translate("text", BLANKS, ""))
    return base.select("doc_id", "norm", F.length("text").alias("points"), F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points, then the smallest id,
    stays. Null text counts as empty, and empty texts are equal. Repeated rows
    (same id and text) each count in group_size and share one verdict. A null id
    loses against any other and is kept only where all ids of its group are
    null. Other columns are not read. An empty table gives an empty result. Two
    contents with one digest, of which none are known, stop the query.
    """
    rank = F.col("points").cast("decimal(38,0)") * F.lit(_ID) + F.lit(_TOP) - F.coalesce("doc_id", F.lit(2**63 - 1)).cast("decimal(20,0)")
    rows = _digests(docs, id_col, text_col)
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .withColumn("best", rank.cast("decimal(38,0)"))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    whole = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    best = F.max("best")
    winner = F.lit(_TOP) - (best % F.lit(_ID)).cast("decimal(20,0)")
    groups = (
        whole.groupBy("digest")
        .agg(winner.cast("decimal(20,0)").cast("long").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents"))
        .withColumn("group_size", F.when(F.col("contents") > 1, F.raise_error("two contents share a digest").cast("long")).otherwise(F.col("group_size")))
        .where("group_size > 1")
        .select("digest", "keep_id", "group_size")
    )
    groups = materialize(groups, "dedup-groups")
    none = F.lit(2**63 - 1)
    out = rows.select("doc_id", "digest").join(groups, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("keep_id"), none))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS txt, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY length(txt) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
