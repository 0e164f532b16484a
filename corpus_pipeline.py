"""The corpus pipeline: five stages over ``documents``, each by one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

In every stage: decisions are made by id, so rows that share an id share them,
and rows without an id are judged as one, kept if any of them is. Null text
counts as empty. Empty texts have no language and go in the first stage. Texts
may be of any length. Ties go to the smaller id. Other columns, whatever their
names, are carried along and never read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangevec.llm import decontaminate, exact_dedup, language, packing, simhash
from rangevec.llm.common import crc_of_id, table
from rangevec.sources.scratch import scratch_path

#: A document's best language must have at least this share of its words.
MIN_SHARE = 0.35


def _with(docs: DataFrame, verdict: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` whose id the verdict keeps. Rows that share an id, or have none, go on if any of them does."""
    ids = verdict.where(keep).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_kept_id"]), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on; those without letters, or with no language to speak of, go. Without labelled documents all are undetermined and go."""
    learn = F.pmod(crc_of_id(), F.lit(4)) != 2
    said = language.predict(docs, language.train(docs, learn))
    return _with(docs, said, (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that of the smallest id. Rows that repeat its id stay."""
    return _with(docs, exact_dedup.exact_dedup(docs), F.col("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-copies: five-word shingles, similarity 0.8."""
    found = simhash.simhash_dedup(docs, width=5, similarity=0.8)
    return _with(docs, found, F.col("doc_id").eqNullSafe(F.col("component_id")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Without a benchmark all stay."""
    return _with(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), ~F.col("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; each row is packed by itself, repeated ones too."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontaminate", clean),
    ("packing", packed),
]

#: SQL can't express the language model, fingerprints and tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
