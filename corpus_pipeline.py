"""The corpus pipeline: toxicity, language, near copies, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import langid, near, packing, suffixes, toxicity
from locusframe.llm.blocks import crc32_mod, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that is further than this from each language's profile (1: identical ranks) is in none of them.
LEAST_FIT = 0.25


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of toxicity.THRESHOLD or more go.

    Null and empty texts have the labels' share of toxic ones as their score;
    a null doc_id is scored and never learned from.  Repeated rows stay as
    often as they are; no rows give no rows.  Further columns are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels.filter(crc32_mod("doc_id", 4) != 2))
    return toxicity.score(docs, model, *COLUMNS[1:]).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too), or that resemble no language, go.

    A null doc_id is judged and never learned from.  Repeated rows stay as
    often as they are; no rows, or none with a language, give no rows.
    """
    profiles = langid.learn(docs.filter(crc32_mod("doc_id", 5) != 0))
    found = langid.predict(docs.select(*COLUMNS), profiles, *COLUMNS)
    return found.filter((F.col("lang_pred") != "und") & (F.col("fit") >= LEAST_FIT)).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; so does each row without a doc_id.

    Texts without words are no copies.  Of rows with one doc_id and one text
    one stays; rows with one doc_id and different texts all stay, if any does.
    No rows give no rows.
    """
    stay = near.join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document are cut out. A cut through a character takes the whole character.

    Null texts become empty ones.  Rows of one doc_id, and those without one,
    lose nothing to each other.  No rows give no rows.
    """
    kept = suffixes.dedup(docs, "lang", "source", characters=True).withColumn("text", F.col("kept").cast("string"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens. Null and empty texts are one token; no rows give no rows."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language_id", language_stage), ("jaccard_join", jaccard_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]
#: No SQL can express the stages: tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
