"""Corpus pipeline: documents through the operators of ``ticklens.llm``, stage by stage.

STAGES lists (name, function) in order; a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next stage's docs. All stages but the last
return the columns of ``documents``, extra ones included. What a stage rejects is gone for the
next ones; what it keeps, it keeps whole. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm import decontam, minhash, mixing, tokenfile, toxicity
from ticklens.llm.common import bounded_batches, read, stored, text_of


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold (operator 5)."""
    bounded_batches(spark)
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(text_of(), lexicon) < F.lit(toxicity.THRESHOLD))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id (operator 3).

    Documents without words are linked with nothing and stay. Rows with a null doc_id stay only
    if their group has no document with an id; rows that repeat a kept doc_id stay with it.
    """
    groups = minhash.near_groups(docs)
    kept = groups.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 8)."""
    bounded_batches(spark)
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of under-represented domains repeated (operator 1)."""
    return mixing.repeated(docs, mixing.labelled_domains(docs, read(spark, sf_dir, "labels")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id file of every document that is left, rows as read back from it (operator 7)."""
    bounded_batches(spark)
    return tokenfile.token_file(docs)


STAGES = [("toxicity", non_toxic), ("minhash_near_dedup", near_distinct), ("decontamination", decontaminated),
          ("mixing", mixed), ("token_ids", token_ids)]

#: SQL cannot express the classifier, MinHash and rate-fitting stages; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
