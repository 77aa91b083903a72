"""Exact deduplication by 128-bit content hash (operator 4), DataFrame functions only.

Texts are equal when they are identical after white space (space, tab to return) is deleted. A first
scan writes a narrow table (doc_id, length, MD5 and SHA-256 of the normalised text); rows are grouped
by the MD5 there. A second scan reads only the texts whose hash occurs more than once and compares
their bytes by grouping on (hash, normalised text), where every task first merges its own copies, so
a hot text costs one row per task. A hash under which two different texts meet is a collision; its
rows are told apart by SHA-256. Unique texts are never shuffled unless more than ``BROADCAST_HASHES``
hashes repeat; then the second scan meets the hashes in a sort-merge join.

Of equal texts the row with the most code points, then the smallest doc_id stays; null texts count
as empty, and empty texts are equal to each other. Rows with a null doc_id belong to their group,
but one stays only if the group has no other. Repeated doc_ids count as rows of their own. A text of
any length is read whole, one at a time; an empty table has an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import ASCII_SPACE, stored, text_of

#: rows of 16-byte hashes, or of groups, that are broadcast at most (their number is counted first)
BROADCAST_HASHES = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, ASCII_SPACE + "+", "")


def _bounded(rows: DataFrame) -> DataFrame:
    """A written table, broadcast if it is proven small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_HASHES else rows


def _groups(narrow: DataFrame, *keys: str) -> DataFrame:
    """Size and keeper of every group of two rows or more."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("_chars")).alias("c"),
                           F.col("doc_id").alias("id")))
    return (narrow.groupBy(*keys).agg(F.count("*").alias("_size"), least.alias("_keep")).where("_size > 1")
            .select(*keys, "_size", F.col("_keep.id").alias("_keep_id")))


def _settled(narrow: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Every row with its group; a row without one is alone and stays."""
    rows = narrow.join(_bounded(groups), list(keys), "left")
    alone = F.col("_size").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("_keep_id"))).alias("kept"), "text_sha256")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``."""
    texts = docs.select("doc_id", text_of().alias("_text"))
    texts = texts.select("doc_id", F.length("_text").cast("long").alias("_chars"),
                         normalised(F.col("_text")).alias("_norm"))
    hashed = texts.withColumn("_hash", F.unhex(F.md5("_norm")))
    narrow = stored(hashed.select("doc_id", "_chars", "_hash", F.sha2("_norm", 256).alias("text_sha256")), "hashes")
    groups = stored(_groups(narrow, "_hash"), "hash-groups")

    # bytes compared inside hash groups: one row per (hash, text); collisions have several
    repeated = hashed.select("_hash", "_norm").join(_bounded(groups.select("_hash")), "_hash", "left_semi")
    collided = stored(repeated.groupBy("_hash", "_norm").agg(F.count("*").alias("_copies"))
                      .groupBy("_hash").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_hash"),
                      "collided-hashes")
    if collided.isEmpty():
        return _settled(narrow, groups, "_hash")
    # under a collided hash the text decides; SHA-256 stands for it, as it is in the result anyway
    apart = narrow.join(collided, "_hash", "left_semi")
    split = stored(_groups(apart, "_hash", "text_sha256"), "split-groups")
    return _settled(narrow.join(collided, "_hash", "left_anti"), groups, "_hash").unionByName(
        _settled(apart, split, "_hash", "text_sha256"))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT norm, count(*) AS group_size,
         (list(doc_id ORDER BY chars DESC, doc_id))[1] AS keep_id
  FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN k USING (norm)
"""
