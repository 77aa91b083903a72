"""Batches that are stored whole or not at all.

A run writes its tables into a folder of its own, ``<out>/batches/<id>/<table>``, which no reader
looks into. It is published by one row appended to the table ``<out>/manifest``: a single file that
Spark's commit renames into place. Readers take the folders from the manifest, so a run that fails
or is killed before that row leaves no trace in what they read, and one that is repeated starts
anew. Publishing is the only step that makes a batch count; runs follow one another (two runs at a
time on one folder are not foreseen).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("batch", T.StringType()),
    T.StructField("first_date", T.DateType()),
    T.StructField("last_date", T.DateType()),
    T.StructField("tables", T.ArrayType(T.StringType())),
])


@dataclass(frozen=True)
class Batch:
    """A batch that is being written."""

    out_dir: str
    name: str

    def path(self, table: str) -> str:
        return f"{self.out_dir.rstrip('/')}/batches/{self.name}/{table}"

    def write(self, df: DataFrame, table: str, *partition: str) -> None:
        w = df.write.mode("errorifexists")
        (w.partitionBy(*partition) if partition else w).parquet(self.path(table))


def begin(out_dir: str) -> Batch:
    return Batch(out_dir, uuid.uuid4().hex)


def manifest(spark: SparkSession, out_dir: str) -> list:
    """The published batches in order. One row per run: what reaches the driver is a list of runs."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{out_dir.rstrip('/')}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return rows.orderBy("number").collect()


def publish(spark: SparkSession, batch: Batch, first_date, last_date, tables: list[str]) -> None:
    """Make a written batch visible."""
    number = len(manifest(spark, batch.out_dir)) + 1
    row = spark.createDataFrame([(number, batch.name, first_date, last_date, tables)], MANIFEST_SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{batch.out_dir.rstrip('/')}/manifest")


def read_table(spark: SparkSession, out_dir: str, table: str, last_only: bool = False) -> DataFrame | None:
    """Table ``table`` of all published batches (or of the last one) as one DataFrame; None if there is none."""
    names = [r["batch"] for r in manifest(spark, out_dir) if table in r["tables"]]
    if not names:
        return None
    paths = [Batch(out_dir, n).path(table) for n in (names[-1:] if last_only else names)]
    out = spark.read.parquet(paths[0])
    schema = out.schema
    for p in paths[1:]:
        out = out.unionByName(spark.read.schema(schema).parquet(p))
    return out
