"""Stage tables: rows written once in the partitioning that the steps after them need.

A chain of slice windows, summaries and joins over the same ``(group..., slice)`` keys shuffles its
ticks once, in the step that builds the rows. The rows are written bucketed by those keys, a bucket
per shuffle partition, so a write task fills one bucket without a second shuffle, and every reader
takes its columns from the files and needs no exchange for windows, aggregates and joins on the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def partitions(df: DataFrame) -> int:
    """Number of buckets of a stage table: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str] = ()) -> DataFrame:
    """``df`` (hash-partitioned by ``keys`` into ``partitions``) as a table bucketed by ``keys``, its
    files sorted by ``keys`` and ``order``.

    Sorted files make sums over a group's rows the same to the last bit in every run. The files lie in the shared checkpoint folder; the catalogue's entry, which only carries the
    bucketing to the reader's plan, is dropped again.
    """
    spark = df.sparkSession
    table = f"ticklens_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(partitions(df), *keys).sortBy(*keys, *order) \
        .option("path", f"{checkpoint_dir(spark).rstrip('/')}/stages/{table}").saveAsTable(table)
    rows = spark.table(table)
    rows.schema                      # the plan is resolved, with its buckets, before the entry goes
    spark.sql(f"DROP TABLE {table}")
    return rows
