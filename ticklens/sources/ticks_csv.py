"""Raw tick files (S1-S3): CSV (plain, gzip or bzip2), 13 fixed columns, header line, one file per ticker.

File names look like ``<prefix>_<RIC>_<suffix>.csv.gz``; the ticker is the second ``_`` field and
the marketplace is the folder name plus the venue filter (``.BS_`` -> ``BS``). All venues of a
run are one DataFrame (a union of scans), not a loop of jobs.

Row order. ``seq`` numbers the rows of a run from 0, dense and unique over all folders, in the order
(venue, file, place in the file). Plain and bzip2 files are cut into blocks that tasks read apart
and in any order, so the number is not taken from the task: a block's rows lie in one task one
after the other, a first scan counts the rows of every block, and running sums over files and
their blocks give the number of the block's first row. (gzip is not splittable: one block.) The
scans agree on blocks and tasks, since both follow from the files and the session's settings alone.

Convert once to Parquet (``write_ticks_parquet``), partitioned by date, and later jobs get
partition pruning and predicate pushdown on ``ticker``/``time_us``.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.convert import time_of_day_us, to_number
from ..operators.clean import LOCAL_COLUMN
from ..schema import RAW_TICK_SCHEMA, TICK_SCHEMA


SUFFIXES = ".{csv,csv.gz,csv.bz2}"
#: where a row stands: venue of the run, file, first byte of its block, and a number that grows within a block
PLACE = ["_venue", "_file", "_block", "_row"]


def marketplace_name(folder: str, name_filter: str = "") -> str:
    """S3: folder name, plus the filter without ``_`` and ``.`` (e.g. ``DAX MTF BS``)."""
    base = os.path.basename(folder.rstrip("/"))
    suffix = name_filter.replace("_", "").replace(".", "")
    return f"{base} {suffix}" if suffix else base


def read_raw(spark: SparkSession, folder: str, name_filter: str = "") -> DataFrame:
    """S1 + S2: all ``.csv``, ``.csv.gz`` and ``.csv.bz2`` files of ``folder`` whose name contains ``name_filter``.

    Columns stay text; blank fields become NULL. Leading/trailing spaces are kept (the trade
    qualifier test needs the leading space).
    """
    glob = f"*{name_filter}*{SUFFIXES}" if name_filter else f"*{SUFFIXES}"
    return (spark.read.schema(RAW_TICK_SCHEMA)
            .option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("pathGlobFilter", glob)
            .option("mode", "PERMISSIVE")
            .csv(folder)
            .select("*", F.col("_metadata.file_name").alias("_file_name"), F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")))


def typed_ticks(raw: DataFrame, marketplace: str, file_col: str = "_file_name", venue: int = 0) -> DataFrame:
    """C1/C3 + S3: the typed tick columns and the row's place (``PLACE``) from raw text columns.

    The ticker is the row's ``#RIC``; only a blank one is taken from the file name.
    """
    file_ticker = F.element_at(F.split(F.col(file_col), "_"), 2)
    date = F.to_date(F.try_to_timestamp(F.col("`Date[G]`"), F.lit("yyyyMMdd")))
    out = raw.select(
        F.lit(marketplace).alias("marketplace"),
        F.coalesce(F.nullif(F.trim(F.col("`#RIC`")), F.lit("")), file_ticker).alias("ticker"),
        date.alias("date"),
        time_of_day_us(F.col("`Time[G]`")).alias("time_us"),
        F.trim(F.col("`GMT Offset`")).try_cast("int").alias("gmt_offset"),
        F.col("Type").alias("type"),
        F.col("`Ex/Cntrb.ID`").alias("exchange_id"),
        to_number(F.col("Price")).alias("price"),
        to_number(F.col("Volume")).alias("volume"),
        to_number(F.col("`Bid Price`")).alias("bid_price"),
        to_number(F.col("`Bid Size`")).alias("bid_size"),
        to_number(F.col("`Ask Price`")).alias("ask_price"),
        to_number(F.col("`Ask Size`")).alias("ask_size"),
        F.col("Qualifiers").alias("qualifiers"),
        F.lit(venue).alias("_venue"), "_file", "_block", "_row",
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in TICK_SCHEMA.fields if f.name != "seq"], *PLACE)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seq`` in place of ``PLACE``: the number of rows before a row.

    The blocks' counts are a table of one row per block; files are summed first, so the only window
    without a key runs over one row per file.
    """
    file, block = ["_venue", "_file"], ["_venue", "_file", "_block"]
    blocks = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    files = blocks.groupBy(*file).agg(F.sum("_n").alias("_n"))

    def before(w):
        return F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    offsets = blocks.withColumn("_in_file", before(Window.partitionBy(*file).orderBy("_block"))) \
        .join(files.select(*file, before(Window.orderBy(*file)).alias("_files")), file) \
        .select(*block, (F.col("_files") + F.col("_in_file") - F.col("_first")).alias("_offset"))
    out = rows.join(offsets, block).withColumn("seq", F.col("_row") + F.col("_offset"))
    return out.select([F.col(f.name).cast(f.dataType) for f in TICK_SCHEMA.fields])


def read_ticks(spark: SparkSession, folder: str, name_filter: str = "") -> DataFrame:
    """S1-S3 for one (folder, filter) pair."""
    return read_venues(spark, [(folder, name_filter)])


def name_mismatches(raw: DataFrame, file_col: str = "_file_name") -> DataFrame:
    """Files whose name gives another ticker than their rows: file, ric, rows."""
    ric = F.trim(F.col("`#RIC`"))
    return raw.where(ric != F.element_at(F.split(F.col(file_col), "_"), 2)) \
        .groupBy(F.col(file_col).alias("file"), ric.alias("ric")).agg(F.count(F.lit(1)).alias("rows"))


def read_venues(spark: SparkSession, venues: Iterable[tuple[str, str]],
                excluded: Sequence[str] = ()) -> DataFrame:
    """S2 + F5 + U1: every (folder, filter) pair as one DataFrame; excluded tickers dropped.

    Excluded rows are counted in ``seq``, so it does not depend on what is excluded.
    """
    out = None
    for k, (folder, flt) in enumerate(venues):
        rows = typed_ticks(read_raw(spark, folder, flt), marketplace_name(folder, flt), venue=k)
        out = rows if out is None else out.unionByName(rows)
    out = numbered(out)
    return out.filter(~F.col("ticker").isin(*excluded)) if excluded else out


def write_ticks_parquet(ticks: DataFrame, path: str, mode: str = "overwrite",
                        slice_rows: int = 1 << 20, max_records_per_file: int = 4_000_000) -> None:
    """Store typed ticks as Parquet partitioned by date, rows sorted by (ticker, seq) in files.

    The sort starts with the partition column: the writer asks for that order, and a sort that
    lacks it would be replaced by the writer's own.

    Write tasks are keyed by (date, ticker, seq slice), so a date or a ticker that holds a large
    share of all rows is still spread over many tasks and files.
    """
    sl = F.floor(F.col("seq") / F.lit(slice_rows))
    ticks.repartition("date", "ticker", sl).sortWithinPartitions("date", "ticker", "seq") \
        .write.mode(mode).option("maxRecordsPerFile", max_records_per_file).partitionBy("date").parquet(path)


def read_ticks_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Typed ticks as stored, with the local time if staging stored it."""
    stored = spark.read.parquet(path)
    local = [c for c in stored.columns if c == LOCAL_COLUMN]
    return stored.select(*TICK_SCHEMA.fieldNames(), *local)
