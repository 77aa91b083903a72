"""Order-dependent row operators that stay balanced when one group is huge.

Tick series are ordered by ``seq`` (file order). A plain ``Window.partitionBy(ticker, date)``
puts a whole ticker-day into one task; if one instrument holds a third of all rows that task
never finishes. Here every window runs per *slice*: ``(group..., slice)`` with
``slice = seq div slice_rows``, so one window partition never holds more than ``slice_rows``
rows. Values that cross a slice boundary come from a per-slice summary (first/last row, last
non-NULL value) that has one row per non-empty slice; a small window over that summary finds
the neighbouring slice and an equi-join on the slice key brings the value back.

One ``sequence_pass`` does lead, lag and forward fill together: one window over the slices,
one summary hash aggregate (it reads exactly the columns the window reads, so the single hash
shuffle on ``(group..., slice)`` is reused by both), one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_COL = "_slice"
DEFAULT_SLICE_ROWS = 1 << 20


def with_slice(df: DataFrame, order: str = "seq", slice_rows: int = DEFAULT_SLICE_ROWS) -> DataFrame:
    """Add the slice number ``order div slice_rows`` (``order`` is a unique, non-negative id)."""
    return df.withColumn(SLICE_COL, F.floor(F.col(order) / F.lit(slice_rows)).cast("long"))


def partition_by_slice(df: DataFrame, group: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``(group..., slice)``: the one big shuffle of a tick job."""
    keys = [*group, SLICE_COL]
    return df.repartition(num_partitions, *keys) if num_partitions else df.repartition(*keys)


def sequence_pass(df: DataFrame, group: Sequence[str], order: str = "seq",
                  next_cols: Sequence[str] = (), prev_cols: Sequence[str] = (),
                  fill_cols: Sequence[str] = (), fill_group: Sequence[str] | None = None,
                  fill_segments: Sequence[str] = (),
                  next_prefix: str = "next_", prev_prefix: str = "prev_") -> DataFrame:
    """T1 + T3 in one pass over ``(group..., slice)`` partitions (needs ``with_slice``).

    * ``next_<c>`` / ``prev_<c>``: value of the next / previous row within ``group`` ordered by
      ``order`` (NULL at the group end / start, i.e. at the day boundary when ``group``
      holds the date);
    * ``fill_cols``: NULLs replaced by the last non-NULL value earlier in ``fill_group``,
      rows ordered by ``(fill_segments..., order)``; ``fill_group + fill_segments`` must
      equal ``group`` (e.g. fill per ticker across days: fill_group=[ticker],
      fill_segments=[date]).
    """
    group, next_cols, prev_cols, fill_cols = list(group), list(next_cols), list(prev_cols), list(fill_cols)
    fill_group = list(fill_group) if fill_group is not None else group
    fill_segments = list(fill_segments)
    if fill_cols and fill_group + fill_segments != group:
        raise ValueError("fill_group + fill_segments must equal group")
    part = [*group, SLICE_COL]
    w = Window.partitionBy(*part).orderBy(order)
    wf = w.rowsBetween(Window.unboundedPreceding, 0)
    inner_cols, edge_aggs, edge_cols = [], [], []
    # The summary reads every row column (so its input equals the window's and the exchange is
    # reused); one min_by/max_by per column keeps fixed-width buffers, i.e. a hash aggregate
    # without a second sort of the big side.
    row_cols = [c for c in df.columns if c not in part]
    ws = Window.partitionBy(*group).orderBy(SLICE_COL)
    if next_cols:
        inner_cols.append(F.lead(F.struct(*[F.col(c) for c in next_cols]), 1).over(w).alias("_nx"))
        edge_aggs += [F.min_by(F.col(c), F.col(order)).alias(f"_f_{c}") for c in row_cols]
        first = F.struct(*[F.col(f"_f_{c}").alias(c) for c in row_cols])
        edge_cols.append(F.lead(first, 1).over(ws).alias("_nx_edge"))
    if prev_cols:
        inner_cols.append(F.lag(F.struct(*[F.col(c) for c in prev_cols]), 1).over(w).alias("_pv"))
        edge_aggs += [F.max_by(F.col(c), F.col(order)).alias(f"_l_{c}") for c in row_cols]
        last = F.struct(*[F.col(f"_l_{c}").alias(c) for c in row_cols])
        edge_cols.append(F.lag(last, 1).over(ws).alias("_pv_edge"))
    if fill_cols:
        inner_cols += [F.last(c, ignorenulls=True).over(wf).alias(f"_ff_{c}") for c in fill_cols]
        edge_aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_ln_{c}")
                      for c in fill_cols]
        wc = Window.partitionBy(*fill_group).orderBy(*fill_segments, SLICE_COL) \
            .rowsBetween(Window.unboundedPreceding, -1)
        edge_cols += [F.last(f"_ln_{c}", ignorenulls=True).over(wc).alias(f"_ci_{c}") for c in fill_cols]
    if not inner_cols:
        return df
    # Rows without a key cannot belong to a day. Dropping them up front gives both branches the
    # same filters, so the window and the summary share one shuffle (exchange reuse); every
    # slice has a summary row, so the inner join keeps all rows.
    keep = F.col(part[0]).isNotNull()
    for c in part[1:]:
        keep = keep & F.col(c).isNotNull()
    df = df.filter(keep)
    inner = df.select("*", *inner_cols)
    edges = df.groupBy(*part).agg(*edge_aggs).select(*part, *edge_cols)
    out = inner.join(edges, on=part, how="inner")
    new = {}
    for c in next_cols:
        new[next_prefix + c] = F.coalesce(F.col("_nx")[c], F.when(F.col("_nx").isNull(), F.col("_nx_edge")[c]))
    for c in prev_cols:
        new[prev_prefix + c] = F.coalesce(F.col("_pv")[c], F.when(F.col("_pv").isNull(), F.col("_pv_edge")[c]))
    for c in fill_cols:
        new[c] = F.coalesce(F.col(f"_ff_{c}"), F.col(f"_ci_{c}"))
    drop = [c for c in ("_nx", "_nx_edge", "_pv", "_pv_edge") if c in out.columns]
    drop += [f"_ff_{c}" for c in fill_cols] + [f"_ci_{c}" for c in fill_cols]
    return out.withColumns(new).drop(*drop)


def neighbors(df: DataFrame, group: Sequence[str], order: str = "seq",
              next_cols: Sequence[str] = (), prev_cols: Sequence[str] = (),
              next_prefix: str = "next_", prev_prefix: str = "prev_") -> DataFrame:
    """Values of the next / previous row within ``group`` (see ``sequence_pass``)."""
    return sequence_pass(df, group, order, next_cols=next_cols, prev_cols=prev_cols,
                         next_prefix=next_prefix, prev_prefix=prev_prefix)


def forward_fill(df: DataFrame, group: Sequence[str], segments: Sequence[str], cols: Sequence[str],
                 order: str = "seq") -> DataFrame:
    """NULLs in ``cols`` replaced by the last non-NULL value earlier in ``group``, rows
    ordered by ``(segments..., order)`` (see ``sequence_pass``)."""
    return sequence_pass(df, [*group, *segments], order, fill_cols=cols, fill_group=group,
                         fill_segments=segments)
