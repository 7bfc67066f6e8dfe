"""W2 running offsets and dense row indexes without a single-partition window.

A prefix sum over a whole corpus written as ``sum(n) over (order by k)``
puts every row into one task. Here it is computed in two passes:

1. range-partition the (narrow) rows by the order key, so every task holds
   one contiguous key range, and tag each row with its task (``_pid``);
2. sum ``n`` per ``_pid`` (map-side partial aggregate -> one row per task),
   turn those totals into per-task base offsets with a window over the tiny
   totals table, and add the base to a running sum *within* each task.

With grouping columns the same is done per group: a group that holds a
third of all rows is spread over many range partitions like any other
range, so hot groups do not end up in one task. Only the first group of a
range can have rows in earlier ranges, so the bases are one row per range
at most, however many groups there are, and reach the rows by broadcast.
The rows are then dealt by group and range over a fixed number of tasks
(``partitions``), which run-time coalescing leaves alone: narrow rows
compress so well that a coalesced task would sort far more than its size
says. Rows with a null group are left out.

Callers pass a narrow projection (keys + length); the wide payload is
joined back on the key, so the payload itself is shuffled only once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _n_parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return int(partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_groups(df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    for c in group_cols:
        df = df.where(F.col(c).isNotNull())
    return df


def running_offset(df: DataFrame, length_col: str, order_cols: Sequence[str],
                   group_cols: Sequence[str] = (), out_col: str = "offset",
                   strategy: str = "two_pass", partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``length_col`` over all earlier rows (exclusive
    prefix sum) in ``order_cols`` order, per ``group_cols``.

    ``order_cols`` (with ``group_cols``) must give a total order.
    ``strategy='window'`` is a plain per-group window: use it only when every
    group is bounded in size (e.g. 1,000-row batches).
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    n = F.col(length_col).cast("long")
    if strategy == "window":
        w = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out_col, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))

    p = _n_parts(df, partitions)
    df = _with_groups(df, group_cols)
    # The task tag must be the same for the totals and for the rows. Two
    # separate range exchanges may sample different bounds, so the tagged
    # narrow rows are written once (reliable checkpoint in the shared
    # checkpoint folder) and both branches read that copy.
    ranged = cut_lineage(df.repartitionByRange(p, *group_cols, *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*group_cols, "_pid").agg(F.sum(n).alias("_tot"))
    wb = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group_cols, "_pid", F.sum("_tot").over(wb).alias("_base")).where("_base is not null")
    # one row per range partition: bounded by `p`, safe to broadcast
    joined = ranged.join(F.broadcast(base), on=[*group_cols, "_pid"], how="left").repartition(p, *group_cols, "_pid")
    wr = Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (joined
            .withColumn(out_col, (F.coalesce("_base", F.lit(0)) + F.sum(n).over(wr) - n).cast("long"))
            .drop("_pid", "_base"))


_AGG = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: a + b)}


def running_agg(df: DataFrame, value_col: str, order_cols: Sequence[str], group_cols: Sequence[str] = (),
                fn: str = "min", out_col: str = "running", partitions: int | None = None,
                exclusive_col: str | None = None, count_col: str | None = None) -> DataFrame:
    """Inclusive running min / max / sum in ``order_cols`` order per group, by
    the same two passes as ``running_offset`` (per-task totals, then the
    carry from earlier tasks combined with the in-task running value), so a
    group that holds a third of the rows is still spread over many tasks.
    ``exclusive_col`` also gives the value over the earlier rows only, and
    ``count_col`` the 1-based position of the row in its group (same pass)."""
    agg, combine = _AGG[fn]
    group_cols, order_cols = list(group_cols), list(order_cols)
    p = _n_parts(df, partitions)
    v = F.col(value_col)
    df = _with_groups(df, group_cols)
    ranged = cut_lineage(df.repartitionByRange(p, *group_cols, *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy(*group_cols, "_pid").agg(agg(v).alias("_tot"), F.count(F.lit(1)).alias("_cnt"))
    wb = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group_cols, "_pid", agg("_tot").over(wb).alias("_carry"),
                         F.sum("_cnt").over(wb).alias("_cnt_base")).where("_cnt_base is not null")
    joined = ranged.join(F.broadcast(base), on=[*group_cols, "_pid"], how="left").repartition(p, *group_cols, "_pid")
    wr = Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = agg(v).over(wr)
    carry = F.col("_carry")

    def merge(loc):
        return F.when(carry.isNull(), loc).when(loc.isNull(), carry).otherwise(combine(carry, loc))

    out = joined.withColumn(out_col, merge(local))
    if exclusive_col:
        we = Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(exclusive_col, merge(agg(v).over(we)))
    if count_col:
        out = out.withColumn(count_col, (F.coalesce("_cnt_base", F.lit(0)) + F.count(F.lit(1)).over(wr)).cast("long"))
    return out.drop("_pid", "_carry", "_cnt_base")


def row_index(df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (),
              out_col: str = "idx", strategy: str = "two_pass", partitions: int | None = None) -> DataFrame:
    """Dense 0-based row index in ``order_cols`` order (per group)."""
    tmp = df.withColumn("_one", F.lit(1))
    return running_offset(tmp, "_one", order_cols, group_cols, out_col, strategy, partitions).drop("_one")


def index_table(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str] | None = None,
                group_cols: Sequence[str] = (), out_col: str = "idx") -> DataFrame:
    """Narrow (keys, idx) table: index computed on the keys only, for joining back."""
    order_cols = list(order_cols or key_cols)
    cols = list(dict.fromkeys([*group_cols, *key_cols, *order_cols]))
    return row_index(df.select(*cols), order_cols, group_cols, out_col)
