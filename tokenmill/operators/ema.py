"""Exponential moving average with warm-up over ordered series.

    s_n = s_{n-1} - (1 - d_n) (s_{n-1} - x_n),   d_n = min(decay, (1 + n) / (10 + n))

where n counts the updates of the series (1, 2, ...). An update is the affine
map s -> d_n s + (1 - d_n) x_n, and affine maps compose, so the recurrence is
an associative scan, here in built-in expressions:

1. the two-pass running sum gives every row its place and update number, so a
   hot series spans many tasks;
2. ``fan`` consecutive rows of a series form a group and fold into one map,
   ``fan`` groups into one, until each series is one group;
3. on the way down, a group's entering state gives those of its members, and
   at last the average after every row.

Groups are bounded by ``fan``. Each level is ``fan`` times smaller than the one
below. The driver sees one number: the longest series, for the number of levels.

A row whose value is null is no update: it carries the average before it.
Null keys are a series like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .offsets import running_agg


def _in_order(items: Column) -> Column:
    """Structs by their field ``i``; other fields need not be comparable."""
    return F.array_sort(items, lambda x, y: F.when(x["i"] < y["i"], -1).when(x["i"] > y["i"], 1).otherwise(0))


def _folded(items: Column) -> Column:
    """The one map of maps (a, b) in order."""
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(items, one, lambda s, x: F.struct((x["a"] * s["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b")))


def _states(items: Column, entering: Column) -> Column:
    """The states before each map and after the last one."""
    return F.aggregate(items, F.array(entering), lambda s, x: F.concat(s, F.array(x["a"] * F.element_at(s, -1) + x["b"])))


def _grouped(maps: DataFrame, fan: int) -> DataFrame:
    """Groups of ``fan`` rows (_key, i, a, b, ...) of a series: _key, i, items, a, b."""
    rest = [c for c in maps.columns if c != "_key"]
    g = maps.groupBy("_key", F.floor(F.col("i") / fan).cast("long").alias("_i")).agg(F.collect_list(F.struct(*rest)).alias("items"))
    g = g.select("_key", F.col("_i").alias("i"), _in_order(F.col("items")).alias("items")).withColumn("_m", _folded(F.col("items")))
    return g.select("_key", "i", "items", F.col("_m.a").alias("a"), F.col("_m.b").alias("b"))


def ema(df: DataFrame, value_col: str, order_cols: Sequence[str], key_cols: Sequence[str],
        decay: float = 0.9999, init: float = 0.0, out_col: str = "ema", partitions: int | None = None,
        fan: int = 256) -> DataFrame:
    """EMA of ``value_col`` per ``key_cols`` in ``order_cols`` order; adds
    ``out_col`` (the average after each update)."""
    x = F.col(value_col).cast("double")
    rows = running_agg(df.withColumn("_key", F.struct(*key_cols)).withColumn("_u", x.isNotNull().cast("long")),
                       "_u", order_cols, ["_key"], "sum", "_n", partitions, count_col="_at")
    d = F.least(F.lit(float(decay)), (F.col("_n") + 1.0) / (F.col("_n") + 10.0))
    maps = rows.select("_key", (F.col("_at") - 1).alias("i"), F.when(x.isNull(), 1.0).otherwise(d).alias("a"),
                       F.when(x.isNull(), 0.0).otherwise((1.0 - d) * x).alias("b"), F.struct(*df.columns).alias("row"))
    levels = [cut_lineage(_grouped(maps, fan))]
    longest = levels[0].agg(F.max("i")).first()[0] or 0
    while longest > 0:
        levels.append(cut_lineage(_grouped(levels[-1].select("_key", "i", "a", "b"), fan)))
        longest //= fan
    state = None  # (_key, i, s): the state that enters each group of the level below
    for k, level in reversed(list(enumerate(levels))):
        entered = level.withColumn("s", F.lit(float(init))) if state is None else level.join(state, ["_key", "i"])
        moved = entered.select("_key", "items", _states(F.col("items"), F.col("s")).alias("s"))
        if k:
            state = moved.select("_key", F.explode(F.arrays_zip(F.transform("items", lambda m: m["i"]).alias("i"), F.expr(
                "slice(s, 1, size(items))").alias("s"))).alias("m")).select("_key", "m.i", "m.s")
        else:
            out = moved.select(F.explode(F.arrays_zip(F.transform("items", lambda m: m["row"]).alias("row"), F.expr(
                "slice(s, 2, size(items))").alias("s"))).alias("m"))
    return out.select("m.row.*", F.col("m.s").alias(out_col))
