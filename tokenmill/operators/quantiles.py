"""Exact order statistics without one task that holds all distinct values.

1. Values are counted (map-side combined): one row per (group, value).
2. A two-pass running sum over the ordered values gives each value the ranks
   it covers; ranges of a hot group lie in many tasks.
3. A quantile needs at most two ranks, so at most two rows per quantile and
   group survive to the final aggregate, which interpolates between them.

Mean, deviation, bounds and histograms come from the same counted table: the
data are read once.

Nulls are not counted. A group column may be null: it is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .offsets import running_offset


def value_counts(df: DataFrame, value_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """_g (struct of the group columns; 0 without any), v (double), c: written once, as all that follows reads it."""
    g = F.struct(*group_cols) if group_cols else F.lit(0)
    v = F.col(value_col).cast("double")
    return cut_lineage(df.where(v.isNotNull()).groupBy(g.alias("_g"), v.alias("v")).agg(F.count(F.lit(1)).alias("c")))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("_g").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
                                    F.min("v").alias("min"), F.max("v").alias("max"))


def _weight(q: float) -> Column:
    """Share of the row's value in quantile ``q``: linear interpolation between the ranks around q (n - 1)."""
    pos = F.lit(float(q)) * (F.col("n") - 1)
    low = F.floor(pos)
    part = pos - low
    covers = lambda rank: (F.col("_off") <= rank) & (rank < F.col("_off") + F.col("c"))
    return F.when(covers(low), 1.0 - part).otherwise(0.0) + F.when(covers(low + 1), part).otherwise(0.0)


def summary(counts: DataFrame, qs: Sequence[float]) -> DataFrame:
    """_g, count, mean, std (sample), min, max, q (array of the quantiles ``qs``) of a ``value_counts`` table."""
    ranked = running_offset(counts, "c", ["v"], ["_g"], "_off")
    rows = ranked.join(_totals(counts), "_g")
    # a quantile's weights add up to one; a value of weight zero must not make 0 * inf
    parts = [F.sum(F.when(_weight(q) > 0, _weight(q) * F.col("v"))) for q in qs]
    spread = F.sum(F.col("c") * F.pow(F.col("v") - F.col("mean"), 2))
    return rows.groupBy("_g", "n", "mean", "min", "max").agg(
        F.array(*parts).alias("q"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("std")).select(
        "_g", F.col("n").alias("count"), "mean", "std", "min", "max", "q")


def histogram(counts: DataFrame, bins: int) -> DataFrame:
    """_g, bin (1..bins), lo, hi, count: equal widths over [min, max] of each group, the last bin closed,
    empty bins with 0."""
    t = _totals(counts).withColumn("width", F.when(F.col("max") > F.col("min"), (F.col("max") - F.col("min")) / bins).otherwise(1.0))
    grid = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    inside = F.least(F.floor((F.col("v") - F.col("min")) / F.col("width")) + 1, F.lit(bins)).cast("int")
    found = (counts.join(t.select("_g", "min", "width"), "_g").groupBy("_g", inside.alias("bin")).agg(F.sum("c").alias("count")))
    return grid.join(found, ["_g", "bin"], "left").select(
        "_g", "bin", (F.col("min") + (F.col("bin") - 1) * F.col("width")).alias("lo"),
        (F.col("min") + F.col("bin") * F.col("width")).alias("hi"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))
