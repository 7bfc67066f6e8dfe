"""Reproducible subsets, epoch order, replica sharding and resume.

The epoch order is a dense index over ``(uniform(seed + epoch, id), id)``
computed with the two-pass row index (no single-partition window), so
every replica, and every restart, sees the same permutation without any
driver-side list of indices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import uniform
from .offsets import row_index


# --------------------------------------------------------------------- L1 --
def seeded_subset(df: DataFrame, n: int, seed: int, id_col: str, split_col: str | None = None) -> DataFrame:
    """First ``n`` rows per split of a seeded shuffle. ``row_number() <= n`` is
    planned with a map-side group limit, so at most ``n`` rows per split and
    task are shuffled."""
    keys = [split_col] if split_col else []
    u = uniform(seed, F.lit("subset"), id_col)
    w = Window.partitionBy(*keys).orderBy(u, F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# --------------------------------------------------------------------- L2 --
def epoch_order(df: DataFrame, seed: int, epoch: int, id_col: str, out_col: str = "epoch_pos") -> DataFrame:
    """Dense position of every row in the (seed + epoch) permutation."""
    tagged = df.withColumn("_u", uniform(seed + epoch, F.lit("perm"), id_col))
    return row_index(tagged, ["_u", id_col], out_col=out_col).drop("_u")


# --------------------------------------------------------------------- L3 --
def pad_to_even(df: DataFrame, pos_col: str, n_rows: int, replicas: int, drop_last: bool = False) -> DataFrame:
    """Make the row count divisible by ``replicas``: repeat rows from the head
    of the order (cycling when more padding than rows is needed), or drop
    the tail. Adds ``sample_pos`` (0..total-1)."""
    if drop_last:
        total = (n_rows // replicas) * replicas
        return df.where(F.col(pos_col) < total).withColumn("sample_pos", F.col(pos_col))
    total = math.ceil(n_rows / replicas) * replicas
    pos = F.col(pos_col)
    # copy j of a row sits at n*j + pos; j = 0 is the row itself
    copies = F.sequence(F.lit(0), F.floor((F.lit(total - 1) - pos) / F.lit(max(n_rows, 1))).cast("int"))
    return (df.where(pos < total).withColumn("_j", F.explode(copies))
            .withColumn("sample_pos", (F.col("_j") * n_rows + pos).cast("long")).drop("_j"))


# --------------------------------------------------------------------- L4 --
def round_robin_shard(df: DataFrame, pos_col: str, replicas: int) -> DataFrame:
    """Rank r gets positions r, r + R, ...; ``rank_pos`` is the place in its list."""
    return (df.withColumn("rank", F.pmod(F.col(pos_col), F.lit(replicas)).cast("int"))
            .withColumn("rank_pos", F.floor(F.col(pos_col) / replicas).cast("long")))


# ----------------------------------------------------------------- L5, J8 --
def resume_from_counter(df: DataFrame, rank_pos_col: str, counter: int) -> DataFrame:
    """Skip what was consumed: keep rows at or after ``counter`` in the rank's order."""
    return df.where(F.col(rank_pos_col) >= counter)


# --------------------------------------------------------------------- L6 --
def batch_assign(df: DataFrame, pos_col: str, batch_size: int) -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col(pos_col) / batch_size).cast("long"))


# --------------------------------------------------------------------- L7 --
def limit_fraction(df: DataFrame, batch_col: str, n_batches: int, fraction: float) -> DataFrame:
    """Keep the first ``int(fraction * n_batches)`` batches (a fraction of 1 keeps all)."""
    keep = n_batches if fraction >= 1.0 else int(fraction * n_batches)
    return df.where(F.col(batch_col) < keep)


# --------------------------------------------------------------------- L8 --
def head_rows(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows in storage order (a preview: the limit is the feature)."""
    return df.orderBy(*order_cols).limit(n)
