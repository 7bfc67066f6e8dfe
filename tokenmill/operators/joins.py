"""Places where two collections are related.

J3 (all-pairs similarity) is re-aimed as the pair-free aggregate of
``setmetrics.diversity``; J5 as the block ranges of
``packing.block_context_ranges``; J6 lives in ``corrupt.expand_levels``;
J7 in ``seqeval.gather_target``; J8 in ``sampling.resume_from_counter``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_vocab(rows: DataFrame, key_cols: Sequence[str], tokens_col: str, vocab: DataFrame,
               unk_id: int, out_col: str = "ids") -> DataFrame:
    """J1 / T3 for vocabularies too large for a map literal: explode tokens
    with their position, left-join the vocabulary, default UNK, and
    re-assemble in position order. ``vocab`` is (token, id) with one row per
    token. One plan for every size: Spark broadcasts the vocabulary below its
    size threshold, and splits the few hot tokens of a shuffled join at run
    time. Rows without tokens keep an empty array."""
    exploded = rows.select(*key_cols, F.posexplode_outer(tokens_col).alias("_pos", "token"))
    joined = exploded.join(vocab, on="token", how="left")
    found = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(unk_id)).cast("int").alias("id")))
    grouped = joined.groupBy(*key_cols).agg(F.array_sort(F.collect_list(found)).alias("_p"))
    return grouped.select(*key_cols, F.transform("_p", lambda s: s["id"]).alias(out_col))


def join_positional(left: DataFrame, right: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """One-to-one zip of two column sets on an explicit row key (never on
    implicit row order)."""
    return left.join(right, on=list(key_cols), how="inner")


def explode_grid(df: DataFrame, grid: Column) -> DataFrame:
    """Every row once per interval of a parameter-sized grid (array
    literal of structs); the grid's size depends on the parameters only."""
    return df.select("*", F.explode(grid).alias("_iv")).select(
        *df.columns, "_iv.interval_id", "_iv.eps_min", "_iv.eps_max")
