"""Masked-training-set builder.

Randomness is the hashed uniform of ``functions.rand`` keyed by
(seed, purpose, sequence, block/position, attempt), so a rebuilt or retried
partition draws exactly the same masks. Re-drawing blocks whose masked
share is out of bounds (C4) is the *first in-bounds attempt* of a block,
found by a fold inside its row; a block whose attempts all fail gets what
endless redrawing would converge to, drawn directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform

EPS = 1e-3


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- W12, C1 --
def sample_levels(seed, batch_col: str, seq_in_batch_col: str, block_col: str, batch_size: int,
                  num_blocks: int, eps_min: float = EPS, eps_max: float = 1.0,
                  antithetic: bool = True) -> Column:
    """Noise level t of each (sequence, block). Antithetic: u/n + i/n mod 1 with
    i = seq_in_batch * num_blocks + block, n = batch_size * num_blocks; then
    rescaled to [eps_min, eps_max]; both bounds >= 1 give t = 1."""
    if eps_min >= 1 and eps_max >= 1:
        return F.lit(1.0)
    u = uniform(seed, F.lit("level"), batch_col, seq_in_batch_col, block_col)
    if antithetic:
        n = batch_size * num_blocks
        i = F.col(seq_in_batch_col) * num_blocks + F.col(block_col)
        u = F.pmod(u / n + i / F.lit(float(n)), F.lit(1.0))
    return u * (eps_max - eps_min) + eps_min


# --------------------------------------------------------------------- C2 --
def mask_array(ids, p, seed, seq_col, offset=0, attempt=0, mask_id: int = 0) -> Column:
    """C2 on an array: token i -> mask when u(seed, seq, offset+i, attempt) <= p."""
    a, pc, off = _c(ids), _c(p), (_c(offset) if not isinstance(offset, int) else F.lit(offset))
    att = _c(attempt) if not isinstance(attempt, int) else F.lit(attempt)
    return F.transform(a, lambda x, i: F.when(
        uniform(seed, F.lit("mask"), seq_col, off + i, att) <= pc, F.lit(mask_id)).otherwise(x))


# --------------------------------------------------------------------- C3 --
def mask_all(ids, mask_id: int) -> Column:
    return F.array_repeat(F.lit(mask_id), F.size(_c(ids)))


# --------------------------------------------------------------------- C4 --
def _bounds_check(share: Column, eps_min: float, eps_max: float) -> Column:
    lo_on = eps_min != EPS
    hi_on = eps_max != 1.0
    ok = F.lit(True)
    if lo_on:
        ok = ok & (share >= eps_min)
    if hi_on:
        ok = ok & (share <= eps_max)
    return ok


def _drawn_count(free: Column, p: Column, lo: Column, hi: Column, keys: list) -> Column:
    """A binomial(free, p) count given that it is in lo..hi. Each count k gets log weight + Gumbel noise in one fold,
    and the largest wins; log weights follow from k to k + 1. p = 0 and p = 1 give the count nearest to theirs."""
    start = F.struct(F.lit(0.0).alias("w"), F.lit(float("-inf")).alias("best"), lo.cast("int").alias("k"))
    odds = F.log(p) - F.log(1.0 - p)

    def step(s, k):
        score = s["w"] - F.log(-F.log(F.greatest(uniform(*keys, k), F.lit(1e-12))))
        better = score > s["best"]
        following = s["w"] + F.log(F.greatest(free - k, F.lit(1)) / (k + 1)) + odds
        return F.struct(following.alias("w"), F.when(better, score).otherwise(s["best"]).alias("best"),
                        F.when(better, k).otherwise(s["k"]).alias("k"))

    return F.when(p <= 0, lo.cast("int")).when(p >= 1, hi.cast("int")).otherwise(
        F.aggregate(F.sequence(lo.cast("int"), hi.cast("int")), start, step, lambda s: s["k"]))


def resample_bounds(blocks: DataFrame, ids_col: str, p_col: str, seed, seq_col: str, offset_col: str,
                    mask_id: int, eps_min: float, eps_max: float, attempts: int = 64) -> DataFrame:
    """C4: per block, the first attempt whose masked share is inside the bounds (a bound at 1e-3 / 1 is not
    checked; both open -> attempt 0). Adds ``attempt`` and ``xt``.

    All in the block's own row: a fold over at most ``attempts`` attempts stops at the first good one. If none is
    good, the masked count is drawn from its distribution given the bounds and its places by hash; ``attempt`` is
    then -1. So any level ends, 0 and 1 too (the count in the bounds nearest to theirs). ``attempt`` and ``xt`` are
    null where the level or the block is null and where no whole number of masked tokens lies inside the bounds."""
    if eps_min == EPS and eps_max == 1.0:
        return blocks.withColumn("attempt", F.lit(0)).withColumn(
            "xt", mask_array(ids_col, p_col, seed, seq_col, F.col(offset_col), 0, mask_id))
    a, p, off = F.col(ids_col), F.col(p_col).cast("double"), F.col(offset_col)
    bs = F.size(a)

    def share(t):
        return F.size(F.filter(mask_array(a, p, seed, seq_col, off, t, mask_id), lambda x: x == mask_id)) / bs

    first = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), F.lit(None).cast("int"),
                        lambda got, t: F.when(got.isNotNull(), got).when(_bounds_check(share(t), eps_min, eps_max), t))
    already = F.size(F.filter(a, lambda x: x == mask_id))
    free = bs - already
    lo = F.ceil(bs * (eps_min if eps_min != EPS else 0.0) - 1e-12) - already
    hi = F.floor(bs * (eps_max if eps_max != 1.0 else 1.0) + 1e-12) - already
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, free)
    possible = F.coalesce((bs > 0) & (lo <= hi) & p.isNotNull(), F.lit(False))
    out = blocks.withColumn("attempt", F.when(possible, F.coalesce(first, F.lit(-1))))
    count = _drawn_count(free, p, lo, hi, [seed, F.lit("count"), seq_col, off])
    places = F.transform(a, lambda x, i: F.struct(uniform(seed, F.lit("place"), seq_col, off + i).alias("u"), i.alias("i"), x.alias("x")))
    order = F.array_sort(F.filter(places, lambda z: z["x"] != mask_id))
    chosen = F.transform(F.slice(order, F.lit(1), F.greatest(count, F.lit(0))), lambda z: z["i"])
    drawn = F.transform(a, lambda x, i: F.when(F.array_contains(chosen, i), F.lit(mask_id)).otherwise(x))
    attempt = F.col("attempt")
    return out.withColumn("xt", F.when(attempt >= 0, mask_array(a, p, seed, seq_col, off, attempt, mask_id)).when(attempt == -1, drawn))


# --------------------------------------------------------------------- C5 --
def keep_bos(xt, x0) -> Column:
    """Position 0 keeps the clean token."""
    return F.transform(_c(xt), lambda v, i: F.when(i == 0, F.get(_c(x0), 0)).otherwise(v))


def drop_bos_weight(mask) -> Column:
    return F.transform(_c(mask), lambda v, i: F.when(i == 0, F.lit(0)).otherwise(v).cast("tinyint"))


# --------------------------------------------------------------------- C6 --
def loss_value(log_p, loss_scale, eps_min: float, attention=None) -> Column:
    """loss = scale * log p(target); scale = -1 when eps_min > 0.5; times the mask."""
    scale = F.lit(-1.0) if eps_min > 0.5 else _c(loss_scale)
    out = scale * _c(log_p)
    return out * _c(attention).cast("double") if attention is not None else out


# --------------------------------------------------------------------- C7 --
def prior_rows(length: int, mask_id: int, bos_id: int) -> Column:
    """All-mask row with BOS at position 0."""
    return F.concat(F.array(F.lit(bos_id)), F.array_repeat(F.lit(mask_id), length - 1))


# --------------------------------------------------------------------- C8 --
def anchored_prompt(ids, length: int, mask_id: int) -> Column:
    """A given item fixed at the front, the rest mask, total ``length``."""
    a = _c(ids)
    return F.concat(F.slice(a, 1, length), F.array_repeat(F.lit(mask_id), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


# --------------------------------------------------------------------- C9 --
def mixture_probs(prob, token, p_s, p_t, mask_id: int) -> Column:
    """Next-level candidate probability: the mask keeps prob p_s/p_t, every
    other token prob * (1 - p_s/p_t). Feed the result to W6."""
    r = _c(p_s) / _c(p_t)
    return F.when(_c(token) == mask_id, r).otherwise(_c(prob) * (F.lit(1.0) - r))


# --------------------------------------------------------------------- J6 --
def expand_levels(tokens: DataFrame, levels: DataFrame, seq_cols: Sequence[str], pos_col: str,
                  block_size: int) -> DataFrame:
    """Each token gets the level of its block: equi-join on (seq, pos div block)."""
    t = tokens.withColumn("block_id", F.floor(F.col(pos_col) / block_size).cast("long"))
    return t.join(levels, on=[*seq_cols, "block_id"], how="left")
