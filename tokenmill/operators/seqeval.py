"""Sequence evaluation and candidate selection.

Candidate tables are long form ``(seq_id, pos, token_id, prob|logit)``. All
per-position windows are partitioned by (seq_id, pos): a partition holds
one vocabulary's worth of candidates at most, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import uniform
from .metrics import array_entropy

NEG_INF = -1000000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------- W1 --
def sliding_windows(seqs: DataFrame, len_col: str, ctx: int, stride: int, keep: Sequence[str] = ()) -> DataFrame:
    """The scoring windows of each sequence of length L. Window 0 covers
    [0, min(ctx, L)) and scores positions 1..end-1; window i >= 1 covers
    [i*stride, min(i*stride+ctx, L)) and scores only positions from
    i*stride + ctx - stride on. n = max(ceil((L - ctx + stride)/stride), 1).
    Every position 1..L-1 is scored exactly once."""
    L = F.col(len_col).cast("long")
    return _bounds(seqs.select(*keep, L.alias("seq_len"), F.explode(_window_numbers(L, ctx, stride)).alias("window_id")), ctx, stride)


def _last_window(length: Column, ctx: int, stride: int) -> Column:
    return F.greatest(F.ceil((length - ctx + stride) / F.lit(float(stride))), F.lit(1)).cast("int") - 1


def _window_numbers(length: Column, ctx: int, stride: int) -> Column:
    return F.sequence(F.lit(0), _last_window(length, ctx, stride))


#: Columns of a window beside its key and its ids.
_WINDOW = ("seq_len", "window_id", "win_start", "win_end", "score_from", "score_to", "n_scored")


def _limits(i: Column, length: Column, ctx: int, stride: int) -> list[Column]:
    start = F.when(i == 0, F.lit(0)).otherwise(i * stride)
    end = F.least(start + ctx, length)
    lo = F.when(i == 0, F.lit(1)).otherwise(i * stride + ctx - stride)
    return [start.cast("long").alias("win_start"), end.cast("long").alias("win_end"), lo.cast("long").alias("score_from"),
            end.cast("long").alias("score_to"), F.greatest(end.cast("long") - lo.cast("long"), F.lit(0)).cast("long").alias("n_scored")]


def _bounds(out: DataFrame, ctx: int, stride: int) -> DataFrame:
    return out.select("*", *_limits(F.col("window_id").cast("long"), F.col("seq_len"), ctx, stride))


def scoring_window(pos, ctx: int, stride: int) -> Column:
    """W1 per token: the window that scores position ``pos`` (None for pos 0)."""
    p = _c(pos).cast("long")
    return F.when(p < 1, F.lit(None)).when(p < ctx, F.lit(0)).otherwise(
        F.floor((p - ctx) / stride) + 1).cast("long")


def window_ids(seqs: DataFrame, ids_col: str, ctx: int, stride: int, keep: Sequence[str] = (), out_col: str = "win_ids",
               windows_per_range: int | None = None) -> DataFrame:
    """W1 for a model: the scoring windows of each sequence with the ids that they cover. Empty sequences have
    one window without positions; a null sequence has none. The windows are cut before they become rows, so that no
    row carries its whole sequence.

    With ``windows_per_range``, a row has that many windows, of all sequences with the same ``keep``: ``range_id`` and,
    as arrays with an entry a window, the other columns, for ``stitch_windows(..., in_ranges=True)``. The ids are
    shuffled before the windows overlap and have scores."""
    L = F.size(ids_col).cast("long")
    if windows_per_range is None:
        cut = F.transform(_window_numbers(L, ctx, stride), lambda i: F.struct(
            L.alias("seq_len"), i.alias("window_id"), F.slice(ids_col, i * stride + 1, ctx).alias(out_col)))
        w = seqs.select(*keep, F.inline(F.when(F.col(ids_col).isNotNull(), cut)))
    else:
        k = windows_per_range
        cut = F.transform(F.sequence(F.lit(0), F.floor(_last_window(L, ctx, stride) / k).cast("int")), lambda r: F.struct(
            L.alias("seq_len"), r.alias("_range"), F.slice(ids_col, r * (k * stride) + 1, (k - 1) * stride + ctx).alias("_ids")))
        pieces = (seqs.select(*keep, F.inline(F.when(F.col(ids_col).isNotNull(), cut))).groupBy(*keep, "_range")
                  .agg(F.collect_list(F.struct("seq_len", "_ids")).alias("_pieces")))
        first = F.col("_range") * k

        def windows(piece: Column) -> Column:
            last = F.least(first + (k - 1), _last_window(piece["seq_len"], ctx, stride))
            return F.transform(F.sequence(first, last), lambda i: F.struct(
                piece["seq_len"].alias("seq_len"), i.alias("window_id"), *_limits(i.cast("long"), piece["seq_len"], ctx, stride),
                F.slice(piece["_ids"], (i - first) * stride + 1, ctx).alias(out_col)))

        w = pieces.select(*keep, F.col("_range").cast("long").alias("range_id"), F.flatten(F.transform("_pieces", windows)).alias("_w"))
        return w.select(*keep, "range_id", *[F.col("_w")[c].alias(c) for c in (*_WINDOW, out_col)])
    return _bounds(w, ctx, stride).select(*keep, *_WINDOW, out_col)


def stitch_windows(windows: DataFrame, cols: Sequence[str], keep: Sequence[str], windows_per_range: int = 64,
                   in_ranges: bool = False) -> DataFrame:
    """W1 stitched: per-position arrays of overlapping windows (``cols``: as long as the window) put together so that
    each position 1..L-1 comes from the one window that owns it.

    One row per (``keep``, ``range_id``) with the arrays of ``windows_per_range`` windows and the position of their first
    element, so a sequence of any length never is one row; a range is one shuffle group of bounded size. ``in_ranges``:
    the windows are the rows of ``window_ids`` with the same ``windows_per_range`` (``cols`` have an array a window), and
    nothing is shuffled."""
    def part(w, c) -> Column:
        at = w["score_from"] - w["win_start"] + 1
        return F.slice(w[c], at.cast("int"), w["n_scored"].cast("int")).alias(c)

    if in_ranges:
        own = F.filter(F.arrays_zip("score_from", "win_start", "n_scored", *cols), lambda w: w["n_scored"] > 0)
        parts = F.transform(own, lambda w: F.struct(w["score_from"].alias("score_from"), *[part(w, c) for c in cols]))
        g = windows.where(F.exists("n_scored", lambda n: n > 0)).select(*keep, "range_id", F.array_sort(parts).alias("_p"))
    else:
        row = {c: F.col(c) for c in ("score_from", "win_start", "n_scored", *cols)}
        g = (windows.where("n_scored > 0").groupBy(*keep, F.floor(F.col("window_id") / windows_per_range).cast("long").alias("range_id"))
             .agg(F.array_sort(F.collect_list(F.struct("score_from", *[part(row, c) for c in cols]))).alias("_p")))
    return g.select(*keep, "range_id", F.col("_p")[0]["score_from"].alias("pos_from"), *[F.flatten(F.col("_p")[c]).alias(c) for c in cols])


# --------------------------------------------------------------------- W3 --
def top_p_filter(cands: DataFrame, p: float, key_cols: Sequence[str] = ("seq_id", "pos"),
                 token_col: str = "token_id", prob_col: str = "prob") -> DataFrame:
    """W3 nucleus filter: order by prob desc (token id breaks ties), keep the
    candidates whose cumulative prob is <= p (the top one always), and
    renormalise the kept ones. p = 1 keeps everything unchanged."""
    if p >= 1.0:
        return cands
    w = Window.partitionBy(*key_cols).orderBy(F.col(prob_col).desc(), F.col(token_col))
    ranked = (cands.withColumn("_cum", F.sum(prob_col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_rn", F.row_number().over(w)))
    kept = ranked.where((F.col("_cum") <= p) | (F.col("_rn") == 1))
    tot = Window.partitionBy(*key_cols)
    return kept.withColumn(prob_col, F.col(prob_col) / F.sum(prob_col).over(tot)).drop("_cum", "_rn")


# --------------------------------------------------------------------- W4 --
def top_k_mask(cands: DataFrame, k: int, key_cols: Sequence[str] = ("seq_id", "pos"),
               score_col: str = "logit") -> DataFrame:
    """1 for scores >= the k-th largest of the group (ties kept), else 0."""
    w = Window.partitionBy(*key_cols).orderBy(F.col(score_col).desc())
    return cands.withColumn("keep", (F.rank().over(w) <= k).cast("int"))


# --------------------------------------------------------------------- W5 --
def soft_top_k(cands: DataFrame, key_cols: Sequence[str] = ("seq_id", "pos"),
               score_col: str = "logit") -> DataFrame:
    """Subtract the group mean, divide by the L2 norm of the centred scores."""
    w = Window.partitionBy(*key_cols)
    centred = F.col(score_col) - F.avg(score_col).over(w)
    return (cands.withColumn("_c", centred)
            .withColumn("soft", F.col("_c") / F.sqrt(F.sum(F.col("_c") * F.col("_c")).over(w))).drop("_c"))


# --------------------------------------------------------------------- W6 --
def categorical_draw(cands: DataFrame, seed, key_cols: Sequence[str] = ("seq_id", "pos"),
                     token_col: str = "token_id", prob_col: str = "prob") -> DataFrame:
    """One draw per position, proportional to prob, by the exponential race
    argmax prob / (1e-10 - ln(u + 1e-10)); u is the hashed uniform of
    (seed, keys, token)."""
    u = uniform(seed, *key_cols, token_col)
    score = F.col(prob_col) / (F.lit(1e-10) - F.log(u + F.lit(1e-10)))
    # exact ties go to the lowest token id, like an argmax over the vocabulary
    best = cands.groupBy(*key_cols).agg(F.max(F.struct(score.alias("s"), (-F.col(token_col)).alias("t"))).alias("b"))
    return best.select(*key_cols, (-F.col("b.t")).cast("int").alias(token_col))


# --------------------------------------------------------------------- W7 --
def log_softmax(cands: DataFrame, mask_id: int, key_cols: Sequence[str] = ("seq_id", "pos"),
                token_col: str = "token_id", logit_col: str = "logit", xt_col: str | None = None) -> DataFrame:
    """W7 (subs parameterisation): mask candidate gets -1e6 added, log-softmax
    over the candidates of a position; positions whose current token ``xt`` is
    not the mask become one-hot (0 for xt, -1e6 for all others)."""
    w = Window.partitionBy(*key_cols)
    x = F.col(logit_col) + F.when(F.col(token_col) == mask_id, F.lit(NEG_INF)).otherwise(0.0)
    out = (cands.withColumn("_x", x).withColumn("_m", F.max("_x").over(w))
           .withColumn("_lse", F.col("_m") + F.log(F.sum(F.exp(F.col("_x") - F.col("_m"))).over(w)))
           .withColumn("log_prob", F.col("_x") - F.col("_lse")))
    if xt_col:
        unmasked = F.col(xt_col) != mask_id
        out = out.withColumn("log_prob", F.when(unmasked, F.when(F.col(token_col) == F.col(xt_col), F.lit(0.0))
                                                .otherwise(F.lit(NEG_INF))).otherwise(F.col("log_prob")))
    return out.drop("_x", "_m", "_lse")


# --------------------------------------------------------------------- W8 --
def eos_truncate(ids, eos_id: int) -> Column:
    """With two or more EOS, cut right after the second EOS."""
    a = _c(ids)
    eos_pos = F.filter(F.transform(a, lambda x, i: F.when(x == eos_id, i + 1).otherwise(0)), lambda p: p > 0)
    return F.when(F.size(eos_pos) >= 2, F.slice(a, 1, F.get(eos_pos, 1))).otherwise(a)


# --------------------------------------------------------------------- W9 --
def tail_entropy(ids, tail: int = 256) -> Column:
    a = _c(ids)
    return array_entropy(F.slice(a, F.greatest(F.size(a) - (tail - 1), F.lit(1)), tail))


def stop_rules(ids, eos_id: int, var_length: bool, tail: int = 256, threshold: float = 4.0) -> dict[str, Column]:
    """W8 + W9: ``stop`` (low tail entropy, or a second EOS with variable
    length) and the possibly truncated sample. Low entropy with variable
    length drops the last ``tail`` tokens and overrides the EOS cut."""
    a = _c(ids)
    ent = tail_entropy(a, tail)
    low = ent < threshold
    if not var_length:
        return {"tail_entropy": ent, "stop": low, "ids": a}
    n_eos = F.size(F.filter(a, lambda x: x == eos_id))
    eos_cut = eos_truncate(a, eos_id)
    out = F.when(low, F.slice(a, 1, F.greatest(F.size(a) - tail, F.lit(0)))).otherwise(eos_cut)
    return {"tail_entropy": ent, "stop": low | (n_eos > 1), "ids": out}


# -------------------------------------------------------------------- W13 --
def carry_over(old, new, mask_id: int) -> Column:
    """Already decided tokens (not the mask) win over new draws."""
    return F.when(_c(old) != mask_id, _c(old)).otherwise(_c(new))


# -------------------------------------------------------------------- W14 --
def pick_random_masked(tokens: DataFrame, seed, mask_id: int, block_cols: Sequence[str] = ("seq_id", "block_id"),
                       pos_col: str = "pos", tok_col: str = "xt") -> DataFrame:
    """Per block, one masked position chosen uniformly: the
    floor(u * n_masked)-th masked position in position order."""
    masked = tokens.where(F.col(tok_col) == mask_id)
    w = Window.partitionBy(*block_cols).orderBy(pos_col)
    u = uniform(seed, *block_cols)
    ranked = (masked.withColumn("_k", F.row_number().over(w) - 1)
              .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*block_cols))))
    return ranked.where(F.col("_k") == F.floor(u * F.col("_n"))).select(*block_cols, pos_col)


# --------------------------------------------------------------------- J7 --
def gather_target(ids, log_probs) -> Column:
    """J7 on arrays: log-prob of the true token at each position, where
    ``log_probs`` is array<array<double>> indexed by token id."""
    return F.transform(_c(ids), lambda t, i: F.get(F.get(_c(log_probs), i), t))
