"""Loss, likelihood and corpus statistics.

All of them are ordinary ``groupBy().agg()`` plans: Spark runs the partial
aggregate map-side and shuffles one buffer per group and task, so the
shuffle volume is the number of groups, not the number of token rows.
Weighted means are carried as (sum(v*w), sum(w)) pairs, which merge
exactly across tasks, batches and streaming micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

LN2 = math.log(2.0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------- A1, A2, A3, U6 --
def nll(value="nll", weight="mask") -> Column:
    """Weighted mean token loss: sum(v*w) / sum(w)."""
    v, w = _c(value), _c(weight).cast("double")
    return F.sum(v * w) / F.sum(w)


def bpd(value="nll", weight="mask") -> Column:
    return nll(value, weight) / F.lit(LN2)


def ppl(value="nll", weight="mask") -> Column:
    return F.exp(nll(value, weight))


def loss_metrics(df: DataFrame, group_cols: Sequence[str] = (), value="nll", weight="mask") -> DataFrame:
    """A1-A4: nll / bpd / ppl per group (e.g. phase, epoch), plus the two
    mergeable buffers (``sum_vw``, ``sum_w``)."""
    v, w = _c(value), _c(weight).cast("double")
    agg = df.groupBy(*group_cols).agg(F.sum(v * w).alias("sum_vw"), F.sum(w).alias("sum_w"))
    mean = F.col("sum_vw") / F.col("sum_w")
    return agg.select(*group_cols, "sum_vw", "sum_w", mean.alias("nll"), (mean / LN2).alias("bpd"),
                      F.exp(mean).alias("ppl"))


# ------------------------------------------------------------------- A6, A9 --
def generative_ppl(tokens: DataFrame, sample_idx: str, nll_col: str, token_col: str, eos_id: int,
                   batch_size: int, n_samples: int) -> DataFrame:
    """A6/A9 per evaluation batch: gen_ppl = exp(sum(nll*valid)/sum(valid)) with
    valid = token != EOS, and gen_length = sum(valid). Batches are consecutive
    ``batch_size`` samples; the incomplete last batch is dropped."""
    full = (n_samples // batch_size) * batch_size
    valid = (F.col(token_col) != eos_id).cast("double")
    return (tokens.where(F.col(sample_idx) < full)
            .withColumn("batch_id", F.floor(F.col(sample_idx) / batch_size).cast("long"))
            .groupBy("batch_id")
            .agg(F.sum(F.col(nll_col) * valid).alias("sum_nll"), F.sum(valid).alias("gen_length"))
            .select("batch_id", F.exp(F.col("sum_nll") / F.col("gen_length")).alias("gen_ppl"),
                    "gen_length", "sum_nll"))


# ------------------------------------------------------------------- A7, U-4 --
def token_entropy(tokens: DataFrame, seq_cols: Sequence[str], token_col: str) -> DataFrame:
    """Shannon entropy (nats) of the token frequencies of each sequence.
    Input is long form (one row per token); the first aggregate is combined
    map-side, so it shuffles at most (sequence, distinct token) pairs."""
    counts = tokens.groupBy(*seq_cols, token_col).agg(F.count(F.lit(1)).alias("c"))
    w = counts.groupBy(*seq_cols).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # -sum p ln p = ln n - sum(c ln c)/n
    return w.select(*seq_cols, (F.log("n") - F.col("clogc") / F.col("n")).alias("entropy"), "n")


def array_entropy(ids) -> Column:
    """A7 on one array column without exploding: sort, then fold run lengths."""
    a = F.array_sort(_c(ids))
    n = F.size(a)
    init = F.struct(F.lit(-1).cast("int").alias("prev"), F.lit(0).cast("long").alias("run"),
                    F.lit(0.0).alias("acc"))

    def step(s, x):
        same = s["prev"] == x
        closed = F.when(same | (s["run"] == 0), F.lit(0.0)).otherwise(s["run"] * F.log(s["run"]))
        return F.struct(x.alias("prev"), F.when(same, s["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
                        (s["acc"] + closed).alias("acc"))

    fin = F.aggregate(a, init, step, lambda s: s["acc"] + F.when(s["run"] > 0, s["run"] * F.log(s["run"])).otherwise(0.0))
    return F.when(n > 0, F.log(n) - fin / n).otherwise(F.lit(0.0))


def batch_entropy(per_seq: DataFrame, batch_col: str, entropy_col: str = "entropy") -> DataFrame:
    """Per batch the *sum* of sequence entropies, and the running metric
    value = sum(E_b * B_b) / sum(B_b) with B_b = batch size."""
    b = per_seq.groupBy(batch_col).agg(F.sum(entropy_col).alias("batch_entropy"), F.count(F.lit(1)).alias("batch_size"))
    return b


# --------------------------------------------------------- A11, A12, A13 --
QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99, 0.999]


def length_describe(df: DataFrame, length_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Count / mean / sample std / min / 25-50-75 % / max, from one counted table."""
    out = quantiles.summary(quantiles.value_counts(df, length_col, group_cols), [0.25, 0.5, 0.75])
    keys = [F.col("_g")[c].alias(c) for c in group_cols]
    return out.select(*keys, "count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def quantile_name(q: float) -> str:
    return "q" + str(q).replace("0.", "").ljust(2, "0")


def length_quantiles(df: DataFrame, length_col: str, qs: Sequence[float] = QUANTILES,
                     exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """Quantiles with linear interpolation, by distributed order statistics whatever the number of distinct
    values; or ``percentile_approx``. One row, null without values."""
    names = [quantile_name(q) for q in qs]
    if not exact:
        x = F.col(length_col).cast("double")
        return df.agg(*[F.percentile_approx(x, q, accuracy).alias(n) for q, n in zip(qs, names)])
    out = quantiles.summary(quantiles.value_counts(df, length_col), qs)
    return out.agg(*[F.max(F.col("q")[i]).alias(n) for i, n in enumerate(names)])


def length_stats(df: DataFrame, length_col: str, qs: Sequence[float] = QUANTILES, bins: int = 50):
    """A11 + A12 + A13 in one pass over the data: the lengths are counted once, all figures come from the counts.
    Returns (summary row, histogram DataFrame)."""
    counts = quantiles.value_counts(df, length_col)
    pct = [0.25, 0.5, 0.75] + list(qs)
    row = quantiles.summary(counts, pct).agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("count"), F.max("mean").alias("mean"), F.max("std").alias("std"), F.max("min").alias("min"),
        F.max("max").alias("max"), F.max("q").alias("pct")).first()
    return row, quantiles.histogram(counts, bins).where("count > 0").select("bin", "count")


def length_histogram(df: DataFrame, length_col: str, bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins over [min, max], the last bin closed; every bin is reported, empty ones
    with count 0. The data are read once; without values there are no bins."""
    return quantiles.histogram(quantiles.value_counts(df, length_col), bins).drop("_g")


# -------------------------------------------------------------------- A18 --
def sample_log_summary(log: DataFrame, file_col: str = "file_name") -> DataFrame:
    """A18 per log file: samples with a numeric perplexity, mean gen ppl, mean
    NFE (if any NFE cell of the file is not a number, all of the file's NFEs
    count as 0), mean entropy, median (exact, by distributed order statistics) and
    max sample length."""
    ppl_ok = F.col("gen_ppl_raw") != "[nan]"
    median = quantiles.summary(quantiles.value_counts(log, "gen_lengths", [file_col]), [0.5]).select(
        F.col("_g")[file_col].alias("_file"), F.col("q")[0].alias("median_length"))
    out = log.groupBy(file_col).agg(
        F.count_if(ppl_ok).alias("n_samples"),
        F.avg(F.when(ppl_ok, F.col("gen_ppl"))).alias("mean_gen_ppl"),
        F.when(F.count_if(F.col("nfes").isNull()) > 0, F.lit(0.0)).otherwise(F.avg("nfes")).alias("mean_nfes"),
        F.avg("entropy").alias("mean_entropy"),
        F.max("gen_lengths").alias("max_length"))
    return out.join(median, out[file_col].eqNullSafe(median["_file"]), "left").select(
        *[c for c in out.columns if c != "max_length"], "median_length", "max_length")


# ---------------------------------------------------------------- A19, A20 --
def clip_interval_variance(block_losses: DataFrame, max_batches: int | None = None) -> DataFrame:
    """Per interval, sum over all batches (the first ``max_batches`` if given) of the
    unbiased variance of the per-block mean losses of the batch (all ranks
    pooled), and that sum divided by the number of batches."""
    bl = block_losses
    if max_batches is not None:
        bl = bl.where(F.col("batch_id") < max_batches)
    per_batch = bl.groupBy("interval_id", "eps_min", "eps_max", "batch_id").agg(
        F.var_samp("mean_nll").alias("var"))
    return per_batch.groupBy("interval_id", "eps_min", "eps_max").agg(
        F.sum("var").alias("var_sum"), F.count(F.lit(1)).alias("n_batches"),
        (F.sum("var") / F.count(F.lit(1))).alias("var_mean"))


def clip_interval_best(variances: DataFrame, fix_clipping: bool = False, current=(1e-3, 1.0)) -> DataFrame:
    """Interval with the smallest summed variance; the first interval in
    grid order wins ties. With ``fix_clipping`` the current bounds stay."""
    if fix_clipping:
        return variances.sparkSession.createDataFrame([current], "eps_min double, eps_max double")
    best = variances.agg(F.min(F.struct("var_sum", "interval_id", "eps_min", "eps_max")).alias("b"))
    return best.select(F.col("b.interval_id").alias("interval_id"), F.col("b.eps_min").alias("eps_min"),
                       F.col("b.eps_max").alias("eps_max"), F.col("b.var_sum").alias("var_sum"))


# -------------------------------------------------------------------- A21 --
def masked_fraction(block_ids, mask_id: int) -> Column:
    a = _c(block_ids)
    return F.size(F.filter(a, lambda x: x == mask_id)) / F.size(a)


# -------------------------------------------------------------------- A22 --
def epoch_plan(df: DataFrame, global_batch: int, epochs: int, devices: int, accumulation: int = 1) -> DataFrame:
    """Rows, steps per epoch (rows / global batch, and its ceiling), max
    steps for ``epochs``; the global batch must divide by devices x accumulation."""
    if global_batch % (devices * accumulation) != 0:
        raise ValueError(f"global batch {global_batch} not divisible by {devices} devices "
                         f"x {accumulation} accumulation")
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows")).select(
        "rows", (F.col("rows") / global_batch).alias("steps_per_epoch"),
        F.floor((F.col("rows") + global_batch - 1) / global_batch).cast("long").alias("steps_per_epoch_ceil"),
        (F.floor((F.col("rows") + global_batch - 1) / global_batch) * epochs).cast("long").alias("max_steps"),
        F.lit(global_batch // devices).alias("batch_per_device"))


# -------------------------------------------------------------------- A23 --
def elbo_reportable(eps_min, eps_max, block_size: int, eval_nll: bool = False) -> Column:
    """An interval's loss is a valid likelihood estimate only for
    (1e-3, 1) (unless block 1 with NLL evaluation) or block 1 with min >= 1."""
    lo, hi = _c(eps_min), _c(eps_max)
    elbo = (lo == 1e-3) & (hi == 1.0) & F.lit(not (block_size == 1 and eval_nll))
    nll_b1 = F.lit(block_size == 1) & (lo >= 1)
    return elbo | nll_b1

