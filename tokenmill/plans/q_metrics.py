"""Registered loss / likelihood / statistics queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import noise as N
from ..functions import tokens as T
from ..functions.rand import uniform, uniform_sql
from ..operators import metrics as M
from ..operators.joins import explode_grid
from ..operators.offsets import row_index
from ..session import cut_lineage, table
from .catalog import query
from .fixtures import LOSSES_SQL, char_ids_sql, losses
from .q_tokens import MOL_TOKS_SQL, mol_ids

LN2 = math.log(2.0)
R = 9  # digits kept in reported doubles


def _r(c, d=R):
    return F.round(c, d).alias(c if isinstance(c, str) else None)


def _lo(spark, sf):
    return losses(spark, sf)


# ------------------------------------------------------------- A1, A2, A3 --
@query("agg_nll", f"""select round(sum(nll * mask) / sum(mask), {R}) nll from ({LOSSES_SQL})""")
def q_agg_nll(spark, sf):
    return _lo(spark, sf).agg(F.round(M.nll(), R).alias("nll"))


@query("agg_bpd", f"""select round(sum(nll * mask) / sum(mask) / ln(2), {R}) bpd from ({LOSSES_SQL})""")
def q_agg_bpd(spark, sf):
    return _lo(spark, sf).agg(F.round(M.bpd(), R).alias("bpd"))


@query("agg_perplexity", f"""select round(exp(sum(nll * mask) / sum(mask)), {R}) ppl from ({LOSSES_SQL})""")
def q_agg_perplexity(spark, sf):
    return _lo(spark, sf).agg(F.round(M.ppl(), R).alias("ppl"))


# --------------------------------------------------------------------- A4 --
@query("agg_by_phase", f"""select phase || '/' prefix, phase, (seq_id % 2)::BIGINT epoch,
  round(sum(nll * mask) / sum(mask), {R}) nll, round(sum(nll * mask) / sum(mask) / ln(2), {R}) bpd,
  round(exp(sum(nll * mask) / sum(mask)), {R}) ppl
from ({LOSSES_SQL}) group by phase, seq_id % 2""")
def q_agg_by_phase(spark, sf):
    lo = _lo(spark, sf).withColumn("epoch", (F.col("seq_id") % 2).cast("long"))
    out = M.loss_metrics(lo, ["phase", "epoch"])
    return out.select(F.concat("phase", F.lit("/")).alias("prefix"), "phase", "epoch",
                      _r("nll"), _r("bpd"), _r("ppl"))


# --------------------------------------------------------------------- A5 --
@query("agg_corpus_suite", f"""select 'c' || (l_suppkey % 8) corpus, round(sum(nll * mask) / sum(mask), {R}) nll,
  round(exp(sum(nll * mask) / sum(mask)), {R}) ppl
from ({LOSSES_SQL}) where phase = 'val' group by 1""")
def q_agg_corpus_suite(spark, sf):
    lo = _lo(spark, sf).where(F.col("phase") == "val").withColumn(
        "corpus", F.concat(F.lit("c"), (F.col("l_suppkey") % 8).cast("string")))
    out = M.loss_metrics(lo, ["corpus"])
    return out.select("corpus", _r("nll"), _r("ppl"))


# --------------------------------------------------------------- A6, A9 --
EOS_TOKEN = 7
GEN_BATCH = 8

GEN_SQL = f"""with l as ({LOSSES_SQL}),
s as (select *, dense_rank() over (order by seq_id) - 1 sample_idx, count(distinct seq_id) over () n_samples from l),
f as (select * from s where sample_idx < (n_samples // {GEN_BATCH}) * {GEN_BATCH})"""


def _gen_tokens(spark, sf):
    lo = _lo(spark, sf)
    idx = row_index(lo.select("seq_id").distinct(), ["seq_id"], out_col="sample_idx")
    return lo.join(idx, "seq_id"), idx.count()


@query("agg_generative_ppl", GEN_SQL + f"""
select (sample_idx // {GEN_BATCH})::BIGINT batch_id,
  round(exp(sum(nll * (token <> {EOS_TOKEN})::INTEGER) / sum((token <> {EOS_TOKEN})::INTEGER)), {R}) gen_ppl
from f group by 1""")
def q_agg_generative_ppl(spark, sf):
    toks, n = _gen_tokens(spark, sf)
    out = M.generative_ppl(toks, "sample_idx", "nll", "token", EOS_TOKEN, GEN_BATCH, n)
    return out.select("batch_id", _r("gen_ppl"))


@query("agg_generative_ppl_total", GEN_SQL + f"""
select round(exp(sum(nll * (token <> {EOS_TOKEN})::INTEGER) / sum((token <> {EOS_TOKEN})::INTEGER)), {R}) gen_ppl from f""")
def q_agg_generative_ppl_total(spark, sf):
    toks, n = _gen_tokens(spark, sf)
    out = M.generative_ppl(toks, "sample_idx", "nll", "token", EOS_TOKEN, GEN_BATCH, n)
    return out.agg(F.round(F.exp(F.sum("sum_nll") / F.sum("gen_length")), R).alias("gen_ppl"))


@query("agg_valid_length", GEN_SQL + f"""
select (sample_idx // {GEN_BATCH})::BIGINT batch_id, sum((token <> {EOS_TOKEN})::INTEGER)::DOUBLE gen_length from f group by 1""")
def q_agg_valid_length(spark, sf):
    toks, n = _gen_tokens(spark, sf)
    return M.generative_ppl(toks, "sample_idx", "nll", "token", EOS_TOKEN, GEN_BATCH, n).select("batch_id", "gen_length")


# ------------------------------------------------------------- A7, U-4 --
ENT_SQL = f"""with d as (select doc_id, {char_ids_sql()} ids from documents),
u as (select doc_id, unnest(ids) tok from d),
c as (select doc_id, tok, count(*) c from u group by all),
e as (select doc_id, sum(c)::BIGINT n, ln(sum(c)) - sum(c * ln(c)) / sum(c) entropy from c group by doc_id)"""


def _doc_entropy(spark, sf):
    """doc_id, n, entropy: one row a document."""
    # one row per token; the character symbol stands for the token id (1:1)
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.char_symbols("text")).alias("tok"))
    return M.token_entropy(d, ["doc_id"], "tok")


@query("agg_token_entropy", ENT_SQL + f"""
select doc_id, n, round(entropy, {R}) entropy from e""")
def q_agg_token_entropy(spark, sf):
    return _doc_entropy(spark, sf).select("doc_id", F.col("n").cast("long").alias("n"), _r("entropy"))


@query("distinct_tokens", f"""select tok::INTEGER token, count(*)::BIGINT n from (select unnest({char_ids_sql()}) tok from documents) group by 1""")
def q_distinct_tokens(spark, sf):
    d = table(spark, sf, "documents").select(F.explode(T.char_symbols("text")).alias("sym"))
    counts = d.groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(T.symbol_id("sym").alias("token"), "n")


# --------------------------------------------------------------------- A8 --
@query("agg_batch_entropy", ENT_SQL + f""",
b as (select (row_number() over (order by doc_id) - 1) // 8 batch_id, entropy from e)
select batch_id::BIGINT batch_id, round(sum(entropy), {R - 3}) batch_entropy, count(*)::BIGINT batch_size,
  round(sum(sum(entropy) * count(*)) over () / sum(count(*)) over (), {R - 3}) metric
from b group by batch_id""")
def q_agg_batch_entropy(spark, sf):
    e = cut_lineage(_doc_entropy(spark, sf))  # one row a document, read three times: the tokens are counted once
    idx = row_index(e.select("doc_id"), ["doc_id"], out_col="_i")
    e = e.join(idx, "doc_id").withColumn("batch_id", F.floor(F.col("_i") / 8).cast("long"))
    b = M.batch_entropy(e, "batch_id")
    tot = b.agg((F.sum(F.col("batch_entropy") * F.col("batch_size")) / F.sum("batch_size")).alias("metric"))
    # the batch table is small (rows / 8); the one-row total goes back as a literal
    metric = tot.first()["metric"]
    return b.select("batch_id", F.round("batch_entropy", R - 3).alias("batch_entropy"),
                    F.col("batch_size").cast("long").alias("batch_size"), F.round(F.lit(metric), R - 3).alias("metric"))


# -------------------------------------------------------------------- A10 --
@query("agg_nfe", f"""select round(avg(nfes), {R}) mean_nfes from (select l_orderkey, sum(l_quantity) nfes from lineitem group by 1)""")
def q_agg_nfe(spark, sf):
    li = table(spark, sf, "lineitem")
    per_batch = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("nfes"))
    return per_batch.agg(F.round(F.avg("nfes"), R).alias("mean_nfes"))


# ------------------------------------------------------------ A11-A13 --
@query("length_describe", MOL_TOKS_SQL + f"""
select count(*)::BIGINT "count", round(avg(len(ids) + 1), {R}) mean, round(stddev_samp(len(ids) + 1), {R}) std,
  (min(len(ids) + 1))::DOUBLE "min", round(quantile_cont(len(ids) + 1, 0.25), {R}) p25,
  round(quantile_cont(len(ids) + 1, 0.5), {R}) p50, round(quantile_cont(len(ids) + 1, 0.75), {R}) p75,
  (max(len(ids) + 1))::DOUBLE "max" from i""")
def q_length_describe(spark, sf):
    m = mol_ids(spark, sf).withColumn("n", T.token_count("ids", plus_eos=True))
    out = M.length_describe(m, "n")
    return out.select("count", _r("mean"), _r("std"), "min", _r("p25"), _r("p50"), _r("p75"), "max")


QS = M.QUANTILES


_qname = M.quantile_name


@query("length_quantiles", "select " + ", ".join(
    f"round(quantile_cont(n, {q}), {R}) {_qname(q)}" for q in QS) +
    f" from (select len({char_ids_sql()}) + 1 n from documents)")
def q_length_quantiles(spark, sf):
    d = table(spark, sf, "documents").select((T.char_count("text") + 1).alias("n"))
    out = M.length_quantiles(d, "n")
    return out.select(*[_r(_qname(q)) for q in QS])


@query("length_histogram", f"""with d as (select (len({char_ids_sql()}) + 1)::DOUBLE n from documents),
m as (select min(n) mn, max(n) mx, (max(n) - min(n)) / 50 w from d),
c as (select least(floor((n - mn) / w) + 1, 50)::INTEGER bin, count(*) c from d, m group by 1)
select g.bin::INTEGER bin, round(mn + (g.bin - 1) * w, {R}) lo, round(mn + g.bin * w, {R}) hi, coalesce(c.c, 0)::BIGINT "count"
from (select unnest(generate_series(1, 50)) bin) g cross join m left join c on g.bin = c.bin""")
def q_length_histogram(spark, sf):
    d = table(spark, sf, "documents").select((T.char_count("text") + 1).alias("n"))
    out = M.length_histogram(d, "n", 50)
    return out.select("bin", _r("lo"), _r("hi"), "count")


# ------------------------------------------------------------- J4, A19 --
WIDTHS, DELTA, BLOCK = [0.9, 0.5], 0.05, 2
GRID = N.clip_grid_values(WIDTHS, DELTA, N.EPS, block_size=BLOCK)
GRID_SQL = "(values " + ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(GRID)) + \
    ") grid(interval_id, eps_min, eps_max)"

BLOCK_LOSSES_SQL = f"""with l as ({LOSSES_SQL}),
s as (select *, (dense_rank() over (order by seq_id) - 1) // 4 batch_id from l),
b as (select batch_id, seq_id, pos // {BLOCK} block_id, avg(nll) m from s group by all),
g as (select b.*, grid.* from b cross join {GRID_SQL})
select interval_id, eps_min, eps_max, batch_id, seq_id, block_id,
  m * (eps_min + (eps_max - eps_min) * {uniform_sql(11, 'seq_id', 'block_id', 'interval_id')}) mean_nll from g"""


def block_losses(spark, sf):
    lo = _lo(spark, sf)
    idx = row_index(lo.select("seq_id").distinct(), ["seq_id"], out_col="_si")
    # dealt by batch before the grid multiplies the rows: a batch's blocks are together from here on, so neither the
    # block means nor the figures of (interval, batch) need a further exchange, and a task holds its own batches only
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    b = (lo.join(idx, "seq_id").withColumn("batch_id", F.floor(F.col("_si") / 4).cast("long"))
         .select("batch_id", "seq_id", "pos", "nll").repartition(p, "batch_id")
         .groupBy("batch_id", "seq_id", F.floor(F.col("pos") / BLOCK).cast("long").alias("block_id"))
         .agg(F.avg("nll").alias("m")))
    g = explode_grid(b, N.clip_grid_array(WIDTHS, DELTA, N.EPS, block_size=BLOCK))
    u = uniform(11, "seq_id", "block_id", "interval_id")
    return g.withColumn("mean_nll", F.col("m") * (F.col("eps_min") + (F.col("eps_max") - F.col("eps_min")) * u))


@query("join_interval_grid", f"""select interval_id, count(*)::BIGINT n_blocks, round(sum(mean_nll), 6) sum_loss
from ({BLOCK_LOSSES_SQL}) group by interval_id""")
def q_join_interval_grid(spark, sf):
    b = block_losses(spark, sf)
    return b.groupBy(F.col("interval_id").cast("int").alias("interval_id")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.round(F.sum("mean_nll"), 6).alias("sum_loss"))


VAR_SQL = f"""with bl as ({BLOCK_LOSSES_SQL}),
pb as (select interval_id, eps_min, eps_max, batch_id, var_samp(mean_nll) v from bl group by all)
select interval_id, eps_min, eps_max, sum(v) var_sum, count(*)::BIGINT n_batches, sum(v) / count(*) var_mean from pb group by all"""


@query("clip_interval_variance", f"""select interval_id, round(eps_min, 6) eps_min, round(eps_max, 6) eps_max,
  round(var_sum, {R}) var_sum, n_batches, round(var_mean, {R}) var_mean from ({VAR_SQL})""")
def q_clip_interval_variance(spark, sf):
    v = M.clip_interval_variance(block_losses(spark, sf))
    return v.select(F.col("interval_id").cast("int").alias("interval_id"), F.round("eps_min", 6).alias("eps_min"),
                    F.round("eps_max", 6).alias("eps_max"), _r("var_sum"), "n_batches", _r("var_mean"))


@query("clip_interval_best", f"""select interval_id, round(eps_min, 6) eps_min, round(eps_max, 6) eps_max,
  round(var_sum, {R}) var_sum from ({VAR_SQL}) order by var_sum, interval_id limit 1""")
def q_clip_interval_best(spark, sf):
    v = M.clip_interval_variance(block_losses(spark, sf))
    b = M.clip_interval_best(v)
    return b.select(F.col("interval_id").cast("int").alias("interval_id"), F.round("eps_min", 6).alias("eps_min"),
                    F.round("eps_max", 6).alias("eps_max"), _r("var_sum"))


# -------------------------------------------------------------------- A22 --
@query("epoch_plan", """select count(*)::BIGINT "rows", count(*) / 64 steps_per_epoch,
  ((count(*) + 63) // 64)::BIGINT steps_per_epoch_ceil, (((count(*) + 63) // 64) * 5)::BIGINT max_steps,
  8 batch_per_device from documents""")
def q_epoch_plan(spark, sf):
    out = M.epoch_plan(table(spark, sf, "documents"), 64, 5, 8)
    return out.select("rows", "steps_per_epoch", "steps_per_epoch_ceil", "max_steps", "batch_per_device")


@query("div_up", """select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  ((l_orderkey * 8 + l_linenumber + l_linenumber - 1) // l_linenumber)::BIGINT v from lineitem""")
def q_div_up(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     N.div_up(F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_linenumber")).alias("v"))


# -------------------------------------------------------------------- A23 --
@query("elbo_selection", f"""with bl as ({BLOCK_LOSSES_SQL})
select interval_id, (eps_min = 0.001 and eps_max = 1.0) reportable, count(*)::BIGINT n_blocks,
  round(avg(mean_nll), {R}) mean_loss from bl group by interval_id, eps_min, eps_max""")
def q_elbo_selection(spark, sf):
    b = block_losses(spark, sf).withColumn("reportable", M.elbo_reportable("eps_min", "eps_max", BLOCK))
    return b.groupBy(F.col("interval_id").cast("int").alias("interval_id"), "reportable").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.round(F.avg("mean_nll"), R).alias("mean_loss"))
