"""Registered sequence-evaluation and candidate-selection queries
(W1, W3-W11, W13, W14, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.rand import uniform, uniform_sql
from ..operators import seqeval as E
from ..operators.offsets import row_index, running_agg
from ..operators.ema import ema
from ..session import table
from .catalog import query
from .fixtures import CANDIDATES_SQL, LOSSES_SQL, candidates, char_ids_sql, losses

R = 9
MASK = 63  # the last candidate index plays the mask token


# --------------------------------------------------------------------- W1 --
@query("sliding_window_bounds", f"""with d as (select doc_id, len({char_ids_sql()})::BIGINT L from documents),
w as (select doc_id, L, unnest(range(0, greatest(ceil((L - 1024 + 512) / 512.0), 1)::BIGINT)) window_id from d)
select doc_id, window_id::INTEGER window_id, (window_id * 512)::BIGINT win_start, least(window_id * 512 + 1024, L)::BIGINT win_end,
  (case when window_id = 0 then 1 else window_id * 512 + 512 end)::BIGINT score_from,
  greatest(least(window_id * 512 + 1024, L) - (case when window_id = 0 then 1 else window_id * 512 + 512 end), 0)::BIGINT n_scored
from w""")
def q_sliding_window_bounds(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.char_count("text").alias("L"))
    w = E.sliding_windows(d, "L", 1024, 512, keep=["doc_id"])
    return w.select("doc_id", F.col("window_id").cast("int").alias("window_id"), "win_start", "win_end", "score_from", "n_scored")


# overlapped windows scored by a model that sees the window alone, each position taken from its owner
CTX, STRIDE, VOCAB, RANGE = 1024, 512, 35, 4
STITCH_SQL = f"""with d as (select doc_id, {char_ids_sql()} ids from documents),
w as (select doc_id, ids, unnest(range(0, greatest(ceil((len(ids) - {CTX} + {STRIDE}) / {STRIDE}.0), 1)::BIGINT)) window_id from d),
b as (select *, window_id * {STRIDE} s, least(window_id * {STRIDE} + {CTX}, len(ids)) e,
   case when window_id = 0 then 1 else window_id * {STRIDE} + {CTX} - {STRIDE} end f from w),
t as (select doc_id, window_id, s, f, p, ids[p + 1] tok from (select *, unnest(range(s, e)) p from b)),
x as (select *, ln((row_number() over (partition by doc_id, window_id, tok order by p)) / (p - s + {VOCAB}.0)) lp from t),
st as (select doc_id, window_id // {RANGE} range_id, p, tok, -lp nll from x where p >= f)"""


def _stitched(spark, sf):
    from ..functions.pluggable import adaptive_unigram_factory, model_log_probs
    # a character's id is a byte where it is shuffled
    d = table(spark, sf, "documents").select("doc_id", T.char_ids("text").cast("array<tinyint>").alias("ids"))
    w = E.window_ids(d, "ids", CTX, STRIDE, ["doc_id"], windows_per_range=RANGE)
    w = w.withColumn("log_p", model_log_probs(F.col("win_ids"), adaptive_unigram_factory(VOCAB), in_ranges=True))
    return E.stitch_windows(w, ["win_ids", "log_p"], ["doc_id"], RANGE, in_ranges=True)


@query("sliding_window_stitch", STITCH_SQL + f"""
select doc_id, range_id::BIGINT range_id, min(p)::BIGINT pos_from, count(*)::BIGINT n_scored, round(sum(nll), 6) sum_nll,
  round(arg_max(nll, p), {R}) last_nll, sum(tok * (p % 7))::BIGINT id_check from st group by all""")
def q_sliding_window_stitch(spark, sf):
    s = _stitched(spark, sf)
    check = F.aggregate(F.transform("win_ids", lambda x, i: x * ((F.col("pos_from") + i) % 7)), F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", "range_id", "pos_from", F.size("log_p").cast("long").alias("n_scored"),
                    F.round(F.aggregate("log_p", F.lit(0.0), lambda a, x: a - x), 6).alias("sum_nll"),
                    F.round(-F.element_at("log_p", -1), R).alias("last_nll"), check.alias("id_check"))


@query("windowed_generative_ppl", STITCH_SQL + """,
o as (select doc_id, row_number() over (order by doc_id) - 1 i, count(*) over () n from d),
v as (select i // 8 batch_id, nll, (tok <> 34)::INTEGER valid from st join o using (doc_id) where i < (n // 8) * 8)
select batch_id::BIGINT batch_id, sum(valid)::BIGINT gen_length, round(exp(sum(nll * valid) / sum(valid)), 6) gen_ppl
from v group by batch_id having sum(valid) > 0""")
def q_windowed_generative_ppl(spark, sf):
    """T14 -> W1 -> A6: stitched scores to the perplexity of batches of eight documents, the end token left out."""
    s = _stitched(spark, sf)
    idx = row_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"], out_col="i")
    n = idx.count() // 8 * 8
    valid = F.transform("win_ids", lambda x: (x != 34).cast("int"))
    sums = s.select("doc_id", F.aggregate(F.zip_with("log_p", valid, lambda a, b: -a * b), F.lit(0.0), lambda a, x: a + x).alias("nll"),
                    F.aggregate(valid, F.lit(0), lambda a, x: a + x).alias("valid"))
    b = sums.join(idx.where(F.col("i") < n), "doc_id").groupBy(F.floor(F.col("i") / 8).cast("long").alias("batch_id")).agg(
        F.sum("valid").alias("gen_length"), F.sum("nll").alias("nll"))
    return b.where("gen_length > 0").select("batch_id", "gen_length", F.round(F.exp(F.col("nll") / F.col("gen_length")), 6).alias("gen_ppl"))


# --------------------------------------------------------------------- W3 --
@query("top_p_filter", f"""with c as ({CANDIDATES_SQL}),
r as (select *, sum(prob) over (partition by seq_id, pos order by prob desc, token_id rows between unbounded preceding and current row) cum,
   row_number() over (partition by seq_id, pos order by prob desc, token_id) rn from c),
k as (select * from r where cum <= 0.9 or rn = 1)
select seq_id, token_id, round(prob / sum(prob) over (partition by seq_id, pos), {R}) prob from k""")
def q_top_p_filter(spark, sf):
    out = E.top_p_filter(candidates(spark, sf), 0.9)
    return out.select("seq_id", "token_id", F.round("prob", R).alias("prob"))


# --------------------------------------------------------------------- W4 --
@query("top_k_mask", f"""select seq_id, token_id, (rank() over (partition by seq_id, pos order by logit desc) <= 5)::INTEGER keep
from ({CANDIDATES_SQL})""")
def q_top_k_mask(spark, sf):
    return E.top_k_mask(candidates(spark, sf), 5).select("seq_id", "token_id", "keep")


# --------------------------------------------------------------------- W5 --
@query("soft_top_k", f"""with c as (select *, logit - avg(logit) over (partition by seq_id, pos) cen from ({CANDIDATES_SQL}))
select seq_id, token_id, round(cen / sqrt(sum(cen * cen) over (partition by seq_id, pos)), {R}) soft from c""")
def q_soft_top_k(spark, sf):
    return E.soft_top_k(candidates(spark, sf)).select("seq_id", "token_id", F.round("soft", R).alias("soft"))


# --------------------------------------------------------------------- W6 --
DRAW_SQL = f"""select seq_id, arg_max(token_id, struct_pack(s := prob / (1e-10 - ln({uniform_sql(3, 'seq_id', 'pos', 'token_id')} + 1e-10)), t := -token_id)) token_id
from ({CANDIDATES_SQL}) group by seq_id, pos"""


@query("categorical_draw", DRAW_SQL)
def q_categorical_draw(spark, sf):
    return E.categorical_draw(candidates(spark, sf), 3).select("seq_id", "token_id")


# --------------------------------------------------------------------- W7 --
_XT_SQL = f"(case when seq_id % 3 = 0 then (seq_id % 64)::INTEGER else {MASK} end)"


_LSE_SQL = f"""with c0 as (select *, logit + case when token_id = {MASK} then -1000000.0 else 0.0 end x, {_XT_SQL} xt
  from ({CANDIDATES_SQL})),
c as (select *, max(x) over (partition by seq_id, pos) m from c0),
l as (select *, x - (m + ln(sum(exp(x - m)) over (partition by seq_id, pos))) lp from c)"""


@query("log_softmax", _LSE_SQL + f"""
select seq_id, token_id, round(case when xt <> {MASK} then (case when token_id = xt then 0.0 else -1000000.0 end) else lp end, {R}) log_prob from l""")
def q_log_softmax(spark, sf):
    c = candidates(spark, sf).withColumn(
        "xt", F.when(F.col("seq_id") % 3 == 0, (F.col("seq_id") % 64).cast("int")).otherwise(F.lit(MASK)))
    out = E.log_softmax(c, MASK, xt_col="xt")
    return out.select("seq_id", "token_id", F.round("log_prob", R).alias("log_prob"))


# --------------------------------------------------------------------- J7 --
@query("gather_target", _LSE_SQL + f"""
select seq_id, round(lp, {R}) log_prob from l where token_id = seq_id % 63""")
def q_gather_target(spark, sf):
    c = candidates(spark, sf)
    # a position's target follows from its own key: a filter after the window, no second read and no join
    lp = E.log_softmax(c, MASK).filter(F.col("token_id") == F.col("seq_id") % 63)
    return lp.select("seq_id", F.round("log_prob", R).alias("log_prob"))


# --------------------------------------------------------------------- W8 --
SEQ_SQL = f"select seq_id, list(token order by pos) ids from ({LOSSES_SQL}) group by seq_id"


def _seqs(spark, sf):
    lo = losses(spark, sf)
    s = lo.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return s.select("seq_id", F.transform("s", lambda x: x["token"]).alias("ids"))


@query("eos_truncate", f"""with s as ({SEQ_SQL}),
e as (select seq_id, ids, [i for i in range(1, len(ids) + 1) if ids[i] = 3] eos from s)
select seq_id, array_to_string(case when len(eos) >= 2 then list_slice(ids, 1, eos[2]) else ids end, ' ') ids from e""")
def q_eos_truncate(spark, sf):
    return _seqs(spark, sf).select("seq_id", T.ids_text(E.eos_truncate("ids", 3)).alias("ids"))


# --------------------------------------------------------------------- W9 --
@query("tail_entropy_stop", f"""with d as (select doc_id, {char_ids_sql()} ids from documents),
t as (select doc_id, ids, list_slice(ids, greatest(len(ids) - 255, 1), len(ids)) tail from d),
u as (select doc_id, unnest(tail) tok from t),
c as (select doc_id, tok, count(*) c from u group by all),
e as (select doc_id, ln(sum(c)) - sum(c * ln(c)) / sum(c) ent from c group by doc_id),
j as (select t.doc_id, ids, coalesce(e.ent, 0.0) ent, [i for i in range(1, len(ids) + 1) if ids[i] = 34] eos from t left join e using (doc_id))
select doc_id, round(ent, {R}) tail_entropy, (ent < 4 or len(eos) > 1) stop,
  (case when ent < 4 then greatest(len(ids) - 256, 0) when len(eos) >= 2 then eos[2] else len(ids) end)::INTEGER n_out from j""")
def q_tail_entropy_stop(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.char_ids("text").alias("ids"))
    r = E.stop_rules("ids", 34, var_length=True)
    return d.select("doc_id", F.round(r["tail_entropy"], R).alias("tail_entropy"), r["stop"].alias("stop"),
                    F.size(r["ids"]).alias("n_out"))


# -------------------------------------------------------------------- W10 --
@query("ema_with_warmup", f"""with l as (select seq_id, pos, nll, row_number() over (partition by seq_id order by pos) n from ({LOSSES_SQL})),
d as (select *, least(0.9999, (1 + n) / (10.0 + n)) dk from l),
s as (select *, sum(ln(dk)) over (partition by seq_id order by n rows between unbounded preceding and current row) Lk,
        sum(ln(dk)) over (partition by seq_id) LN from d)
select seq_id, round(sum(nll * (1 - dk) * exp(LN - Lk)), {R}) ema from s group by seq_id""")
def q_ema_with_warmup(spark, sf):
    lo = losses(spark, sf).select("seq_id", "pos", "nll")
    out = ema(lo, "nll", ["pos"], ["seq_id"], decay=0.9999)
    last = out.groupBy("seq_id").agg(F.max_by("ema", "pos").alias("ema"))
    return last.select("seq_id", F.round("ema", R).alias("ema"))


# -------------------------------------------------------------------- W11 --
STEP_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
EVERY_N = 500


@query("best_so_far", f"""with l as (select l_returnflag run, {', '.join(STEP_ORDER)}, l_discount * 10 + l_tax val from lineitem),
m as (select *, min(val) over w best, min(val) over (partition by run order by {', '.join(STEP_ORDER)}
   rows between unbounded preceding and 1 preceding) prev_best,
   row_number() over w step, count(*) over (partition by run) n_steps
   from l window w as (partition by run order by {', '.join(STEP_ORDER)} rows between unbounded preceding and current row))
select run, {', '.join(STEP_ORDER)}, step::BIGINT step, round(best, {R}) best,
  (prev_best is null or val < prev_best) improved, step % {EVERY_N} = 0 every_n, step = n_steps is_last from m""")
def q_best_so_far(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run"), *STEP_ORDER, (F.col("l_discount") * 10 + F.col("l_tax")).alias("val"))
    # best, best before, and the step number come out of one two-pass scan;
    # run lengths are a tiny aggregate (one row per run)
    out = running_agg(li, "val", STEP_ORDER, ["run"], fn="min", out_col="best", exclusive_col="prev_best",
                      count_col="step")
    n = li.groupBy("run").agg(F.count(F.lit(1)).alias("n_steps"))
    j = out.join(n, "run")
    improved = F.col("prev_best").isNull() | (F.col("val") < F.col("prev_best"))
    return j.select("run", *STEP_ORDER, F.col("step").cast("long").alias("step"), F.round("best", R).alias("best"),
                    improved.alias("improved"), ((F.col("step") % EVERY_N) == 0).alias("every_n"),
                    (F.col("step") == F.col("n_steps")).alias("is_last"))


# -------------------------------------------------------------------- W13 --
@query("unmasked_carry_over", f"""with d as ({DRAW_SQL})
select seq_id, (case when {_XT_SQL} <> {MASK} then {_XT_SQL} else token_id end)::INTEGER token_id from d""")
def q_unmasked_carry_over(spark, sf):
    d = E.categorical_draw(candidates(spark, sf), 3)
    xt = F.when(F.col("seq_id") % 3 == 0, (F.col("seq_id") % 64).cast("int")).otherwise(F.lit(MASK))
    return d.select("seq_id", E.carry_over(xt, F.col("token_id"), MASK).cast("int").alias("token_id"))


# -------------------------------------------------------------------- W14 --
@query("pick_random_masked", f"""with t as (select seq_id, pos, pos // 4 block_id,
   case when {uniform_sql(9, 'seq_id', 'pos')} <= 0.5 then 18 else token end xt from ({LOSSES_SQL})),
m as (select *, row_number() over (partition by seq_id, block_id order by pos) - 1 k,
   count(*) over (partition by seq_id, block_id) n from t where xt = 18)
select seq_id, block_id::BIGINT block_id, pos from m where k = floor({uniform_sql(13, 'seq_id', 'block_id')} * n)""")
def q_pick_random_masked(spark, sf):
    lo = losses(spark, sf)
    t = lo.select("seq_id", "pos", F.floor(F.col("pos") / 4).cast("long").alias("block_id"),
                  F.when(uniform(9, "seq_id", "pos") <= 0.5, F.lit(18)).otherwise(F.col("token")).alias("xt"))
    return E.pick_random_masked(t, 13, 18)
