"""Registered masked-training-set queries (C1-C9, W12, A21, J6) and noise
functions (F1-F7, F11)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import noise as N
from ..functions import tokens as T
from ..functions import vocab as V
from ..functions.rand import uniform, uniform_sql
from ..operators import corrupt as C
from ..operators import metrics as M
from ..operators import seqeval as E
from ..operators.offsets import row_index
from ..session import table
from .catalog import query
from .fixtures import CANDIDATES_SQL, LOSSES_SQL, candidates, losses
from .q_tokens import MOL_TOKS_SQL, mol_ids

R = 9
MASK = V.SMILES_MASK
NB, BS = 4, 4  # blocks per sequence and sequences per batch in the level fixture
LO, HI = 0.2, 0.8

# ------------------------------------------------------------ C1, W12 --
LEVELS_SQL = f"""with s as (select distinct seq_id from ({LOSSES_SQL})),
i as (select seq_id, row_number() over (order by seq_id) - 1 idx from s),
b as (select seq_id, idx // {BS} batch_id, idx % {BS} seq_in_batch, unnest(range(0, {NB})) block_id from i)
select seq_id, batch_id, seq_in_batch, block_id,
  (({uniform_sql(21, "'level'", 'batch_id', 'seq_in_batch', 'block_id')} / {NB * BS} + (seq_in_batch * {NB} + block_id) / {float(NB * BS)})
    - floor({uniform_sql(21, "'level'", 'batch_id', 'seq_in_batch', 'block_id')} / {NB * BS} + (seq_in_batch * {NB} + block_id) / {float(NB * BS)}))
    * ({HI} - {LO}) + {LO} t
from b"""


def levels(spark, sf):
    lo = losses(spark, sf)
    idx = row_index(lo.select("seq_id").distinct(), ["seq_id"], out_col="_i")
    b = idx.select("seq_id", F.floor(F.col("_i") / BS).cast("long").alias("batch_id"),
                   (F.col("_i") % BS).cast("long").alias("seq_in_batch"),
                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NB - 1).cast("long"))).alias("block_id"))
    return b.withColumn("t", C.sample_levels(21, "batch_id", "seq_in_batch", "block_id", BS, NB, LO, HI))


@query("sample_levels", f"""select seq_id, block_id::BIGINT block_id, round(t, {R}) t from ({LEVELS_SQL})""")
def q_sample_levels(spark, sf):
    return levels(spark, sf).select("seq_id", "block_id", F.round("t", R).alias("t"))


@query("antithetic_levels", f"""select batch_id::BIGINT batch_id, count(*)::BIGINT n, round(avg(t), {R}) mean_t,
  round(min(t), {R}) min_t, round(max(t), {R}) max_t from ({LEVELS_SQL}) group by batch_id""")
def q_antithetic_levels(spark, sf):
    lv = levels(spark, sf)
    return lv.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("t"), R).alias("mean_t"),
                                       F.round(F.min("t"), R).alias("min_t"), F.round(F.max("t"), R).alias("max_t"))


# ------------------------------------------------------------------ J6 --
@query("join_block_level", f"""select l.seq_id, l.pos, round(v.t, {R}) t from ({LOSSES_SQL}) l
left join ({LEVELS_SQL}) v on l.seq_id = v.seq_id and l.pos // 2 = v.block_id""")
def q_join_block_level(spark, sf):
    lo = losses(spark, sf).select("seq_id", "pos")
    out = C.expand_levels(lo, levels(spark, sf).select("seq_id", "block_id", "t"), ["seq_id"], "pos", 2)
    return out.select("seq_id", "pos", F.round("t", R).alias("t"))


# ------------------------------------------------------------ C2, A21 --
P_SQL = "(0.3 + (mol_id % 5) / 10.0)"


def _p():
    return F.lit(0.3) + (F.col("mol_id") % 5) / 10.0


def _mask_sql(ids: str, p: str, seq: str, off: str = "0", attempt: str = "0", mask: int = MASK) -> str:
    u = uniform_sql(5, "'mask'", seq, f"({off} + i - 1)", attempt)
    return f"list_transform({ids}, lambda x, i: case when {u} <= {p} then {mask} else x end)"


@query("mask_tokens", MOL_TOKS_SQL + f"""
select mol_id, array_to_string({_mask_sql('ids', P_SQL, 'mol_id')}, ' ') xt from i""")
def q_mask_tokens(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(C.mask_array("ids", _p(), 5, "mol_id", 0, 0, MASK)).alias("xt"))


@query("masked_fraction", MOL_TOKS_SQL + f""",
x as (select mol_id, {_mask_sql('ids', P_SQL, 'mol_id')} xt from i),
b as (select mol_id, unnest(range(0, len(xt) // 4)) block_id, xt from x)
select mol_id, block_id::INTEGER block_id,
  round(len(list_filter(list_slice(xt, block_id * 4 + 1, block_id * 4 + 4), lambda v: v = {MASK})) / 4.0, {R}) share from b""")
def q_masked_fraction(spark, sf):
    from ..operators.packing import split_into_blocks
    m = mol_ids(spark, sf).select("mol_id", C.mask_array("ids", _p(), 5, "mol_id", 0, 0, MASK).alias("xt"))
    b = split_into_blocks(m, "xt", 4, keep=["mol_id"])
    return b.select("mol_id", F.col("block_id").cast("int").alias("block_id"),
                    F.round(M.masked_fraction("block_ids", MASK), R).alias("share"))


# ------------------------------------------------------------------ C3 --
@query("mask_all", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_resize([]::INTEGER[], len(ids), {MASK}), ' ') xt from i""")
def q_mask_all(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(C.mask_all("ids", MASK)).alias("xt"))


# ------------------------------------------------------------------ C4 --
BLO, BHI, ATT = 0.25, 0.75, 16


@query("resample_bounds", MOL_TOKS_SQL + f""",
b as (select mol_id, block_id, list_slice(ids, block_id * 4 + 1, block_id * 4 + 4) blk,
   {P_SQL} p from (select mol_id, ids, unnest(range(0, len(ids) // 4)) block_id from i)),
a as (select *, list_position([ (len([j for j in range(0, 4) if {uniform_sql(5, "'mask'", 'mol_id', '(block_id * 4 + j)', 'a')} <= p]) / 4.0) between {BLO} and {BHI}
      for a in range(0, {ATT})], true) - 1 attempt from b)
select mol_id, block_id::BIGINT block_id, attempt::INTEGER attempt,
  array_to_string({_mask_sql('blk', 'p', 'mol_id', 'block_id * 4', 'attempt')}, ' ') xt from a""")
def q_resample_bounds(spark, sf):
    from ..operators.packing import split_into_blocks
    m = mol_ids(spark, sf).select("mol_id", "ids", _p().alias("p"))
    b = split_into_blocks(m, "ids", 4, keep=["mol_id", "p"]).withColumn("off", F.col("block_id") * 4)
    out = C.resample_bounds(b, "block_ids", "p", 5, "mol_id", "off", MASK, BLO, BHI, attempts=ATT)
    return out.select("mol_id", F.col("block_id").cast("long").alias("block_id"), F.col("attempt").cast("int").alias("attempt"),
                      T.ids_text("xt").alias("xt"))


# ------------------------------------------------------------------ C5 --
@query("keep_bos", MOL_TOKS_SQL + f""",
w as (select mol_id, list_concat([{V.SMILES_BOS}], ids) x0 from i),
x as (select mol_id, x0, {_mask_sql('x0', '0.9', 'mol_id')} xt from w)
select mol_id, array_to_string(list_concat([x0[1]], list_slice(xt, 2, len(xt))), ' ') xt,
  array_to_string(list_concat([0], list_resize([]::INTEGER[], len(x0) - 1, 1)), ' ') weight from x""")
def q_keep_bos(spark, sf):
    m = mol_ids(spark, sf).select("mol_id", F.concat(F.array(F.lit(V.SMILES_BOS)), "ids").alias("x0"))
    xt = C.mask_array("x0", F.lit(0.9), 5, "mol_id", 0, 0, MASK)
    w = C.drop_bos_weight(F.array_repeat(F.lit(1), F.size("x0")))
    return m.select("mol_id", T.ids_text(C.keep_bos(xt, "x0")).alias("xt"), T.ids_text(w).alias("weight"))


# ------------------------------------------------------------------ C6 --
@query("loss_table", f"""with c0 as (select *, logit + case when token_id = 63 then -1000000.0 else 0.0 end x from ({CANDIDATES_SQL})),
c as (select *, max(x) over (partition by seq_id, pos) m from c0),
l as (select *, x - (m + ln(sum(exp(x - m)) over (partition by seq_id, pos))) lp from c)
select seq_id, round((-1.0 / (0.1 + 0.8 * {uniform_sql(17, 'seq_id')})) * lp, {R}) loss from l where token_id = seq_id % 63""")
def q_loss_table(spark, sf):
    c = candidates(spark, sf)
    lp = E.log_softmax(c, 63).where(F.col("token_id") == (F.col("seq_id") % 63))
    t = F.lit(0.1) + F.lit(0.8) * uniform(17, "seq_id")
    sched = N.loglinear(t)
    return lp.select("seq_id", F.round(C.loss_value("log_prob", sched["loss_scale"], 1e-3), R).alias("loss"))


# ------------------------------------------------------------------ C7 --
@query("restore_from_prior", f"""select p_partkey mol_id, array_to_string(list_concat([{V.SMILES_BOS}], list_resize([]::INTEGER[], 15, {MASK})), ' ') x
from part""")
def q_restore_from_prior(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("mol_id"))
    return p.select("mol_id", T.ids_text(C.prior_rows(16, MASK, V.SMILES_BOS)).alias("x"))


# ------------------------------------------------------------------ C8 --
@query("anchored_prompt_rows", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_concat(list_slice(ids, 1, 24), list_resize([]::INTEGER[], greatest(24 - len(ids), 0), {MASK})), ' ') x from i""")
def q_anchored_prompt_rows(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(C.anchored_prompt("ids", 24, MASK)).alias("x"))


# ------------------------------------------------------------------ C9 --
@query("draw_from_mixture", f"""with c as (select *, case when token_id = 63 then 0.5 / 0.8 else prob * (1 - 0.5 / 0.8) end q from ({CANDIDATES_SQL}))
select seq_id, arg_max(token_id, struct_pack(s := q / (1e-10 - ln({uniform_sql(19, 'seq_id', 'pos', 'token_id')} + 1e-10)), t := -token_id)) token_id
from c group by seq_id, pos""")
def q_draw_from_mixture(spark, sf):
    c = candidates(spark, sf).withColumn("prob", C.mixture_probs("prob", "token_id", F.lit(0.5), F.lit(0.8), 63))
    return E.categorical_draw(c, 19).select("seq_id", "token_id")


# ------------------------------------------------------------- F1-F6 --
T_SQL = "((l_discount * 10 + 0.05) / 1.1)"


def _t():
    return (F.col("l_discount") * 10 + 0.05) / 1.1


def _li(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")


KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _sel(df, cols: dict):
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     *[F.round(v, R).alias(k) for k, v in cols.items()])


@query("noise_loglinear", f"""select {KEYS}, round({T_SQL}, {R}) move_chance, round(-1.0 / {T_SQL}, {R}) loss_scale,
  round(0.999 / (1 - 0.999 * {T_SQL}), {R}) rate_noise, round(-ln(1 - 0.999 * {T_SQL}), {R}) total_noise from lineitem""")
def q_noise_loglinear(spark, sf):
    s = N.loglinear(_t())
    return _sel(_li(spark, sf), s)


@query("noise_cosine", f"""select {KEYS}, round(1 - 0.999 * cos({T_SQL} * pi() / 2), {R}) move_chance,
  round(-0.999 * sin({T_SQL} * pi() / 2) / (1 - 0.999 * cos({T_SQL} * pi() / 2) + 0.001) * pi() / 2, {R}) loss_scale from lineitem""")
def q_noise_cosine(spark, sf):
    return _sel(_li(spark, sf), N.cosine(_t()))


@query("noise_exp", f"""select {KEYS}, round(greatest(pow({T_SQL}, 2), 0.001), {R}) sq_move, round(-(2 * pow({T_SQL}, 1)) / greatest(pow({T_SQL}, 2), 0.001), {R}) sq_scale,
  round(greatest(pow({T_SQL}, 0.5), 0.001), {R}) sqrt_move, round(-(0.5 * pow({T_SQL}, -0.5)) / greatest(pow({T_SQL}, 0.5), 0.001), {R}) sqrt_scale from lineitem""")
def q_noise_exp(spark, sf):
    a, b = N.schedule("square", _t()), N.schedule("square_root", _t())
    return _sel(_li(spark, sf), {"sq_move": a["move_chance"], "sq_scale": a["loss_scale"],
                                 "sqrt_move": b["move_chance"], "sqrt_scale": b["loss_scale"]})


@query("noise_log", f"""select {KEYS}, round(ln(1 + {T_SQL}) / ln(2), {R}) move_chance,
  round(-1 / ((ln(1 + {T_SQL}) / ln(2)) * ln(2) * (1 + {T_SQL})), {R}) loss_scale from lineitem""")
def q_noise_log(spark, sf):
    return _sel(_li(spark, sf), N.logarithmic(_t()))


@query("sigma_from_p", f"""select {KEYS}, round(least(-ln(1 - {T_SQL} * 0.999), {-math.log1p(-(1 - 1e-3))!r}), {R}) sigma from lineitem""")
def q_sigma_from_p(spark, sf):
    return _sel(_li(spark, sf), {"sigma": N.sigma_from_p(_t() * 0.999)})


@query("loss_weight_alt", f"""select {KEYS}, round(-ln(1 - 0.999 * {T_SQL}), {R}) sigma,
  round(1 - exp(ln(1 - 0.999 * {T_SQL})), {R}) move_chance,
  round(-(0.999 / (1 - 0.999 * {T_SQL})) / (exp(-ln(1 - 0.999 * {T_SQL})) - 1), {R}) loss_scale from lineitem""")
def q_loss_weight_alt(spark, sf):
    s = N.loss_weight_alt(_t())
    return _sel(_li(spark, sf), {"sigma": s["sigma"], "move_chance": s["move_chance"], "loss_scale": s["loss_scale"]})


# ------------------------------------------------------------------ F7 --
@query("log_choose", f"""select {KEYS}, round(coalesce(list_sum([ln(n - i) - ln(k - i) for i in range(0, k)]), 0), {R}) log_choose,
  round(coalesce(list_sum([ln(n - i) for i in range(0, k)]), 0), {R}) log_permute
from (select *, l_partkey % 50 + 10 n, l_linenumber - 1 k from lineitem)""")
def q_log_choose(spark, sf):
    li = table(spark, sf, "lineitem")
    n, k = F.col("l_partkey") % 50 + 10, F.col("l_linenumber") - 1
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     F.round(N.log_choose(n, k), R).alias("log_choose"), F.round(N.log_permute(n, k), R).alias("log_permute"))

# F11 (the clip grid) is exercised on data by join_interval_grid and
# clip_interval_variance; it is a function of parameters alone, so it has no
# query of its own.
