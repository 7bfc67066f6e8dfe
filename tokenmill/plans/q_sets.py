"""Registered set-level metric queries (A14-A17, J2, J3, U-1, U-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab as V
from ..operators import setmetrics as S
from ..operators.joins import join_positional
from . import sqltext as Q
from .catalog import query
from .fixtures import MOLECULES_SQL, molecules
from .q_corpus import _SAMPLE_SQL, _samples

R = 9
PAT = V.SMILES_PATTERN

# generated samples -> cleaned strings -> validity by the built-in rule
ITEMS_SQL = _SAMPLE_SQL + f""",
c as (select s.mol_id, {Q.clean_generated('sample')} item, m.qed, m.sa from s join m using (mol_id)),
k as (select *, regexp_extract_all(item, '{PAT}', 1) toks from c),
d as (select *, [ (case when t = '(' then 1 when t = ')' then -1 else 0 end) for t in toks] delta,
        list_filter(toks, lambda t: regexp_full_match(t, '%[0-9]{{2}}|[0-9]')) rings from k),
v as (select mol_id, item, qed, sa,
  (length(item) > 0 and array_to_string(toks, '') = item
   and coalesce(list_min([list_sum(list_slice(delta, 1, j)) for j in range(1, len(delta) + 1)]), 0) >= 0
   and coalesce(list_sum(delta), 0) = 0
   and coalesce(list_bool_and([len(list_filter(rings, lambda x: x = r)) % 2 = 0 for r in list_distinct(rings)]), true)) valid
  from d)"""


def items(spark, sf):
    s = _samples(spark, sf).select("mol_id", X.clean_generated_text("sample").alias("item"))
    m = molecules(spark, sf).select("mol_id", "qed", "sa")
    return join_positional(s, m, ["mol_id"]).withColumn("valid", S.well_formed("item"))


@query("set_validity", ITEMS_SQL + f"""
select count(*) filter (where valid)::BIGINT n_valid, round(count(*) filter (where valid) / count(*), {R}) validity from v""")
def q_set_validity(spark, sf):
    # the target is the number of generated items, counted in the same pass
    out = S.set_metrics(items(spark, sf), "item", "valid")
    return out.select("n_valid", F.round("validity", R).alias("validity"))


@query("set_uniqueness", ITEMS_SQL + f"""
select count(distinct item) filter (where valid)::BIGINT n_unique,
  round(case when count(*) filter (where valid) > 0 then count(distinct item) filter (where valid) / count(*) filter (where valid) else 0 end, {R}) uniqueness from v""")
def q_set_uniqueness(spark, sf):
    it = items(spark, sf)
    out = S.set_metrics(it, "item", "valid", 1)
    return out.select("n_unique", F.round("uniqueness", R).alias("uniqueness"))


@query("set_quality", ITEMS_SQL + f"""
select count(*) filter (where valid and qed >= 0.6 and sa <= 4.0)::BIGINT n_quality,
  round(count(*) filter (where valid and qed >= 0.6 and sa <= 4.0) / count(*), {R}) quality from v""")
def q_set_quality(spark, sf):
    out = S.set_metrics(items(spark, sf), "item", "valid", None, "qed", "sa")
    return out.select("n_quality", F.round("quality", R).alias("quality"))


@query("distinct_items", ITEMS_SQL + """
select distinct item from v where valid""")
def q_distinct_items(spark, sf):
    return S.distinct_items(items(spark, sf), "item", "valid")


DIV_SQL = ITEMS_SQL + f""",
u as (select distinct item from v where valid),
g as (select item, list_distinct([t[1] || ' ' || t[2] for t in list_zip(list_slice(tk, 1, len(tk) - 1), list_slice(tk, 2, len(tk)))]) grams
      from (select item, regexp_extract_all(item, '{PAT}', 1) tk from u)),
e as (select item, unnest(grams) gram, 1.0 / sqrt(len(grams)) w from g where len(grams) > 0),
gs as (select sum(w) s from e group by gram),
t as (select (select count(*) from u) n, (select count(*) from g where len(grams) > 0) n_nz, (select sum(s * s) from gs) sum_sq)"""


@query("set_diversity", DIV_SQL + f"""
select round(case when n >= 2 then 1 - (coalesce(sum_sq, 0) - n_nz) / (n * (n - 1.0)) else 0 end, {R}) diversity,
  n::BIGINT n_distinct from t""")
def q_set_diversity(spark, sf):
    d = S.distinct_items(items(spark, sf), "item", "valid")
    out = S.diversity(d, "item")
    return out.select(F.round("diversity", R).alias("diversity"), F.col("n_distinct").cast("long").alias("n_distinct"))


@query("join_pairwise_similarity", DIV_SQL + f"""
select round(case when n >= 2 then (coalesce(sum_sq, 0) - n_nz) / (n * (n - 1.0)) else 0 end, {R}) mean_similarity from t""")
def q_join_pairwise_similarity(spark, sf):
    d = S.distinct_items(items(spark, sf), "item", "valid")
    out = S.diversity(d, "item")
    return out.select(F.round(F.when(F.col("n_distinct") >= 2, 1 - F.col("diversity")).otherwise(0.0), R).alias("mean_similarity"))


@query("join_positional", ITEMS_SQL + """
select mol_id, item, qed, sa from v""")
def q_join_positional(spark, sf):
    return items(spark, sf).select("mol_id", "item", "qed", "sa")


@query("union_batches", f"""select mol_id, smiles from ({MOLECULES_SQL})""")
def q_union_batches(spark, sf):
    m = molecules(spark, sf).select("mol_id", "smiles")
    b0, b1 = m.where(F.col("mol_id") % 2 == 0), m.where(F.col("mol_id") % 2 == 1)
    return b0.unionByName(b1)
