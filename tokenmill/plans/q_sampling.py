"""Registered subset / epoch order / sharding / resume queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.rand import uniform_sql
from ..operators import sampling as L
from ..session import table
from .catalog import query
from .fixtures import MOLECULES_SQL, molecules

SEED, EPOCH, REPLICAS, BATCH = 42, 3, 7, 8

# ------------------------------------------------------------------ L1 --
SUBSET_N = {"train": 100, "validation": 20, "test": 20}
_SPLIT_SQL = "case when mol_id % 10 = 0 then 'test' when mol_id % 10 = 1 then 'validation' else 'train' end"


def _split_col():
    m = F.col("mol_id") % 10
    return F.when(m == 0, "test").when(m == 1, "validation").otherwise("train")


@query("seeded_subset", f"""select mol_id, split from (
  select mol_id, {_SPLIT_SQL} split, row_number() over (partition by {_SPLIT_SQL}
    order by {uniform_sql(SEED, "'subset'", 'mol_id')}, mol_id) rn from ({MOLECULES_SQL}))
where rn <= case split when 'train' then {SUBSET_N['train']} when 'validation' then {SUBSET_N['validation']} else {SUBSET_N['test']} end""")
def q_seeded_subset(spark, sf):
    m = molecules(spark, sf).select("mol_id", _split_col().alias("split"))
    parts = [L.seeded_subset(m.where(F.col("split") == s), n, SEED, "mol_id", "split") for s, n in SUBSET_N.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("mol_id", "split")


# ------------------------------------------------------------------ L2 --
ORDER_SQL = f"""select doc_id, (row_number() over (order by {uniform_sql(SEED + EPOCH, "'perm'", 'doc_id')}, doc_id) - 1)::BIGINT epoch_pos
from documents"""


def _order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return L.epoch_order(d, SEED, EPOCH, "doc_id")


@query("epoch_shuffle", ORDER_SQL)
def q_epoch_shuffle(spark, sf):
    return _order(spark, sf).select("doc_id", "epoch_pos")


# ------------------------------------------------------------------ L3 --
PAD_SQL = f"""with o as ({ORDER_SQL}), n as (select count(*) n from documents),
t as (select ((n + {REPLICAS} - 1) // {REPLICAS}) * {REPLICAS} total, n from n)
select o.doc_id, (j.j * t.n + o.epoch_pos)::BIGINT sample_pos from o, t,
  (select unnest(range(0, 64)) j) j where j.j * t.n + o.epoch_pos < t.total"""


def _padded(spark, sf):
    o = _order(spark, sf)
    n = o.count()
    return L.pad_to_even(o, "epoch_pos", n, REPLICAS), n


@query("pad_to_even", PAD_SQL)
def q_pad_to_even(spark, sf):
    p, _ = _padded(spark, sf)
    return p.select("doc_id", "sample_pos")


@query("pad_to_even_drop_last", f"""with o as ({ORDER_SQL}) select doc_id, epoch_pos sample_pos from o
where epoch_pos < ((select count(*) from documents) // {REPLICAS}) * {REPLICAS}""")
def q_pad_to_even_drop_last(spark, sf):
    o = _order(spark, sf)
    n = o.count()
    return L.pad_to_even(o, "epoch_pos", n, REPLICAS, drop_last=True).select("doc_id", "sample_pos")


# ------------------------------------------------------------------ L4 --
SHARD_SQL = f"""select doc_id, sample_pos, (sample_pos % {REPLICAS})::INTEGER rank, (sample_pos // {REPLICAS})::BIGINT rank_pos from ({PAD_SQL})"""


def _sharded(spark, sf):
    p, n = _padded(spark, sf)
    return L.round_robin_shard(p, "sample_pos", REPLICAS), n


@query("round_robin_shard", SHARD_SQL)
def q_round_robin_shard(spark, sf):
    s, _ = _sharded(spark, sf)
    return s.select("doc_id", "sample_pos", "rank", "rank_pos")


# ------------------------------------------------------------- L5, J8 --
COUNTER = 2 * BATCH  # two consumed batches


@query("resume_from_counter", f"""select doc_id, rank, rank_pos from ({SHARD_SQL}) where rank_pos >= {COUNTER}""")
def q_resume_from_counter(spark, sf):
    s, _ = _sharded(spark, sf)
    return L.resume_from_counter(s, "rank_pos", COUNTER).select("doc_id", "rank", "rank_pos")


@query("filter_seen_positions", f"""select doc_id, epoch_pos from ({ORDER_SQL}) where epoch_pos >= 100""")
def q_filter_seen_positions(spark, sf):
    return L.resume_from_counter(_order(spark, sf), "epoch_pos", 100).select("doc_id", "epoch_pos")


# ------------------------------------------------------------------ L6 --
@query("batch_assign", f"""select doc_id, rank, (rank_pos // {BATCH})::BIGINT batch_id from ({SHARD_SQL})""")
def q_batch_assign(spark, sf):
    s, _ = _sharded(spark, sf)
    return L.batch_assign(s, "rank_pos", BATCH).select("doc_id", "rank", "batch_id")


# ------------------------------------------------------------------ L7 --
@query("limit_fraction", f"""with b as (select doc_id, rank, rank_pos // {BATCH} batch_id from ({SHARD_SQL})),
nb as (select ceil(max(rank_pos + 1) / {BATCH}.0) nb from ({SHARD_SQL}))
select doc_id, rank, batch_id::BIGINT batch_id from b, nb where batch_id < floor(0.25 * nb)""")
def q_limit_fraction(spark, sf):
    s, n = _sharded(spark, sf)
    per_rank = math.ceil(n / REPLICAS)
    n_batches = math.ceil(per_rank / BATCH)
    b = L.batch_assign(s, "rank_pos", BATCH)
    return L.limit_fraction(b, "batch_id", n_batches, 0.25).select("doc_id", "rank", "batch_id")


# ------------------------------------------------------------------ L8 --
@query("head_rows", """select doc_id, lang, n_chars from documents order by doc_id limit 10""")
def q_head_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return L.head_rows(d, ["doc_id"], 10)
