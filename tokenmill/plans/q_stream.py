"""Registered streaming queries (ST1-ST8). Each stages a given table as a
folder of ordered files, runs the stream until the input is drained, and
returns what the sink holds."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocab as V
from ..operators.packing import build_fixed_rows
from ..session import scratch_path, table
from ..streaming import jobs as J
from .catalog import query
from .fixtures import char_ids_sql
from .q_tokens import MOL_TOKS_SQL

#: Micro-batches of a stream.
N_BATCHES = 4
#: Text of a micro-batch where a key's rows of it are one task.
BATCH_BYTES = 256 << 20


def _parts(spark) -> int:
    """Files of a micro-batch: together as many as shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // N_BATCHES)


def _staged(spark, sf, name, order_col, n_batches=N_BATCHES):
    src = table(spark, sf, name)
    path = os.path.join(scratch_path(spark, f"stage_{name}"), "in")
    parts = _parts(spark) if n_batches == N_BATCHES else N_BATCHES
    J.stage_as_files(src, path, order_col, n_batches * parts)
    return J.read_stream(spark, path, src.schema, parts), path, src.schema


# -------------------------------------------------------------------- ST1 --
@query("stream_tokenize", f"""select doc_id, len(ids)::BIGINT n_tokens, array_to_string(ids, ' ') ids
from (select doc_id, {char_ids_sql()} ids from documents)""")
def q_stream_tokenize(spark, sf):
    sdf, _, _ = _staged(spark, sf, "documents", "doc_id")
    out, ck = J.fresh(spark, "st1")
    J.run_to_parquet(J.stream_tokenize(sdf).select("doc_id", "ids"), out, ck)
    back = spark.read.parquet(out)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), T.ids_text("ids").alias("ids"))


# -------------------------------------------------------------------- ST2 --
STREAM_PACK_SQL = f"""with d as (select source, doc_id, list_append({char_ids_sql()}, {V.CHAR_EOS}) ids from documents),
u as (select source, doc_id, unnest(ids) id, generate_subscripts(ids, 1) p from d),
g as (select source, (row_number() over (partition by source order by doc_id, p) - 1) gpos, id from u),
b as (select source, gpos // 62 block_id, list(id order by gpos) ids from g group by all)
select source, block_id::BIGINT block_id, array_to_string(list_concat([{V.CHAR_BOS}], ids, [{V.CHAR_EOS}]), ' ') input_ids
from b where len(ids) = 62"""


def _id_stream(spark, sf, n_batches=N_BATCHES):
    sdf, _, _ = _staged(spark, sf, "documents", "doc_id", n_batches)
    return J.stream_tokenize(sdf, eos=V.CHAR_EOS).select("source", "doc_id", "ids")


@query("stream_pack", STREAM_PACK_SQL)
def q_stream_pack(spark, sf):
    out, ck = J.fresh(spark, "st2")
    J.stream_pack_ranges(_id_stream(spark, sf), "source", "doc_id", "ids", 64, V.CHAR_BOS, V.CHAR_EOS, out, ck)
    back = spark.read.parquet(out)
    return back.select("source", "block_id", T.ids_text("input_ids").alias("input_ids"))


@query("stream_pack_state", STREAM_PACK_SQL)
def q_stream_pack_state(spark, sf):
    """ST2 with the left-overs as streaming state: a source's rows of a micro-batch are one task. So a larger corpus
    comes in more micro-batches, not in larger ones."""
    text_bytes = table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(N_BATCHES, -(-text_bytes // BATCH_BYTES))
    packed = J.stream_pack(_id_stream(spark, sf, n_batches), "source", "doc_id", "ids", 64, V.CHAR_BOS, V.CHAR_EOS)
    out, ck = J.fresh(spark, "st2_state")
    J.run_to_parquet(packed, out, ck)
    back = spark.read.parquet(out)
    return back.select("source", "block_id", T.ids_text("input_ids").alias("input_ids"))


# -------------------------------------------------------------------- ST3 --
@query("stream_filter_fixed", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_concat([{V.SMILES_BOS}], ids, [{V.SMILES_EOS}],
    list_resize([]::INTEGER[], 16 - len(ids) - 2, {V.SMILES_PAD})), ' ') input_ids
from i where len(ids) <= 14""")
def q_stream_filter_fixed(spark, sf):
    from .fixtures import SKELETONS, SUFFIXES, _case
    sdf, _, _ = _staged(spark, sf, "part", "p_partkey")
    mols = sdf.select(F.col("p_partkey").alias("mol_id"),
                      F.concat(_case("p_partkey", SKELETONS, 8), _case("p_size", SUFFIXES, 6)).alias("smiles"))
    fixed = build_fixed_rows(mols, T.smiles_ids("smiles"), 16, V.SMILES_BOS, V.SMILES_EOS, V.SMILES_PAD)
    out, ck = J.fresh(spark, "st3")
    J.run_to_parquet(fixed.select("mol_id", "input_ids"), out, ck)
    return spark.read.parquet(out).select("mol_id", T.ids_text("input_ids").alias("input_ids"))


# -------------------------------------------------------------------- ST4 --
@query("stream_metrics", """select case when l_orderkey % 10 = 0 then 'val' else 'train' end phase, (l_orderkey % 2)::BIGINT epoch,
  round(sum((l_discount * 10 + l_tax) * (case when l_returnflag = 'R' then 0 else 1 end)) / sum(case when l_returnflag = 'R' then 0 else 1 end), 9) nll,
  round(exp(sum((l_discount * 10 + l_tax) * (case when l_returnflag = 'R' then 0 else 1 end)) / sum(case when l_returnflag = 'R' then 0 else 1 end)), 9) ppl
from lineitem group by 1, 2""")
def q_stream_metrics(spark, sf):
    sdf, _, _ = _staged(spark, sf, "lineitem", "l_orderkey")
    lo = sdf.select(F.when(F.col("l_orderkey") % 10 == 0, "val").otherwise("train").alias("phase"),
                    (F.col("l_orderkey") % 2).cast("long").alias("epoch"),
                    (F.col("l_discount") * 10 + F.col("l_tax")).alias("nll"),
                    F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"))
    agg = J.stream_metrics(lo, ["phase", "epoch"])
    out, ck = J.fresh(spark, "st4")
    J.run_to_parquet(agg, out, ck, mode="complete")
    back = spark.read.parquet(out)
    return back.select("phase", "epoch", F.round("nll", 9).alias("nll"), F.round("ppl", 9).alias("ppl"))


# -------------------------------------------------------------------- ST5 --
@query("stream_throughput", """select count(*)::BIGINT total_rows from events""")
def q_stream_throughput(spark, sf):
    sdf, _, _ = _staged(spark, sf, "events", "event_id")
    out, ck = J.fresh(spark, "st5")
    live = J.ThroughputListener(every_rows=100_000, log=lambda s: None)
    spark.streams.addListener(live.listener)
    try:
        progress = J.run_to_parquet(sdf.select("event_id"), out, ck)
    finally:
        spark.streams.removeListener(live.listener)
    # listener events arrive asynchronously (live log); the totals come from
    # the query's own progress records, complete once it has terminated
    rows = J.throughput(progress)
    prog = spark.createDataFrame(rows, "batch_id long, input_rows long, rows_per_sec double")
    return prog.agg(F.sum("input_rows").cast("long").alias("total_rows"))


# -------------------------------------------------------------------- ST6 --
@query("stream_resume", """select event_id, user_id, value from events""")
def q_stream_resume(spark, sf):
    src = table(spark, sf, "events")
    base = scratch_path(spark, "st6")
    first = os.path.join(base, "in")
    parts = 2 * _parts(spark)
    J.stage_as_files(src.where(F.col("event_id") % 2 == 0), first, "event_id", 2 * parts)
    out, ck = os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    sdf = J.read_stream(spark, first, src.schema, parts).select("event_id", "user_id", "value")
    J.run_to_parquet(sdf, out, ck)
    # new files arrive; the restarted query reads only what it has not committed
    J.stage_as_files(src.where(F.col("event_id") % 2 == 1), first, "event_id", 2 * parts)
    sdf2 = J.read_stream(spark, first, src.schema, parts).select("event_id", "user_id", "value")
    J.run_to_parquet(sdf2, out, ck)
    return spark.read.parquet(out)


# -------------------------------------------------------------------- ST7 --
STOP_EOS, STOP_ENTROPY = V.CHAR_VOCAB["f"], 2.8

# every check point of every message: two EOS so far, or a low entropy of the last 256 tokens
STOP_SQL = f"""with d as (select conv_id || '-' || turn || '-' || row_number() over (partition by conv_id, turn order by role, text) sample_id,
   {char_ids_sql()} ids from conversations),
c as (select sample_id, n, ids[1:n] h from (select sample_id, ids, unnest(range(16, len(ids) + 1, 16)) n from d)),
k as (select sample_id, n, [i for i in range(1, n + 1) if h[i] = {STOP_EOS}] eos,
   case when n > 256 then list_aggregate(h[n - 255:n], 'entropy') * ln(2) else 99 end ent from c),
s as (select *, case when len(eos) >= 2 then 'eos' when ent < {STOP_ENTROPY} then 'entropy' end reason from k)
select sample_id, n::BIGINT stop_len, reason, (case when reason = 'eos' then eos[2] else n - 256 end)::BIGINT out_len
from s where reason is not null qualify row_number() over (partition by sample_id order by n) = 1"""


@query("stream_stop_rules", STOP_SQL)
def q_stream_stop_rules(spark, sf):
    from pyspark.sql import Window
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")  # rows that share a turn are samples of their own
    d = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.row_number().over(same).cast("string")).alias("sample_id"),
        T.char_ids("text").alias("ids"))
    toks = d.select("sample_id", F.posexplode("ids").alias("step", "token"))
    path = os.path.join(scratch_path(spark, "st7"), "in")
    # file order follows the steps, so a sample's tokens arrive over several micro-batches
    J.stage_as_files(toks.withColumn("_o", F.col("step").cast("long")), path, ["_o", "sample_id"], N_BATCHES * _parts(spark))
    sdf = J.read_stream(spark, path, "sample_id string, step int, token int, _o long", _parts(spark))
    stops = J.stream_stop_rules(sdf, "sample_id", "step", "token", eos=STOP_EOS, threshold=STOP_ENTROPY)
    out, ck = J.fresh(spark, "st7")
    J.run_to_parquet(stops, out, ck)
    return spark.read.parquet(out)


# -------------------------------------------------------------------- ST8 --
@query("stream_best_monitor", """select l_returnflag run, round(min(l_discount * 10 + l_tax), 9) best, count(*)::BIGINT n_seen
from lineitem group by 1""")
def q_stream_best_monitor(spark, sf):
    sdf, _, _ = _staged(spark, sf, "lineitem", "l_orderkey")
    vals = sdf.select(F.col("l_returnflag").alias("run"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("val"))
    out, ck = J.fresh(spark, "st8")
    J.run_to_parquet(J.stream_best_monitor(vals, "run", "val"), out, ck, mode="complete")
    return spark.read.parquet(out).select("run", F.round("best", 9).alias("best"), "n_seen")
