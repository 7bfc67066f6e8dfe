"""Registered corpus source, sink and text-normalisation queries (S*, P*, U-3)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..functions import vocab as V
from ..session import scratch_path, table
from ..sources import arrow_shards as A
from ..sources import corpus as C
from ..sources import sinks as S
from . import sqltext as Q
from .catalog import query
from .fixtures import MOLECULES_SQL, char_ids_sql, molecules
from .q_tokens import MOL_TOKS_SQL, mol_ids


def _docs(spark, sf):
    return table(spark, sf, "documents")


# ------------------------------------------------------------------- S1 --
@query("scan_arrow_shards", """select doc_id, n_chars, length(text)::BIGINT text_len, md5(coalesce(text, '')) text_md5 from documents""")
def q_scan_arrow_shards(spark, sf):
    path = scratch_path(spark, "arrow_shards")
    # as many shards as shuffle partitions (three at least, for one in the stream format, which is one task's to read)
    shards = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    S.write_arrow_shards(_docs(spark, sf), path, stream_every=3, shards=shards, batch_rows=64)
    back = A.scan_arrow_shards(spark, path, ["doc_id", "n_chars", "text"], split_bytes=1 << 18)
    return back.select("doc_id", "n_chars", F.length("text").cast("long").alias("text_len"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


# ------------------------------------------------------------------- S2 --
@query("scan_split_dataset", f"""select mol_id, smiles from ({MOLECULES_SQL}) where mol_id % 10 = 1""")
def q_scan_split_dataset(spark, sf):
    path = scratch_path(spark, "splits")
    m = molecules(spark, sf).withColumn(
        "split", F.when(F.col("mol_id") % 10 == 0, "test").when(F.col("mol_id") % 10 == 1, "validation").otherwise("train"))
    m.write.partitionBy("split").parquet(path)
    return C.scan_split_dataset(spark, path, "validation").select("mol_id", "smiles")


# ------------------------------------------------------------- S3, P1 --
@query("scan_corpus", f"""select doc_id, {Q.wikitext('text')} text, 'wikitext103' corpus from documents""")
def q_scan_corpus(spark, sf):
    d = C.scan_corpus(spark, "wikitext103", os.path.join(sf, "documents.parquet"))
    return d.select("doc_id", "text", "corpus")


@query("validation_split_name", """select name, case when name in ('text8', 'lm1b', 'ag_news') then 'test' else 'validation' end split
from (select distinct 'src' || (doc_id % 3) name from documents union all select unnest(['text8', 'lm1b', 'ag_news', 'ptb']))""")
def q_validation_split_name(spark, sf):
    names = _docs(spark, sf).select(F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")).alias("name")).distinct()
    fixed = spark.createDataFrame([(n,) for n in ["text8", "lm1b", "ag_news", "ptb"]], "name string")
    allnames = names.unionByName(fixed)
    test_names = [n for n, s in C.CORPORA.items() if s.validation_split == "test"]
    return allnames.select("name", F.when(F.col("name").isin(test_names), "test").otherwise("validation").alias("split"))


# ------------------------------------------------------------------- S4 --
@query("scan_jsonl", """select conv_id, turn, role, text from conversations""")
def q_scan_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "conversations").write.json(path)
    back = C.scan_jsonl(spark, path, schema="conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", "text")


# ------------------------------------------------------------------- S5 --
SPLITS = (("train", 0, 1000), ("validation", 1000, 1500), ("test", 1500, None))


@query("split_by_char_offset", """select doc_id, split, text from (
  select doc_id, 'train' split, substring(text, 1, 1000) text from documents
  union all select doc_id, 'validation', substring(text, 1001, 500) from documents
  union all select doc_id, 'test', substring(text, 1501, greatest(length(text) - 1500, 0)) from documents)""")
def q_split_by_char_offset(spark, sf):
    return C.split_by_char_offset(_docs(spark, sf), "text", SPLITS, keep=["doc_id"])


# ------------------------------------------------------------------- S6 --
@query("tail_holdout", """select doc_id, case when row_number() over (order by doc_id) <= count(*) over () - 100
  then 'train' else 'holdout' end part from documents""")
def q_tail_holdout(spark, sf):
    train, hold = C.tail_holdout(_docs(spark, sf).select("doc_id"), ["doc_id"], holdout=100)
    return train.withColumn("part", F.lit("train")).unionByName(hold.withColumn("part", F.lit("holdout")))


# ------------------------------------------------------------------- S7 --
@query("scan_vocab", MOL_TOKS_SQL + """,
v as (select distinct unnest(toks) token from t),
lines as (select token, row_number() over (order by token) - 1 id from v
          union all select '[UNK]', (select count(*) from v) union all select '[UNK]', (select count(*) from v) + 1)
select token, max(id)::INTEGER id from lines group by token""")
def q_scan_vocab(spark, sf):
    path = scratch_path(spark, "vocab")
    toks = mol_ids(spark, sf).select(F.explode("toks").alias("value")).distinct().withColumn("_g", F.lit(0))
    # the vocabulary file: sorted distinct tokens, then '[UNK]' twice (last
    # wins); one sorted file, written without gathering the tokens in a row
    unk = spark.createDataFrame([("[UNK]", 1), ("[UNK]", 2)], "value string, _g int")
    lines = toks.unionByName(unk).orderBy("_g", "value").coalesce(1).select("value")
    lines.write.text(path)
    return C.scan_vocab(spark, path)


# ------------------------------------------------------- S8, S11, P12, A18 --
def _sample_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("run"),
        F.when(F.col("l_linenumber") == 7, F.lit("[nan]")).otherwise(F.round(F.exp(F.col("l_discount") * 10), 6).cast("string")).alias("gen_ppl"),
        F.when(F.col("l_returnflag") == "N", F.lit("x")).otherwise(F.col("l_quantity").cast("string")).alias("nfes"),
        (F.col("l_tax") * 100).alias("entropy"), F.col("l_extendedprice").alias("gen_lengths"),
        F.lit("s").alias("samples"), F.col("l_suppkey").alias("seed"))


SAMPLE_LOG_SQL = """select l_returnflag run,
  count(*) filter (where l_linenumber <> 7)::BIGINT n_samples,
  round(avg(round(exp(l_discount * 10), 6)) filter (where l_linenumber <> 7), 6) mean_gen_ppl,
  round(case when l_returnflag = 'N' then 0.0 else avg(l_quantity) end, 6) mean_nfes,
  round(avg(l_tax * 100), 6) mean_entropy,
  round(quantile_cont(l_extendedprice, 0.5), 6) median_length, round(max(l_extendedprice), 6) max_length
from lineitem group by l_returnflag"""


@query("sample_log_summary", SAMPLE_LOG_SQL)
def q_sample_log_summary(spark, sf):
    from ..operators.metrics import sample_log_summary
    path = scratch_path(spark, "sample_logs")
    S.sink_sample_csv(_sample_rows(spark, sf), path, partition_cols=["run"])
    log = C.sample_log_scan(spark, path).withColumn("run", F.regexp_extract("file_path", "run=([^/]+)/", 1))
    out = sample_log_summary(log, "run")
    return out.select("run", "n_samples", *[F.round(c, 6).alias(c) for c in
                                            ["mean_gen_ppl", "mean_nfes", "mean_entropy", "median_length", "max_length"]])


@query("sample_log_scan", """select l_returnflag run, count(*)::BIGINT n_rows,
  count(*) filter (where l_linenumber = 7)::BIGINT n_nan from lineitem group by 1""")
def q_sample_log_scan(spark, sf):
    path = scratch_path(spark, "sample_logs")
    S.sink_sample_csv(_sample_rows(spark, sf), path, partition_cols=["run"])
    log = C.sample_log_scan(spark, path).withColumn("run", F.regexp_extract("file_path", "run=([^/]+)/", 1))
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gen_ppl_raw") == "[nan]").alias("n_nan"))


@query("filter_nan_metric", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(l_discount * 10), 6) gen_ppl
from lineitem where l_linenumber <> 7""")
def q_filter_nan_metric(spark, sf):
    li = table(spark, sf, "lineitem")
    raw = F.when(F.col("l_linenumber") == 7, F.lit("[nan]")).otherwise(F.round(F.exp(F.col("l_discount") * 10), 6).cast("string"))
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
    return x.where(F.col("raw") != "[nan]").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                   F.expr("try_cast(raw as double)").alias("gen_ppl"))


@query("sink_sample_csv", """select l_orderkey seq, count(*)::BIGINT n_rows, round(sum(l_tax), 6) sum_entropy
from lineitem group by l_orderkey""")
def q_sink_sample_csv(spark, sf):
    """Parallel lists per sequence (as a sampler returns them) -> rows -> CSV -> read back."""
    li = table(spark, sf, "lineitem")
    lists = li.groupBy(F.col("l_orderkey").alias("seq")).agg(
        F.collect_list("l_tax").alias("entropy"), F.collect_list("l_quantity").alias("nfes"))
    rows = S.rows_from_lists(lists, ["entropy", "nfes"], keep=["seq"])
    path = scratch_path(spark, "sample_csv")
    rows.write.mode("append").option("header", "false").csv(path)
    back = spark.read.schema("seq long, entropy double, nfes double").csv(path)
    return back.groupBy("seq").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("entropy"), 6).alias("sum_entropy"))


# ------------------------------------------------------------------- S9 --
@query("scan_limited", """select least(count(*), 5000)::BIGINT n_rows from events where props is not null""")
def q_scan_limited(spark, sf):
    ev = table(spark, sf, "events")
    return C.scan_limited(ev, "props", 5000).agg(F.count(F.lit(1)).alias("n_rows"))


@query("scan_limited_rows", """select event_id, props from events where props is not null""")
def q_scan_limited_rows(spark, sf):
    """The rows themselves, under a cap above the table."""
    return C.scan_limited(table(spark, sf, "events"), "props", 1 << 40).select("event_id", "props")


# ------------------------------------------------------------------ S10 --
@query("sink_cache", f"""with d as (select sum(len({char_ids_sql()}) + 1) n from documents)
select unnest(range((n // 62)::BIGINT)) block_id, 64::BIGINT n from d""")
def q_sink_cache(spark, sf):
    from ..operators.packing import pack_chars
    root = scratch_path(spark, "cache")
    def build():
        return pack_chars(_docs(spark, sf), "text", ["doc_id"], 64, V.CHAR_BOS, V.CHAR_EOS)

    S.sink_cache(spark, build, root, "documents", mode="train", wrap=True, block_size=64)
    # the second call reads the cache
    again = S.sink_cache(spark, build, root, "documents", mode="train", wrap=True, block_size=64)
    return again.select("block_id", F.size("input_ids").cast("long").alias("n"))


# ------------------------------------------------------------------ S12 --
@query("sink_text", f"""with s as (select smiles t from ({MOLECULES_SQL}))
select 'sample' kind, t line from s
union all select 'metric', 'n_samples: ' || count(*) from s
union all select 'metric', 'n_distinct: ' || count(distinct t) from s
union all select 'metric', 'max_length: ' || max(length(t)) from s""")
def q_sink_text(spark, sf):
    """Samples and the metrics of these samples, written as text and read back."""
    folder = scratch_path(spark, "samples_txt")
    m = molecules(spark, sf).select(X.clean_generated_text("smiles").alias("text"))
    figures = m.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("text").alias("n_distinct"),
                    F.max(F.char_length("text")).alias("max_length")).first().asDict()
    S.sink_text(m, figures, folder)
    read = lambda part, kind: spark.read.text(os.path.join(folder, part)).select(F.lit(kind).alias("kind"), F.col("value").alias("line"))
    return read("samples", "sample").union(read("metrics", "metric"))


# ------------------------------------------------------------------ S13 --
@query("preview", f"""select doc_id, lang,
  case when len(ids) <= 32 then '[' || array_to_string(ids, ', ') || ']'
       else '[' || array_to_string(list_slice(ids, 1, 32), ', ') || '] ... (len=' || len(ids) || ')' end ids
from (select doc_id, lang, {char_ids_sql()} ids from documents order by doc_id limit 5)""")
def q_preview(spark, sf):
    d = _docs(spark, sf).select("doc_id", "lang", T.char_ids("text").alias("ids"))
    return S.preview(d, ["doc_id"], 5)


# ------------------------------------------------------------------ S14 --
@query("preview_tokens", f"""with d as (select doc_id, text, {char_ids_sql()} ids from documents order by doc_id limit 1)
select doc_id, array_to_string(list_slice(ids, 1, 64), ' ') first_ids,
  array_to_string(list_slice(ids, greatest(len(ids) - 64 + 1, 1), len(ids)), ' ') last_ids,
  array_to_string(list_slice(string_split(lower(text), ''), 1, 64), '') first_text
from d""")
def q_preview_tokens(spark, sf):
    d = _docs(spark, sf).orderBy("doc_id").limit(1)
    ids = T.char_ids("text")
    first, last = S.head_tail_tokens(ids, 64)
    return d.select("doc_id", T.ids_text(first).alias("first_ids"), T.ids_text(last).alias("last_ids"),
                    F.array_join(F.slice(T.char_tokens("text"), 1, 64), "").alias("first_text"))


# --------------------------------------------------------------- P2-P6 --
@query("detok_wikitext", f"select doc_id, {Q.wikitext('text')} text from documents")
def q_detok_wikitext(spark, sf):
    return _docs(spark, sf).select("doc_id", X.detok_wikitext("text").alias("text"))


@query("detok_ptb", f"select doc_id, {Q.ptb('text')} text from documents")
def q_detok_ptb(spark, sf):
    return _docs(spark, sf).select("doc_id", X.detok_ptb("text").alias("text"))


@query("detok_lm1b", f"select doc_id, {Q.lm1b('text')} text from documents")
def q_detok_lm1b(spark, sf):
    return _docs(spark, sf).select("doc_id", X.detok_lm1b("text").alias("text"))


@query("detok_lambada", f"select doc_id, {Q.lambada('text')} text from documents")
def q_detok_lambada(spark, sf):
    return _docs(spark, sf).select("doc_id", X.detok_lambada("text").alias("text"))


@query("detok_scientific", f"select doc_id, {Q.scientific('text')} text from documents")
def q_detok_scientific(spark, sf):
    return _docs(spark, sf).select("doc_id", X.detok_scientific("text").alias("text"))


CORPUS_OF_SOURCE = ["wikitext103", "ptb", "lm1b", "lambada", "scientific_papers_arxiv", "openwebtext-train"]


def _corpus_col():
    n = F.substring("source", 4, 10).cast("int") % len(CORPUS_OF_SOURCE)
    e = None
    for i, c in enumerate(CORPUS_OF_SOURCE):
        e = F.when(n == i, F.lit(c)) if e is None else e.when(n == i, F.lit(c))
    return e


_CORPUS_SQL = "case cast(substr(source, 4) as integer) % 6 " + " ".join(
    f"when {i} then '{c}'" for i, c in enumerate(CORPUS_OF_SOURCE)) + " end"


@query("detok_dispatch", f"""select doc_id, corpus, case
  when corpus like 'wikitext%' then {Q.wikitext('text')}
  when corpus like 'scientific_papers%' then {Q.scientific('text')}
  when corpus = 'ptb' then {Q.ptb('text')}
  when corpus = 'lm1b' then {Q.lm1b('text')}
  when corpus = 'lambada' then {Q.lambada('text')}
  else text end text
from (select doc_id, text, {_CORPUS_SQL} corpus from documents)""")
def q_detok_dispatch(spark, sf):
    d = _docs(spark, sf).withColumn("corpus", _corpus_col())
    return d.select("doc_id", "corpus", X.detok_dispatch("text", "corpus").alias("text"))


# ------------------------------------------------------------------ P7, P8 --
@query("text_column_fallback", f"""select mol_id, smiles input, length(smiles)::INTEGER n from ({MOLECULES_SQL})""")
def q_text_column_fallback(spark, sf):
    m = molecules(spark, sf).withColumnRenamed("smiles", "input")
    col = C.text_column(m)
    return m.select("mol_id", F.col(col).alias("input"), F.length(col).alias("n"))


@query("drop_source_columns", f"""select array_to_string(list_append({char_ids_sql()}, 3), ' ') input_ids from documents""")
def q_drop_source_columns(spark, sf):
    d = _docs(spark, sf).withColumn("input_ids", T.ids_text(T.append_eos(T.char_ids("text"), V.CHAR_EOS)))
    return C.model_columns(d, keep=("input_ids",))


# ----------------------------------------------------------------- P9, P10 --
@query("filter_by_length", MOL_TOKS_SQL + """
select mol_id, len(ids)::INTEGER n_tokens from i where len(ids) <= 14""")
def q_filter_by_length(spark, sf):
    m = mol_ids(spark, sf)
    return m.where(F.size("ids") <= 14).select("mol_id", F.size("ids").alias("n_tokens"))


@query("drop_accounting", MOL_TOKS_SQL + """
select count(*)::BIGINT original, count(*) filter (where len(ids) <= 14)::BIGINT kept,
  count(*) filter (where len(ids) > 14)::BIGINT dropped,
  round(100.0 * count(*) filter (where len(ids) > 14) / count(*), 6) ratio_pct from i""")
def q_drop_accounting(spark, sf):
    m = mol_ids(spark, sf)
    keep = F.size("ids") <= 14
    a = m.agg(F.count(F.lit(1)).alias("original"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
    return a.select("original", "kept", "dropped",
                    F.round(F.when(F.col("original") > 0, F.col("dropped") * 100.0 / F.col("original")).otherwise(0.0), 6).alias("ratio_pct"))


# -------------------------------------------------------------------- P11 --
_SAMPLE_SQL = f"""with m as ({MOLECULES_SQL}),
s as (select mol_id, '[BOS] ' || array_to_string(regexp_extract_all(smiles, '{V.SMILES_PATTERN}', 1), ' ') ||
  case mol_id % 3 when 0 then ' [EOS] [PAD] [PAD]' when 1 then ' [EOS] C C [EOS]' else '' end sample from m)"""


def _samples(spark, sf):
    m = molecules(spark, sf)
    tail = F.when(F.col("mol_id") % 3 == 0, " [EOS] [PAD] [PAD]").when(F.col("mol_id") % 3 == 1, " [EOS] C C [EOS]").otherwise("")
    return m.select("mol_id", F.concat(F.lit("[BOS] "), F.array_join(T.smiles_tokens("smiles", None), " "), tail).alias("sample"))


@query("clean_generated_text", _SAMPLE_SQL + f"""
select mol_id, {Q.clean_generated('sample')} cleaned from s""")
def q_clean_generated_text(spark, sf):
    return _samples(spark, sf).select("mol_id", X.clean_generated_text("sample").alias("cleaned"))


# -------------------------------------------------------------------- P13 --
@query("project_decode_preview", MOL_TOKS_SQL + """
select mol_id, case when len(ids) <= 8 then '[' || array_to_string(ids, ', ') || ']'
  else '[' || array_to_string(list_slice(ids, 1, 8), ', ') || '] ... (len=' || len(ids) || ')' end preview from i""")
def q_project_decode_preview(spark, sf):
    return mol_ids(spark, sf).select("mol_id", X.preview_list("ids", 8).alias("preview"))


# -------------------------------------------------------------------- U-3 --
@query("union_splits", """select doc_id, case when doc_id % 10 = 0 then 'validation' else 'train' end split from documents""")
def q_union_splits(spark, sf):
    d = _docs(spark, sf).select("doc_id")
    return C.union_splits({"train": d.where(F.col("doc_id") % 10 != 0), "validation": d.where(F.col("doc_id") % 10 == 0)})

