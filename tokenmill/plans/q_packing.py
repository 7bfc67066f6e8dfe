"""Registered packing and sequence-shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocab as V
from ..functions.rand import uniform, uniform_sql
from ..operators import packing as K
from ..operators import similarity as S
from ..operators.offsets import row_index, running_offset
from ..session import table
from .catalog import query
from .fixtures import LOSSES_SQL, char_ids_sql, molecules
from .q_tokens import MOL_TOKS_SQL, mol_ids

BLOCK = 64
CHUNK = BLOCK - 2


def docs(spark, sf):
    return table(spark, sf, "documents")


def doc_ids_eos():
    return T.append_eos(T.char_ids("text"), V.CHAR_EOS)


# the packed corpus in SQL: one row per token with its global position
PACK_SQL = f"""with d as (select doc_id, list_append({char_ids_sql()}, {V.CHAR_EOS}) ids from documents),
u as (select doc_id, unnest(ids) id, generate_subscripts(ids, 1) p from d),
g as (select (row_number() over (order by doc_id, p) - 1) gpos, id from u)"""


# --------------------------------------------------------------------- K1 --
@query("pack_wrapped", PACK_SQL + f""",
b as (select gpos // {CHUNK} block_id, list(id order by gpos) ids from g group by 1)
select block_id::BIGINT block_id, array_to_string(list_concat([{V.CHAR_BOS}], ids, [{V.CHAR_EOS}]), ' ') input_ids,
  {BLOCK}::BIGINT n_mask
from b where len(ids) = {CHUNK}""")
def q_pack_wrapped(spark, sf):
    out = K.pack_chars(docs(spark, sf), "text", ["doc_id"], BLOCK, V.CHAR_BOS, V.CHAR_EOS)
    return out.select("block_id", T.ids_text("input_ids").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_mask"))


# --------------------------------------------------------------------- K2 --
@query("pack_wrapped_raw", PACK_SQL + f""",
b as (select gpos // {BLOCK} block_id, list(id order by gpos) ids from g group by 1)
select block_id::BIGINT block_id, array_to_string(ids, ' ') input_ids from b where len(ids) = {BLOCK}""")
def q_pack_wrapped_raw(spark, sf):
    out = K.pack_chars(docs(spark, sf), "text", ["doc_id"], BLOCK, V.CHAR_BOS, V.CHAR_EOS, insert_special=False)
    return out.select("block_id", T.ids_text("input_ids").alias("input_ids"))


# --------------------------------------------------------------------- K3 --
def _shard_sql(n_shards: int, batch_rows: int) -> str:
    return f"""with d0 as (select doc_id, list_append({char_ids_sql()}, {V.CHAR_EOS}) ids,
   (row_number() over (order by doc_id) - 1) idx, count(*) over () n from documents),
d1 as (select *, n // {n_shards} dv, n % {n_shards} md from d0),
d2 as (select *, case when idx < (dv + 1) * md then idx // (dv + 1) else md + (idx - (dv + 1) * md) // dv end shard from d1),
d as (select doc_id, ids, shard, (idx - (shard * dv + least(shard, md))) // {batch_rows} batch from d2),
u as (select shard, batch, doc_id, unnest(ids) id, generate_subscripts(ids, 1) p from d),
g as (select shard, batch, (row_number() over (partition by shard, batch order by doc_id, p) - 1) gpos, id from u),
b as (select shard, batch, gpos // {CHUNK} block_id, list(id order by gpos) ids from g group by all)
select shard::BIGINT shard, batch::BIGINT batch, block_id::BIGINT block_id,
  array_to_string(list_concat([{V.CHAR_BOS}], ids, [{V.CHAR_EOS}]), ' ') input_ids
from b where len(ids) = {CHUNK}"""


@query("pack_wrapped_batched", _shard_sql(3, 100))
def q_pack_wrapped_batched(spark, sf):
    out = K.pack_wrapped_batched(docs(spark, sf), doc_ids_eos(), ["doc_id"], BLOCK, V.CHAR_BOS, V.CHAR_EOS,
                                 num_shards=3, batch_rows=100)
    return out.select("shard", "batch", "block_id", T.ids_text("input_ids").alias("input_ids"))


# --------------------------------------------------------------------- K4 --
@query("pack_smiles_wrapped", MOL_TOKS_SQL + f""",
u as (select mol_id, unnest(list_append(ids, {V.SMILES_EOS})) id, generate_subscripts(list_append(ids, {V.SMILES_EOS}), 1) p from i),
g as (select (row_number() over (order by mol_id, p) - 1) gpos, id from u),
b as (select gpos // 30 block_id, list(id order by gpos) ids from g group by 1)
select block_id::BIGINT block_id, array_to_string(list_concat([{V.SMILES_BOS}], ids, [{V.SMILES_EOS}]), ' ') input_ids
from b where len(ids) = 30""")
def q_pack_smiles_wrapped(spark, sf):
    m = molecules(spark, sf)
    ids = T.append_eos(T.smiles_ids("smiles"), V.SMILES_EOS)
    out = K.pack_wrapped(m, ids, ["mol_id"], 32, V.SMILES_BOS, V.SMILES_EOS)
    return out.select("block_id", T.ids_text("input_ids").alias("input_ids"))


# --------------------------------------------------------------- K5, P9 --
@query("build_fixed_rows", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_concat([{V.SMILES_BOS}], ids, [{V.SMILES_EOS}],
    list_resize([]::INTEGER[], 16 - len(ids) - 2, {V.SMILES_PAD})), ' ') input_ids,
  array_to_string(list_concat(list_resize([]::INTEGER[], len(ids) + 2, 1), list_resize([]::INTEGER[], 16 - len(ids) - 2, 0)), ' ') attention_mask
from i where len(ids) <= 14""")
def q_build_fixed_rows(spark, sf):
    m = molecules(spark, sf)
    out = K.build_fixed_rows(m, T.smiles_ids("smiles"), 16, V.SMILES_BOS, V.SMILES_EOS, V.SMILES_PAD)
    return out.select("mol_id", T.ids_text("input_ids").alias("input_ids"), T.ids_text("attention_mask").alias("attention_mask"))


# --------------------------------------------------------------------- K6 --
@query("chunk_text", """with c as (select page_id, unnest(generate_series(0, length(html) - 1, 500)) s, html
    from pages where length(html) > 0)
select page_id, (s // 500)::INTEGER chunk_idx, substring(html, s + 1, 500) chunk from c""")
def q_chunk_text(spark, sf):
    p = table(spark, sf, "pages")
    return K.chunk_text(p, "html", 500, keep=["page_id"]).select("page_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "chunk")


@query("chunk_text_drop_last", """with c as (select page_id, unnest(generate_series(0, length(html) - 1, 1000)) s, html
    from pages where length(html) > 0)
select page_id, (s // 1000)::INTEGER chunk_idx, substring(html, s + 1, 1000) chunk from c
where length(substring(html, s + 1, 1000)) = 1000""")
def q_chunk_text_drop_last(spark, sf):
    p = table(spark, sf, "pages")
    return K.chunk_text(p, "html", 1000, drop_last=True, keep=["page_id"]).select(
        "page_id", F.col("chunk_idx").cast("int").alias("chunk_idx"), "chunk")


# --------------------------------------------------------------------- K7 --
@query("crop_subsequence", PACK_SQL + f""",
b as (select gpos // {2 * BLOCK - 2} block_id, list(id order by gpos) ids from g group by 1),
r as (select block_id, list_concat([{V.CHAR_BOS}], ids, [{V.CHAR_EOS}]) x, block_id // 4 batch_id from b where len(ids) = {2 * BLOCK - 2}),
s as (select *, floor({uniform_sql(7, "'crop'", "batch_id")} * {BLOCK})::INTEGER st from r)
select block_id::BIGINT block_id, st,
  array_to_string(list_concat([{V.CHAR_BOS}], list_slice(x, st + 2, st + {BLOCK})), ' ') input_ids,
  array_to_string(list_concat(list_slice(x, st + 2, st + {BLOCK}), [{V.CHAR_EOS}]), ' ') target_ids
from s""")
def q_crop_subsequence(spark, sf):
    blocks = K.pack_chars(docs(spark, sf), "text", ["doc_id"], 2 * BLOCK, V.CHAR_BOS, V.CHAR_EOS)
    blocks = blocks.withColumn("batch_id", F.floor(F.col("block_id") / 4))
    start = F.floor(uniform(7, F.lit("crop"), "batch_id") * BLOCK)
    out = K.crop_subsequence(blocks, "input_ids", "attention_mask", BLOCK, start, bos=V.CHAR_BOS, eos=V.CHAR_EOS)
    return out.select("block_id", F.col("_s").alias("st"), T.ids_text(F.col("input_ids")).alias("input_ids"),
                      T.ids_text("target_ids").alias("target_ids"))


# --------------------------------------------------------------------- K8 --
@query("shift_targets", MOL_TOKS_SQL + """
select mol_id, array_to_string(list_slice(ids, 1, len(ids) - 1), ' ') input_ids,
  array_to_string(list_slice(ids, 2, len(ids)), ' ') target_ids from i where len(ids) >= 1""")
def q_shift_targets(spark, sf):
    m = mol_ids(spark, sf).where(F.size("ids") >= 1)
    s = K.shift_targets("ids")
    return m.select("mol_id", T.ids_text(s["input_ids"]).alias("input_ids"), T.ids_text(s["target_ids"]).alias("target_ids"))


# --------------------------------------------------------------------- K9 --
@query("split_into_blocks", """with l as (select seq_id, list(nll order by pos) v, list(token order by pos) t from (""" +
       LOSSES_SQL + """) group by seq_id),
b as (select seq_id, unnest(range(0, len(v) // 2)) block_id, v, t from l)
select seq_id, block_id::BIGINT block_id, array_to_string(list_slice(t, block_id * 2 + 1, block_id * 2 + 2), ' ') block_ids,
  round((list_slice(v, block_id * 2 + 1, block_id * 2 + 2)[1] + list_slice(v, block_id * 2 + 1, block_id * 2 + 2)[2]) / 2, 6) block_mean
from b""")
def q_split_into_blocks(spark, sf):
    from .fixtures import losses
    lo = losses(spark, sf)
    seqs = lo.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "nll", "token"))).alias("s"))
    seqs = seqs.select("seq_id", F.transform("s", lambda x: x["nll"]).alias("v"), F.transform("s", lambda x: x["token"]).alias("t"))
    out = K.split_into_blocks(seqs, "t", 2, keep=["seq_id"], values_col="v")
    return out.select("seq_id", F.col("block_id").cast("long").alias("block_id"), T.ids_text("block_ids").alias("block_ids"),
                      F.round("block_mean", 6).alias("block_mean"))


# -------------------------------------------------------------- K10, J5 --
@query("block_context_ranges", f"""with b as (select doc_id, unnest(range(0, len({char_ids_sql()}) // 16)) q_block from documents),
r as (select doc_id, q_block, 'noisy' q_kind, 'noisy' kv_kind, q_block kv_lo, q_block kv_hi from b
  union all select doc_id, q_block, 'noisy', 'clean', 0, q_block - 1 from b
  union all select doc_id, q_block, 'clean', 'clean', 0, q_block from b)
select doc_id, q_block::BIGINT q_block, q_kind, kv_kind, kv_lo::BIGINT kv_lo, kv_hi::BIGINT kv_hi,
  (kv_hi - kv_lo + 1)::BIGINT n_kv_blocks
from r where kv_hi >= kv_lo""")
def q_block_context_ranges(spark, sf):
    d = docs(spark, sf).select("doc_id", F.floor(F.size(T.char_ids("text")) / 16).cast("int").alias("nb"))
    blocks = d.where(F.col("nb") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("q_block"))
    return K.block_context_ranges(blocks, "doc_id", "q_block")


@query("block_context_pairs", f"""with b as (select doc_id, unnest(range(0, len({char_ids_sql()}) // 16)) q_block from documents),
r as (select doc_id, q_block, 'noisy' q_kind, 'noisy' kv_kind, q_block kv_lo, q_block kv_hi from b
  union all select doc_id, q_block, 'noisy', 'clean', 0, q_block - 1 from b
  union all select doc_id, q_block, 'clean', 'clean', 0, q_block from b)
select q_kind, kv_kind, count(*)::BIGINT n_query_blocks, sum(kv_hi - kv_lo + 1)::BIGINT n_pairs
from r where kv_hi >= kv_lo group by all""")
def q_block_context_pairs(spark, sf):
    """K10 under its survey name: the pair relation summarised from the ranges
    (the number of pairs is a sum over ranges; no pair row is ever built)."""
    r = q_block_context_ranges(spark, sf)
    return r.groupBy("q_kind", "kv_kind").agg(F.count(F.lit(1)).alias("n_query_blocks"),
                                              F.sum("n_kv_blocks").cast("long").alias("n_pairs"))


@query("join_block_prefix", f"""with b as (select doc_id, q_block,
    len(list_filter(list_slice(ids, q_block * 16 + 1, q_block * 16 + 16), lambda x: x <> 34)) n_letters
  from (select doc_id, ids, unnest(range(0, len(ids) // 16)) q_block from (select doc_id, {char_ids_sql()} ids from documents)))
select doc_id, q_block::BIGINT q_block, n_letters::BIGINT n_letters,
  coalesce(sum(n_letters) over (partition by doc_id order by q_block rows between unbounded preceding and 1 preceding), 0)::BIGINT context_letters
from b""")
def q_join_block_prefix(spark, sf):
    """J5 re-aimed: what a query block gathers from its earlier (context) blocks,
    as a per-sequence prefix aggregate (two-pass scan) instead of a theta join."""
    # the text is dealt over a fixed number of tasks first: its blocks are many times its size
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs(spark, sf).select("doc_id", "text").repartition(p, "doc_id", "text").select("doc_id", T.char_ids("text").alias("ids"))
    blocks = K.split_into_blocks(d, "ids", 16, keep=["doc_id"])
    b = blocks.select("doc_id", F.col("block_id").cast("long").alias("q_block"),
                      F.size(F.filter("block_ids", lambda x: x != 34)).cast("long").alias("n_letters"))
    out = running_offset(b, "n_letters", ["q_block"], ["doc_id"], "context_letters")
    return out.select("doc_id", "q_block", "n_letters", "context_letters")


# --------------------------------------------------------------------- K11 --
@query("unpack_by_eos", PACK_SQL + f""",
b as (select gpos // {CHUNK} block_id, list(id order by gpos) ids, list(gpos order by gpos) ps from g group by 1 having count(*) = {CHUNK}),
e as (select block_id, unnest(ids) id, unnest(ps) gpos from b),
k as (select block_id, id, gpos,
   coalesce(sum(case when id = {V.CHAR_EOS} then 1 else 0 end) over (partition by block_id order by gpos rows between unbounded preceding and 1 preceding), 0) item_idx,
   sum(case when id = {V.CHAR_EOS} then 1 else 0 end) over (partition by block_id) n_eos from e)
select block_id::BIGINT block_id, item_idx::INTEGER item_idx,
  array_to_string(list(id order by gpos) filter (where id <> {V.CHAR_EOS}), ' ') item,
  (item_idx < max(n_eos)) complete
from k group by block_id, item_idx having count(*) filter (where id <> {V.CHAR_EOS}) > 0""")
def q_unpack_by_eos(spark, sf):
    blocks = K.pack_chars(docs(spark, sf), "text", ["doc_id"], BLOCK, V.CHAR_BOS, V.CHAR_EOS)
    body = blocks.select("block_id", F.slice("input_ids", 2, CHUNK).alias("ids"))
    out = K.unpack_by_eos(body, "ids", V.CHAR_EOS, keep=["block_id"])
    return out.select("block_id", F.col("item_idx").cast("int").alias("item_idx"), T.ids_text("item").alias("item"), "complete")


# --------------------------------------------------------------------- K12 --
@query("pack_by_cluster", f"""with d as (select lang, doc_id, list_append({char_ids_sql()}, {V.CHAR_EOS}) ids from documents),
u as (select lang, doc_id, unnest(ids) id, generate_subscripts(ids, 1) p from d),
g as (select lang, (row_number() over (partition by lang order by doc_id, p) - 1) gpos, id from u),
b as (select lang, gpos // 4080 block_id, list(id order by gpos) ids from g group by all)
select lang, block_id::BIGINT block_id, len(ids)::BIGINT n_tokens, list_sum(ids)::BIGINT id_sum,
  md5(array_to_string(ids, ' ')) ids_md5
from b where len(ids) = 4080""")
def q_pack_by_cluster(spark, sf):
    out = K.pack_by_cluster(docs(spark, sf), T.char_ids("text"), "lang", ["doc_id"], 4080, V.CHAR_EOS)
    return out.select("lang", "block_id", F.size("input_ids").cast("long").alias("n_tokens"),
                      F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      F.md5(T.ids_text("input_ids")).alias("ids_md5"))


BANDS, BAND_ROWS, GRAM, SIMILAR = 24, 2, 3, 50

# distinct molecules, their minhash bands, links to the least molecule of a bucket, components (fixpoint of least labels)
CLUSTER_SQL = MOL_TOKS_SQL + f""",
it as (select smiles, list_distinct([array_to_string(list_slice(toks, p, p + {GRAM - 1}), chr(1))
    for p in range(1, greatest(len(toks) - {GRAM - 1}, 1) + 1)]) gr from (select distinct smiles, toks from i) where len(toks) > 0),
hs as (select smiles, [('0x' || substr(md5(g), 1, 8))::BIGINT for g in gr] h from it),
sg as (select smiles, [{', '.join(f"list_min([(x * {a} + {b}) % {S.PRIME} for x in h])" for a, b in S.hash_family(BANDS * BAND_ROWS))}] sig from hs),
bd as (select smiles, band, array_to_string(list_slice(sig, band * {BAND_ROWS} + 1, band * {BAND_ROWS} + {BAND_ROWS}), '|') bucket
  from (select smiles, sig, unnest(range({BANDS})) band from sg)),
met as (select distinct smiles u, min(smiles) over (partition by band, bucket) v from bd),
ln as (select u, v from met join it a on a.smiles = u join it b on b.smiles = v
  where u <> v and 100 * len(list_intersect(a.gr, b.gr)) >= {SIMILAR} * (len(a.gr) + len(b.gr) - len(list_intersect(a.gr, b.gr)))),
li as (select u, v from ln union select v, u from ln),
rc as (select smiles u, smiles v from (select distinct smiles from i) union select rc.u, li.v from rc join li on rc.v = li.u),
cl as (select u smiles, min(v) cluster from rc group by u)"""


@query("similarity_clusters", CLUSTER_SQL.replace("with ", "with recursive ", 1) + """
select mol_id, smiles, cluster from i join cl using (smiles)""")
def q_similarity_clusters(spark, sf):
    m = S.similarity_clusters(molecules(spark, sf), "smiles", T.smiles_tokens("smiles"), "cluster", GRAM, SIMILAR, BANDS, BAND_ROWS)
    return m.select("mol_id", "smiles", "cluster")


@query("pack_by_similarity", CLUSTER_SQL.replace("with ", "with recursive ", 1) + f""",
c as (select cluster, mol_id, list_append(ids, {V.SMILES_EOS}) x from i join cl using (smiles)),
u as (select cluster, mol_id, unnest(x) id, generate_subscripts(x, 1) p from c),
g as (select cluster, (row_number() over (partition by cluster order by mol_id, p) - 1) gpos, id from u),
b as (select cluster, gpos // 64 block_id, list(id order by gpos) ids from g group by all)
select cluster, block_id::BIGINT block_id, array_to_string(ids, ' ') input_ids from b where len(ids) = 64""")
def q_pack_by_similarity(spark, sf):
    """Molecules clustered by the similarity of their whole token sequences; items of a cluster are packed
    together, EOS between."""
    m = S.similarity_clusters(molecules(spark, sf), "smiles", T.smiles_tokens("smiles"), "cluster", GRAM, SIMILAR, BANDS, BAND_ROWS)
    out = K.pack_by_cluster(m, T.smiles_ids("smiles"), "cluster", ["mol_id"], 64, V.SMILES_EOS)
    return out.select("cluster", "block_id", T.ids_text("input_ids").alias("input_ids"))


# --------------------------------------------------------------------- W2 --
@query("running_offset", f"""select doc_id, (len({char_ids_sql()}) + 1)::BIGINT n,
  (coalesce(sum(len({char_ids_sql()}) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0))::BIGINT "offset"
from documents""")
def q_running_offset(spark, sf):
    d = docs(spark, sf).select("doc_id", (T.char_count("text") + 1).alias("n"))
    return running_offset(d, "n", ["doc_id"], out_col="offset").select("doc_id", "n", "offset")


@query("row_index", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
  (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1)::BIGINT idx
from lineitem""")
def q_row_index(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    li = table(spark, sf, "lineitem").select(*cols)
    return row_index(li, cols, out_col="idx")
