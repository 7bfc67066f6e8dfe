"""Registered tokenisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocab as V
from ..operators.joins import join_vocab
from ..operators.offsets import row_index
from ..session import table
from .catalog import query
from .fixtures import MOLECULES_SQL, char_ids_sql, molecules

PAT = V.SMILES_PATTERN


def _map_sql(d: dict) -> str:
    items = ", ".join("'" + k.replace("'", "''") + f"': {v}" for k, v in d.items())
    return "MAP {" + items + "}"


VOCAB_MAP_SQL = _map_sql(V.SMILES_VOCAB)


def _inv_map_sql() -> str:
    inv = {}
    for tok, i in V.SMILES_VOCAB.items():
        inv[i] = tok
    items = ", ".join(f"{i}: '" + t.replace("'", "''") + "'" for i, t in sorted(inv.items()))
    return "MAP {" + items + "}"


INV_MAP_SQL = _inv_map_sql()

MOL_TOKS_SQL = f"""with m as ({MOLECULES_SQL}),
t as (select mol_id, smiles, qed, sa, regexp_extract_all(smiles, '{PAT}', 1) toks from m),
i as (select *, list_transform(toks, lambda x: coalesce({VOCAB_MAP_SQL}[x], {V.SMILES_UNK}))::INTEGER[] ids from t)"""


def mol_ids(spark, sf):
    m = molecules(spark, sf)
    toks = T.smiles_tokens("smiles")
    return m.select("mol_id", "smiles", "qed", "sa", toks.alias("toks"),
                    T.tokens_to_ids(toks, V.SMILES_VOCAB, V.SMILES_UNK).alias("ids"))


# --------------------------------------------------------------------- T1 --
@query("tokenize_chars", f"""select doc_id, len(ids)::BIGINT n_tokens, array_to_string(ids, ' ') ids
from (select doc_id, {char_ids_sql()} ids from documents)""")
def q_tokenize_chars(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.char_ids("text").alias("ids"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), T.ids_text("ids").alias("ids"))


# --------------------------------------------------------------------- T2 --
@query("tokenize_smiles", MOL_TOKS_SQL + """
select mol_id, len(toks)::BIGINT n_tokens, array_to_string(toks, ' ') tokens from t""")
def q_tokenize_smiles(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", F.size("toks").cast("long").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


# --------------------------------------------------------------------- T3 --
@query("tokens_to_ids", MOL_TOKS_SQL + """
select mol_id, array_to_string(ids, ' ') ids from i""")
def q_tokens_to_ids(spark, sf):
    return mol_ids(spark, sf).select("mol_id", T.ids_text("ids").alias("ids"))


# ----------------------------------------------------------------- T4, T6 --
@query("ids_to_tokens", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_transform(ids, lambda x: coalesce({INV_MAP_SQL}[x], '[UNK]')), ' ') tokens from i""")
def q_ids_to_tokens(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", F.array_join(T.ids_to_tokens("ids", V.SMILES_VOCAB), " ").alias("tokens"))


@query("decode", MOL_TOKS_SQL + f"""
select mol_id, trim(replace(array_to_string(list_transform(ids, lambda x: coalesce({INV_MAP_SQL}[x], '[UNK]')), ' '), ' ##', '')) text,
  array_to_string(list_transform(ids, lambda x: coalesce({INV_MAP_SQL}[x], '[UNK]')), '') text_char from i""")
def q_decode(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.decode("ids", V.SMILES_VOCAB, "word").alias("text"),
                    T.decode("ids", V.SMILES_VOCAB, "char").alias("text_char"))


# --------------------------------------------------------------------- T5 --
@query("token_count", MOL_TOKS_SQL + """
select mol_id, len(ids)::BIGINT n_tokens, (len(ids) + 1)::BIGINT n_tokens_eos from i""")
def q_token_count(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.token_count("ids").alias("n_tokens"), T.token_count("ids", True).alias("n_tokens_eos"))


# --------------------------------------------------------------------- T7 --
@query("add_special_single", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_concat([{V.SMILES_CLS}], ids, [{V.SMILES_SEP}]), ' ') ids from i""")
def q_add_special_single(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(T.add_special_single("ids", V.SMILES_CLS, V.SMILES_SEP)).alias("ids"))


# --------------------------------------------------------------------- T8 --
@query("add_special_pair", f"""with c as (select conv_id, turn, {char_ids_sql()} ids from conversations)
select a.conv_id, a.turn, array_to_string(list_concat([0], a.ids, [1], b.ids, [1]), ' ') ids
from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def q_add_special_pair(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.char_ids("text").alias("ids"))
    # turns are consecutive, so the next turn is an equi-join on turn + 1
    # (hash-partitioned on both keys; a long conversation is not one task)
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("ids_b"))
    j = c.join(nxt, on=["conv_id", "turn"], how="inner")
    return j.select("conv_id", "turn", T.ids_text(T.add_special_pair("ids", "ids_b", V.CHAR_CLS, V.CHAR_SEP)).alias("ids"))


# --------------------------------------------------------------------- T9 --
@query("pad_tokens", MOL_TOKS_SQL + f"""
select mol_id,
  array_to_string(list_concat(ids, list_resize([]::INTEGER[], greatest(32 - len(ids), 0), {V.SMILES_PAD})), ' ') right_padded,
  array_to_string(list_concat(list_resize([]::INTEGER[], greatest(32 - len(ids), 0), {V.SMILES_PAD}), ids), ' ') left_padded
from i""")
def q_pad_tokens(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(T.pad_tokens("ids", 32, V.SMILES_PAD, "right")).alias("right_padded"),
                    T.ids_text(T.pad_tokens("ids", 32, V.SMILES_PAD, "left")).alias("left_padded"))


# -------------------------------------------------------------------- T10 --
@query("append_eos", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_append(ids, {V.SMILES_EOS}), ' ') ids from i""")
def q_append_eos(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(T.append_eos("ids", V.SMILES_EOS)).alias("ids"))


# -------------------------------------------------------------------- T11 --
@query("encode_fixed", MOL_TOKS_SQL + f"""
select mol_id,
  array_to_string(list_concat([{V.SMILES_CLS}], list_slice(ids, 1, 22), [{V.SMILES_SEP}],
     list_resize([]::INTEGER[], 22 - least(len(ids), 22), {V.SMILES_PAD})), ' ') input_ids,
  (least(len(ids), 22) + 2)::BIGINT n_real
from i""")
def q_encode_fixed(spark, sf):
    m = mol_ids(spark, sf)
    enc = T.encode_fixed("ids", 24, V.SMILES_CLS, V.SMILES_SEP, V.SMILES_PAD)
    mask = T.encode_fixed_mask("ids", 24)
    return m.select("mol_id", T.ids_text(enc).alias("input_ids"),
                    F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"))


# -------------------------------------------------------------------- T12 --
@query("encode_ragged", MOL_TOKS_SQL + f"""
select mol_id, array_to_string(list_concat([{V.SMILES_CLS}], list_slice(ids, 1, 10), [{V.SMILES_SEP}]), ' ') input_ids from i""")
def q_encode_ragged(spark, sf):
    m = mol_ids(spark, sf)
    return m.select("mol_id", T.ids_text(T.encode_ragged("ids", 12, V.SMILES_CLS, V.SMILES_SEP)).alias("input_ids"))


# -------------------------------------------------------------------- T13 --
@query("tokenize_pluggable", MOL_TOKS_SQL + """
select mol_id, array_to_string(ids, ' ') ids from i""")
def q_tokenize_pluggable(spark, sf):
    from ..functions.pluggable import pluggable_ids, regex_tokenizer_factory
    m = molecules(spark, sf)
    ids = pluggable_ids(F.col("smiles"), regex_tokenizer_factory(PAT, V.SMILES_VOCAB, V.SMILES_UNK, None))
    return m.select("mol_id", T.ids_text(ids).alias("ids"))


# -------------------------------------------------------------------- T14 --
@query("retokenize_for_eval", f"""with d as (select doc_id, list_slice({char_ids_sql()}, 1, 1024) ids,
   (row_number() over (order by doc_id) - 1) // 8 batch_id from documents)
select doc_id, batch_id::BIGINT batch_id, len(ids)::BIGINT n_real, (max(len(ids)) over (partition by batch_id))::BIGINT padded_len,
  array_to_string(list_concat(ids, list_resize([]::INTEGER[], (max(len(ids)) over (partition by batch_id)) - len(ids), {V.CHAR_PAD})), ' ') input_ids
from d""")
def q_retokenize_for_eval(spark, sf):
    from pyspark.sql import Window
    d = table(spark, sf, "documents")
    idx = row_index(d.select("doc_id"), ["doc_id"], out_col="_idx")
    x = (d.join(idx, "doc_id").select("doc_id", F.floor(F.col("_idx") / 8).cast("long").alias("batch_id"),
                                      T.truncate(T.char_ids("text"), 1024).alias("ids")))
    # a batch holds 8 rows: the window per batch is bounded
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    x = x.withColumn("padded_len", longest.cast("long"))
    padded = F.concat("ids", F.array_repeat(F.lit(V.CHAR_PAD), (F.col("padded_len") - F.size("ids")).cast("int")))
    return x.select("doc_id", "batch_id", F.size("ids").cast("long").alias("n_real"), "padded_len",
                    T.ids_text(padded).alias("input_ids"))


# -------------------------------------------------------------------- T15 --
@query("token_budget", f"""select source, count(*)::BIGINT n_docs, sum(len({char_ids_sql()}) + 1)::BIGINT n_tokens
from documents group by source""")
def q_token_budget(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.sum(T.char_count("text") + 1).alias("n_tokens"))  # no id array is built


# --------------------------------------------------------------------- J1 --
@query("join_vocab", MOL_TOKS_SQL + """
select mol_id, array_to_string(ids, ' ') ids from i""")
def q_join_vocab(spark, sf):
    m = molecules(spark, sf).select("mol_id", T.smiles_tokens("smiles").alias("toks"))
    vocab = spark.createDataFrame(sorted(V.SMILES_VOCAB.items(), key=lambda kv: kv[1]), "token string, id int")
    out = join_vocab(m, ["mol_id"], "toks", vocab, V.SMILES_UNK)
    return out.select("mol_id", T.ids_text("ids").alias("ids"))
