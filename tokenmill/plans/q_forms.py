"""Registered corpus forms (S3, S5, S6 end to end) and the user-function surface."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from ..functions import pluggable as P
from ..functions import tokens as T
from ..functions import vocab as V
from ..functions.rand import uniform_sql
from ..session import scratch_path, table
from ..sources import corpus as C
from ..sources import fs
from .catalog import query
from .fixtures import MOLECULES_SQL, char_ids_sql, molecules
from .prepare import prepare_corpus, valid_batches
from .q_tokens import MOL_TOKS_SQL, mol_ids

# ----------------------------------------------- S3, S5: raw text by offsets --
#: The raw text: letters and single spaces of all documents in doc_id order.
RAW_SQL = "select string_agg(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) || ' ', '' order by doc_id) t from documents"
OFFSETS = (("train", 0, 90_000), ("validation", 90_000, 130_000), ("test", 130_000, None))
BLOCK = 64


def _raw_text(spark, sf) -> str:
    """The documents' raw text as the files of one folder, in doc_id order."""
    path = scratch_path(spark, "raw_text")
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a task writes one
    ordered = table(spark, sf, "documents").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    ordered.select(words.alias("value")).write.option("lineSep", " ").text(path)
    return path


def _split_sql(name: str, start: int, end: int | None, chunk: int) -> str:
    part = f"substring(t, {start + 1})" if end is None else f"substring(t, {start + 1}, {end - start})"
    return f"""select '{name}' split, unnest(l) as "text", (generate_subscripts(l, 1) - 1)::BIGINT id
from (select regexp_extract_all({part}, '.{{{chunk}}}') l from raw)"""


TEXT8_SQL = f"with raw as ({RAW_SQL}) " + " union all ".join(_split_sql(*s, 256) for s in OFFSETS)


@query("corpus_text8_splits", f"select split, id, text from ({TEXT8_SQL})")
def q_corpus_text8_splits(spark, sf):
    path = _raw_text(spark, sf)
    return C.union_splits({s: C.scan_corpus(spark, "text8", path, mode=s, chunk=256, splits=OFFSETS).select("id", "text")
                           for s, _, _ in OFFSETS})


#: The training text of ``prepare_text8_crop``: all of the raw text.
WHOLE = ("train", 0, None)


def _packed_text8_sql(offsets: tuple, chunk: int, block: int) -> str:
    body = block - 2
    return f"""with raw as ({RAW_SQL}), c as ({_split_sql(*offsets, chunk)}),
d as (select id, list_append({char_ids_sql()}, {V.CHAR_EOS}) ids from c),
u as (select id, unnest(ids) tok, generate_subscripts(ids, 1) p from d),
g as (select (row_number() over (order by id, p) - 1) gpos, tok from u),
b as (select gpos // {body} block_id, list(tok order by gpos) ids from g group by all)
select block_id::BIGINT block_id, array_to_string(list_concat([{V.CHAR_BOS}], ids, [{V.CHAR_EOS}]), ' ') input_ids
from b where len(ids) = {body}"""


@query("prepare_text8_crop", _packed_text8_sql(WHOLE, 4 * BLOCK, 2 * BLOCK))
def q_prepare_text8_crop(spark, sf):
    out = prepare_corpus(spark, "text8-crop", _raw_text(spark, sf), mode="train", block_size=BLOCK, splits=[WHOLE])
    return out.select("block_id", T.ids_text("input_ids").alias("input_ids"))


# --------------------------------------------------- S3, S6: rows held out --
def _held_out_sql(kept: str) -> str:
    return f"""select doc_id, length(coalesce(text, ''))::BIGINT n_chars from (
  select *, row_number() over (order by doc_id) rn, count(*) over () n from documents) where {kept}"""


@query("corpus_openwebtext", f"""select 'train' part, * from ({_held_out_sql('rn <= n - 50')})
union all select 'valid', * from ({_held_out_sql('rn > n - 50')})""")
def q_corpus_openwebtext(spark, sf):
    path = os.path.join(sf, "documents.parquet")
    parts = [C.scan_corpus(spark, f"openwebtext-{p}", path, mode=p, order_cols=["doc_id"], holdout=50)
             .select(F.lit(p).alias("part"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
             for p in ("train", "valid")]
    return parts[0].unionByName(parts[1])


# ------------------------------------------------------- S3: split column --
@query("prepare_split", f"""select mol_id, array_to_string(list_concat([{V.CHAR_CLS}], list_slice(ids, 1, 22), [{V.CHAR_SEP}],
  list_resize([]::INTEGER[], greatest(22 - len(ids), 0), {V.CHAR_PAD})), ' ') input_ids
from (select mol_id, {char_ids_sql("smiles")} ids from ({MOLECULES_SQL})) where mol_id % 10 = 1""")
def q_prepare_split(spark, sf):
    path = scratch_path(spark, "mode_splits")
    m = molecules(spark, sf).select("mol_id", F.col("smiles").alias("input"), F.when(
        F.col("mol_id") % 10 == 0, "test").when(F.col("mol_id") % 10 == 1, "validation").otherwise("train").alias("split"))
    m.write.partitionBy("split").parquet(path)
    out = prepare_corpus(spark, "molecule_text", path, mode="validation", wrap=False, block_size=24, order_cols=["mol_id"])
    return out.select("mol_id", T.ids_text("input_ids").alias("input_ids"))


# ------------------------------------- T3, T6, K5: a whole vocabulary file --
#: The file: every token of the molecules in code-point order, then the special tokens.
SPECIALS = ("[UNK]", "[PAD]", "[EOS]", "[BOS]", "[SEP]", "[CLS]", "[MASK]", "[UNK]")
VOCAB_SQL = MOL_TOKS_SQL + """,
v as (select token, row_number() over (order by token) - 1 id from (select distinct unnest(toks) token from t)),
n as (select count(*) n from v),
w as (select map(list(token), list(id)) id_of from v),
e as (select mol_id, toks, list_transform(toks, lambda x: w.id_of[x])::INTEGER[] ids from t, w)"""


def _vocab_file(spark, sf) -> str:
    path = scratch_path(spark, "whole_vocab")
    tokens = mol_ids(spark, sf).select(F.explode("toks").alias("token")).distinct()
    lines = [r["token"] for r in tokens.orderBy("token").collect()]  # a vocabulary, not data
    fs.makedirs(path)
    with fs.open_output(f"{path}/vocab.txt") as f:
        f.write("\n".join([*lines, *SPECIALS, ""]).encode())
    return f"{path}/vocab.txt"


@query("prepare_molecules", VOCAB_SQL + """
select mol_id, array_to_string(list_concat([(n + 3)::INTEGER], ids, [(n + 2)::INTEGER],
  list_resize([]::INTEGER[], 18 - len(ids), (n + 1)::INTEGER)), ' ') input_ids from e, n where len(ids) <= 18""")
def q_prepare_molecules(spark, sf):
    path = scratch_path(spark, "molecule_table")
    molecules(spark, sf).select("mol_id", F.col("smiles").alias("input")).write.parquet(path)
    out = prepare_corpus(spark, "smiles", path, wrap=False, block_size=20, tokenizer="smiles", order_cols=["mol_id"],
                         vocab_path=_vocab_file(spark, sf))
    return out.select("mol_id", T.ids_text("input_ids").alias("input_ids"))


@query("molecule_round_trip", VOCAB_SQL + """
select mol_id, array_to_string(ids, ' ') ids, array_to_string(toks, '') text from e""")
def q_molecule_round_trip(spark, sf):
    vocab = C.load_vocab(spark, _vocab_file(spark, sf))
    ids = molecules(spark, sf).select("mol_id", T.smiles_ids("smiles", vocab, vocab.unk).alias("ids"))
    return ids.select("mol_id", T.ids_text("ids").alias("ids"), T.decode("ids", vocab, "char").alias("text"))


# ---------------------------------------------------- validation batches --
VALID_SEED = 7


@query("valid_batches", f"""select doc_id, p::BIGINT epoch_pos, (p // 8)::BIGINT batch_id from (
  select doc_id, row_number() over (order by {uniform_sql(VALID_SEED, "'perm'", 'doc_id')}, doc_id) - 1 p from documents)""")
def q_valid_batches(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return valid_batches(docs, "doc_id", 8, VALID_SEED).select("doc_id", "epoch_pos", "batch_id")


# ------------------------------------------------------------------- U1 --
@query("user_batch_map", """select doc_id, length(coalesce(text, ''))::BIGINT n_chars,
  (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::BIGINT n_spaces from documents""")
def q_user_batch_map(spark, sf):
    def lengths(b: pd.DataFrame) -> pd.DataFrame:
        text = b["text"].fillna("")
        return pd.DataFrame({"doc_id": b["doc_id"], "n_chars": text.str.len(), "n_spaces": text.str.count(" ")})

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return P.map_batches(docs, lengths, "doc_id long, n_chars long, n_spaces long")


# ------------------------------------------------------------------- U2 --
@query("user_predicate", f"select mol_id, smiles from ({MOLECULES_SQL}) where length(smiles) <= 12 and smiles not like '%X%'")
def q_user_predicate(spark, sf):
    def factory():
        return lambda texts: [t is not None and len(t) <= 12 and "X" not in t for t in texts]

    m = molecules(spark, sf).select("mol_id", "smiles")
    return m.where(P.pluggable_predicate(F.col("smiles"), factory))


# ------------------------------------------------------------------- U3 --
@query("user_scorer", f"""select mol_id, length(regexp_replace(smiles, '[^NOS]', '', 'g')) / length(smiles) score
from ({MOLECULES_SQL})""")
def q_user_scorer(spark, sf):
    def factory():
        hetero = set("NOS")
        return lambda texts: [sum(c in hetero for c in t) / len(t) if t else None for t in texts]

    return molecules(spark, sf).select("mol_id", P.pluggable_scores(F.col("smiles"), factory).alias("score"))


# ------------------------------------------------------------------- U4 --
@query("user_model_scorer", f"""with d as (select doc_id, {char_ids_sql()} ids from documents),
u as (select doc_id, unnest(ids) id, generate_subscripts(ids, 1) - 1 p from d),
b as (select doc_id, p, row_number() over (partition by doc_id, id order by p) - 1 before from u)
select d.doc_id, count(p)::BIGINT n_tokens, avg(ln((before + 1.0) / (p + {V.CHAR_VOCAB_SIZE}))) mean_log_prob
from d left join b using (doc_id) group by d.doc_id""")
def q_user_model_scorer(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.char_ids("text").alias("ids"))
    scored = docs.select("doc_id", P.model_log_probs(F.col("ids"), P.adaptive_unigram_factory(V.CHAR_VOCAB_SIZE)).alias("lp"))
    total = F.aggregate("lp", F.lit(0.0), lambda a, x: a + x)
    n = F.size("lp")
    return scored.select("doc_id", n.cast("long").alias("n_tokens"), F.when(n > 0, total / n).alias("mean_log_prob"))


# ------------------------------------------------------------------- U5 --
TURNS, PIECE = 64, 48


@query("user_table_function", f"""with r as (select conv_id, turn // {TURNS} batch,
  string_agg(coalesce(text, '') || chr(10), '' order by turn, text) t from conversations group by all),
p as (select conv_id, batch, regexp_extract_all(t, '(?s).{{1,{PIECE}}}') l from r)
select conv_id, batch::BIGINT batch, (generate_subscripts(l, 1) - 1)::BIGINT piece_idx, unnest(l) piece from p""")
def q_user_table_function(spark, sf):
    """Turns of a conversation in batches of 64 (so a long one is many groups), each joined and cut into pieces."""
    turns = table(spark, sf, "conversations").select("conv_id", F.floor(F.col("turn") / TURNS).alias("batch"), "turn", "text")
    pieces = P.join_and_cut_udtf()
    return pieces(turns.asTable().partitionBy("conv_id", "batch").orderBy("turn", "text"), F.lit(PIECE))
