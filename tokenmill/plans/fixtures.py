"""Fixtures derived from the given tables, in Spark and as DuckDB SQL.

Each fixture is one function returning a DataFrame and one SQL text that
DuckDB evaluates to the same rows (used as a CTE by the oracles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..session import table

# ------------------------------------------------------------- molecules --
# FIXED VALUES: the molecule fixture (eight skeletons by p_partkey % 8, six
# suffixes by p_size % 6), qed and sa scores by rule.
SKELETONS = ["CC(=O)O", "c1ccccc1", "C[C@H](N)C(=O)O", "ClCCBr", "C1CC", "N#C/C=C\\C", "CC(C",
             "O=S(=O)(N)c%12ccccc%12"]
SUFFIXES = ["", "N", "OC", "CCl", ".[Na+]", "XO"]


def _case(col, values, mod: int) -> F.Column:
    expr = None
    for i, v in enumerate(values):
        cond = (F.col(col) % mod) == i
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def molecules(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("mol_id"),
        F.concat(_case("p_partkey", SKELETONS, 8), _case("p_size", SUFFIXES, 6)).alias("smiles"),
        (F.lit(0.3) + (F.col("p_partkey") % 7) / 10.0).cast("double").alias("qed"),
        (F.lit(1.0) + (F.col("p_size") % 5)).cast("double").alias("sa"))


def _sql_case(col, values, mod):
    parts = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {col} % {mod} {parts} end"


MOLECULES_SQL = f"""select p_partkey mol_id,
  concat({_sql_case('p_partkey', SKELETONS, 8)}, {_sql_case('p_size', SUFFIXES, 6)}) smiles,
  (0.3 + (p_partkey % 7)/10.0)::DOUBLE qed, (1.0 + (p_size % 5))::DOUBLE sa
from part"""


# ---------------------------------------------------------------- losses --
POS_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Per-token loss table (seq_id, pos, nll, mask, phase) from lineitem; pos
    is unique within a sequence (row number in a fixed column order)."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*POS_ORDER)
    return li.select(
        F.col("l_orderkey").alias("seq_id"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
        (F.col("l_discount") * 10 + F.col("l_tax")).alias("nll"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).cast("int").alias("mask"),
        F.when(F.col("l_orderkey") % 10 == 0, "val").otherwise("train").alias("phase"),
        F.col("l_linenumber").cast("int").alias("token"),
        F.col("l_suppkey").alias("l_suppkey"),
        F.col("l_quantity").alias("l_quantity"))


LOSSES_SQL = f"""select l_orderkey seq_id,
  (row_number() over (partition by l_orderkey order by {', '.join(POS_ORDER)}) - 1)::BIGINT pos,
  l_discount*10 + l_tax nll, (case when l_returnflag='R' then 0 else 1 end)::INTEGER mask,
  case when l_orderkey % 10 = 0 then 'val' else 'train' end phase,
  l_linenumber::INTEGER token, l_suppkey, l_quantity
from lineitem"""


# ------------------------------------------------------------ candidates --
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over each embedding vector: (seq_id, pos, token_id, logit, prob)."""
    e = table(spark, sf, "embeddings")
    x = e.select(F.col("vec_id").alias("seq_id"), F.lit(0).cast("long").alias("pos"), F.col("label"),
                 F.posexplode("embedding").alias("token_id", "logit"))
    x = x.withColumn("logit", F.col("logit").cast("double")).withColumn("token_id", F.col("token_id").cast("int"))
    w = Window.partitionBy("seq_id", "pos")
    m = F.max("logit").over(w)
    return (x.withColumn("_e", F.exp(F.col("logit") - m))
            .withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e"))


CANDIDATES_SQL = """select seq_id, pos, label, token_id, logit, e / sum(e) over (partition by seq_id, pos) prob
from (select *, exp(logit - max(logit) over (partition by seq_id, pos)) e
      from (select vec_id seq_id, 0::BIGINT pos, label, (generate_subscripts(embedding, 1) - 1)::INTEGER token_id,
                   unnest(embedding)::DOUBLE logit from embeddings))"""


# ------------------------------------------------------- char token docs --
def doc_char_ids(spark: SparkSession, sf: str, eos: int | None = None) -> DataFrame:
    d = table(spark, sf, "documents")
    ids = T.char_ids("text")
    if eos is not None:
        ids = T.append_eos(ids, eos)
    return d.select("doc_id", "source", "lang", ids.alias("ids"))


def char_ids_sql(text: str = "text") -> str:
    """DuckDB list of character ids of ``text`` (same rule as T1)."""
    return (f"(case when {text} is null or length({text}) = 0 then []::INTEGER[] else "
            f"[(case when c = ' ' then 34 when ascii(c) between 97 and 122 then ascii(c) - 89 else 7 end)::INTEGER "
            f"for c in string_split(lower({text}), '')] end)")


def ids_string_sql(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"
