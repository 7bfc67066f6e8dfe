"""Rows that a scan multiplies stay small: windows, blocks and model scores leave in pieces of bounded size."""

from pyspark.sql import functions as F

from tokenmill.functions import pluggable as P
from tokenmill.operators import seqeval as E


def _generated(df) -> str:
    """The input columns that every generated row carries on."""
    line = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate inline" in x)
    return line.rsplit("), [", 1)[1].split("]")[0]


def test_windows_do_not_carry_their_sequence(spark):
    seqs = spark.range(3).select(F.col("id").alias("seq"), F.sequence(F.lit(0), F.col("id").cast("int") * 40).alias("ids"))
    w = E.window_ids(seqs, "ids", 16, 8, ["seq"])
    assert _generated(w).startswith("seq#") and "ids#" not in _generated(w)
    assert {(r["window_id"], len(r["win_ids"]), r["n_scored"]) for r in w.where("seq = 0").collect()} == {(0, 1, 0)}


def test_a_model_gets_a_batch_in_pieces(spark):
    """Twenty sequences of 100,000 ids are one Arrow batch, and more than a model gets in one call."""
    def factory():
        def score(seqs):
            total = float(sum(len(s) for s in seqs))
            return [[total] if len(s) else [] for s in seqs]
        return score

    df = spark.range(0, 22, 1, 1).select("id", F.when(F.col("id") < 20, F.sequence(F.lit(1), F.lit(100_000))).otherwise(
        F.array().cast("array<int>")).alias("ids"))
    out = {r["id"]: r["lp"] for r in df.select("id", P.model_log_probs(F.col("ids"), factory).alias("lp")).collect()}
    assert len(out) == 22 and out[20] == out[21] == []
    assert max(out[i][0] for i in range(20)) <= P.PIECE_IDS + 100_000 < 2_000_000
