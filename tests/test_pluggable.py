"""The user-function surface (U1-U6) gives the same rows as the built-in operators."""

import pandas as pd
from pyspark.sql import functions as F

from tokenmill.functions import pluggable as P
from tokenmill.operators import packing as K


def test_map_predicate_udtf_metric(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "xy"), (3, "")], "k long, t string")
    # U1
    out = P.map_batches(df, lambda b: b.assign(n=b["t"].str.len()), "k long, t string, n long")
    assert {r["k"]: r["n"] for r in out.collect()} == {1: 10, 2: 2, 3: 0}
    # U2
    kept = df.where(P.pluggable_predicate(F.col("t"), lambda: (lambda xs: [len(x) > 1 for x in xs])))
    assert sorted(r["k"] for r in kept.collect()) == [1, 2]
    # Same chunks as the JVM operator
    spark.udtf.register("chunks", P.chunk_udtf())
    df.createOrReplaceTempView("u5_docs")
    py = sorted(tuple(r) for r in spark.sql(
        "select k, c.chunk_idx, c.chunk from u5_docs, lateral chunks(t, 4) c").collect())
    jvm = sorted(tuple(r) for r in K.chunk_text(df, "t", 4, keep=["k"]).select("k", "chunk_idx", "chunk").collect())
    assert py == jvm
    # U6
    m = df.groupBy().agg(P.user_metric(F.length("t").cast("double"), lambda s: float(pd.Series(s).median())).alias("m"))
    assert m.first()["m"] == 2.0


def test_scorer_and_model_plugins(spark):
    df = spark.createDataFrame([(1, "CCO", [1, 2, 3]), (2, "c1ccccc1", [4, 5])], "k long, s string, ids array<int>")
    # A row scorer loaded once per worker
    scored = df.select("k", P.pluggable_scores(F.col("s"), lambda: (lambda xs: [len(x) / 10 for x in xs])).alias("q"))
    assert {r["k"]: r["q"] for r in scored.collect()} == {1: 0.3, 2: 0.8}
    # U4: per-token log-probs from a user model
    lp = df.select("k", P.model_log_probs(F.col("ids"), lambda: (lambda seqs: [[-float(t) for t in s] for s in seqs])).alias("lp"))
    assert {r["k"]: list(r["lp"]) for r in lp.collect()} == {1: [-1.0, -2.0, -3.0], 2: [-4.0, -5.0]}
