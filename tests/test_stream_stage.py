"""Staging of a stream's files, and packing by state in pieces."""

import os

from pyspark.sql import functions as F

from tokenmill.operators import packing as K
from tokenmill.plans import q_stream as Q
from tokenmill.streaming import jobs as J


def test_files_come_in_order_however_many_a_batch_takes(spark, tmp_path):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") * 7 % 3000).alias("at"))
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    J.stage_as_files(df, path, "at", 12)
    J.stage_as_files(df.selectExpr("at + 3000 as at"), path, "at", 8)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    rows = {f: spark.read.parquet(os.path.join(path, f)) for f in files}
    spans = sorted((os.path.getmtime(os.path.join(path, f)), *r.agg(F.min("at"), F.max("at"), F.count("at")).first()) for f, r in rows.items())
    first = [s for s in spans if s[1] < 3000]
    assert len(spans) == 20 and len(first) == 12 and max(s[3] for s in spans) < 1000
    assert [s[1] for s in first] == sorted(s[1] for s in first)
    assert all(a[2] < b[1] for a, b in zip(first, first[1:]))
    assert len(J.run_to_parquet(J.read_stream(spark, path, df.schema, 7), out, ck)) == 3
    assert sorted(r["at"] for r in spark.read.parquet(out).collect()) == list(range(6000))


def test_staging_is_many_tasks(spark, monkeypatch, tmp_path):
    """No task writes a whole micro-batch, and a micro-batch is read by several."""
    asked = []
    real = J.stage_as_files
    monkeypatch.setattr(J, "stage_as_files", lambda df, path, order, n: asked.append(n) or real(df, path, order, n))
    spark.range(1000).select(F.col("id").alias("l_orderkey"), F.lit("A").alias("l_returnflag"), F.lit(0.1).alias("l_discount"),
                             F.lit(0.0).alias("l_tax")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert Q.q_stream_best_monitor(spark, str(tmp_path)).first()["n_seen"] == 1000
    assert asked == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_state_packing_in_pieces(spark, monkeypatch, tmp_path):
    """Blocks of a key leave before all its ids are joined; a larger text comes in more micro-batches."""
    monkeypatch.setattr(J, "PIECE_IDS", 100)
    monkeypatch.setattr(Q, "BATCH_BYTES", 3_000)
    words = F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id").cast("string")), 20))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, words).alias("text"),
                                   F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    runs = []
    real = J.run_to_parquet
    monkeypatch.setattr(J, "run_to_parquet", lambda *a, **k: runs.append(real(*a, **k)))
    got = {(r["source"], r["block_id"]): r["input_ids"] for r in Q.q_stream_pack_state(spark, str(tmp_path)).collect()}
    batch = K.pack_chars(docs, "text", ["doc_id"], 64, Q.V.CHAR_BOS, Q.V.CHAR_EOS, group_cols=["source"])
    assert got == {(r["source"], r["block_id"]): " ".join(map(str, r["input_ids"])) for r in batch.collect()}
    assert len(got) > 400 and len(runs[0]) > 2 * Q.N_BATCHES
