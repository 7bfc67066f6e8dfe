"""Costly steps are taken once, and by as many tasks as there are shuffle partitions."""

import os

from pyspark.sql import functions as F

from tokenmill.operators import setmetrics as S
from tokenmill.plans import q_corpus, q_forms, q_metrics
from tokenmill.sources import fs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_figures_need_one_exchange(spark, tmp_path):
    """From the block losses on, nothing is shuffled until the figures of (interval, batch) are summed up."""
    spark.range(60).select(F.floor(F.col("id") / 4).alias("l_orderkey"), F.col("id").alias("l_linenumber"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
                           F.lit(1.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"), (F.col("id") % 10 / 100).alias("l_discount"), F.lit(0.0).alias("l_tax"),
                           F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    v = q_metrics.M.clip_interval_variance(q_metrics.block_losses(spark, str(tmp_path)))
    above = plan(v).split("Generate", 1)[0]
    assert above.count("Exchange") == 1 and "hashpartitioning(batch_id" not in above and "hashpartitioning(batch_id" in plan(v)
    assert {r["n_batches"] for r in v.collect()} == {4}


def test_batch_entropy_counts_tokens_once(spark, monkeypatch, tmp_path):
    spark.range(30).select(F.col("id").alias("doc_id"), F.lit("ab ba").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    out = q_metrics.q_agg_batch_entropy(spark, str(tmp_path))
    assert "FileScan parquet" not in plan(out)  # the tokens were counted before
    assert sorted((r["batch_id"], r["batch_size"]) for r in out.collect()) == [(0, 8), (1, 8), (2, 8), (3, 6)]


def test_items_are_tokenised_once(spark):
    """A string's tokens are one expression in the validity rule and in its bigrams, and the items are read once."""
    items = spark.createDataFrame([("C1CC1",), ("CC(",), ("c1ccccc1",), ("N",), ("",), ("C%12C",)], "item string")
    valid = items.select("item", S.well_formed("item").alias("valid"))
    assert plan(valid).count("regexp_extract_all") == 1
    assert {r["item"] for r in valid.where("valid").collect()} == {"C1CC1", "c1ccccc1", "N"}
    out = S.diversity(S.distinct_items(valid, "item", "valid"), "item")
    assert plan(out).count("Scan ExistingRDD") == 1
    assert round(out.first()["diversity"], 9) == 1 and out.first()["n_distinct"] == 3  # no two share a bigram


def test_written_inputs_have_a_file_a_task(spark, monkeypatch, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit(10).alias("n_chars")).write.parquet(
        str(tmp_path / "documents.parquet"))
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = q_forms._raw_text(spark, str(tmp_path))
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == p
    shards = []
    real = q_corpus.S.write_arrow_shards
    monkeypatch.setattr(q_corpus.S, "write_arrow_shards", lambda df, path, **k: shards.append(path) or real(df, path, **k))
    assert q_corpus.q_scan_arrow_shards(spark, str(tmp_path)).count() == 400
    assert len(fs.list_files(shards[0])) == p
