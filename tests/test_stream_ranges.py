"""Packing a stream by ranges: stream = batch with a hot key, null and tied rows, restarts and repeated micro-batches."""

import os

from pyspark.sql import functions as F

from tokenmill.operators import packing as K
from tokenmill.operators.rangepack import pack_on
from tokenmill.streaming import jobs as J


def _rows(spark, n):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    ids = F.when(F.col("id") % 17 == 0, None).otherwise(F.sequence(F.col("id").cast("int"), (F.col("id") + F.col("id") % 13).cast("int")))
    return spark.range(n).select(key.alias("key"), F.col("id").alias("at"), ids.alias("ids"))


def _blocks(df):
    return sorted(((r["key"] or "", r["block_id"], list(r["input_ids"])) for r in df.collect()))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    df = _rows(spark, 1500)
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def run():
        return J.stream_pack_ranges(J.read_stream(spark, path, df.schema), "key", "at", "ids", 34, 1, 2, out, ck)

    J.stage_as_files(df.where("at < 900"), path, "at", 3)
    progress = run()
    J.stage_as_files(df.where("at >= 900"), path, "at", 2)  # the next run goes on where the last one ended
    assert len(progress) + len(run()) == 5
    want = _blocks(K.pack_wrapped(df, F.col("ids"), ["at"], 34, 1, 2, group_cols=["key"]))
    assert _blocks(spark.read.parquet(out)) == want and len(want) > 200
    assert sorted(f for f in os.listdir(ck + "-rest") if f.startswith("epoch")) == ["epoch=3", "epoch=4"]

    # a micro-batch whose commit was lost is run again, and writes the same rows over
    for f in (os.path.join(ck, "commits", "4"), os.path.join(ck, "commits", ".4.crc")):
        if os.path.exists(f):
            os.remove(f)
    assert len(run()) == 1
    assert _blocks(spark.read.parquet(out)) == want


def test_left_over_of_every_group(spark):
    rows = spark.createDataFrame([("a", 0, 20, [1, 2]), ("a", 1, 0, list(range(17))), ("b", 0, 30, None), ("c", 1, None, [7] * 10),
                                  (None, 1, 0, [5])], "g string, o int, _begin long, _t array<int>")
    blocks, left = pack_on(rows, ["g"], ["o"], 10, text=False, partitions=3)
    assert sorted((r["g"], r["block_id"], list(r["_body"])) for r in blocks.collect()) == [
        ("a", 2, [1, 2, *range(8)]), ("c", 0, [7] * 10)]
    assert sorted(((r["g"] or "", r["block_id"], list(r["_body"])) for r in left.collect())) == [
        ("", 0, [5]), ("a", 3, list(range(8, 17))), ("b", 3, []), ("c", 1, [])]


def test_hot_key_is_many_tasks(spark):
    """A key with all the rows is cut by several tasks."""
    rows = _rows(spark, 4000).select(F.lit("hot").alias("g"), F.lit(True).alias("n"), "at", F.lit(0).alias("_begin"), F.col("ids").alias("_t"))
    blocks, _ = pack_on(rows, ["g"], ["n", "at"], 50, text=False, partitions=8)
    per_task = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 8 and max(per_task) < sum(per_task) / 4
