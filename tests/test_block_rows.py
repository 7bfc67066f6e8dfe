"""Blocks of a long sequence, and running sums of groups."""

from pyspark.sql import functions as F

from tokenmill.operators import offsets as O
from tokenmill.operators import packing as K


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_do_not_carry_their_sequence(spark):
    seqs = spark.range(3).select(F.col("id").alias("seq"), F.sequence(F.lit(0), F.col("id").cast("int") * 40).alias("ids"))
    seqs = seqs.withColumn("v", F.transform("ids", lambda x: x.cast("double")))
    out = K.split_into_blocks(seqs, "ids", 16, ["seq"], "v")
    line = next(x for x in plan(out).splitlines() if "Generate inline" in x)
    carried = line.rsplit("), [", 1)[1].split("]")[0]
    assert carried.startswith("seq#") and "," not in carried
    got = [(r["seq"], r["block_id"], list(r["block_ids"]), r["block_mean"]) for r in out.orderBy("seq", "block_id").collect()]
    assert got == [(s, b, list(range(16 * b, 16 * b + 16)), 16 * b + 7.5) for s, n in ((1, 2), (2, 5)) for b in range(n)]


def test_group_bases_are_a_row_a_range(spark):
    """A hot group over all ranges and many small ones: the rows are shuffled once after they are placed, the bases not at all."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.col("id").alias("at"), F.lit(2).alias("n"))
    summed = O.running_offset(rows, "n", ["at"], ["g"], "before")
    least = O.running_agg(rows, "at", ["at"], ["g"], "min", "least", count_col="place")
    for p in (plan(summed), plan(least)):
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "ShuffledHashJoin" not in p
        assert "REPARTITION_BY_NUM" in p
    assert {(r["g"] == -1, r["before"] - (r["at"] if r["g"] == -1 else 0)) for r in summed.collect()} == {(True, 0), (False, 0)}
    assert all((r["least"], r["place"]) == ((0, r["at"] // 2 + 1) if r["g"] == -1 else (r["at"], 1)) for r in least.collect())
    assert O.running_offset(rows.withColumn("g", F.when(F.col("g") >= 0, F.col("g"))), "n", ["at"], ["g"]).count() == 2000
