"""Packing keeps every token whatever the order keys are."""

import random

import pytest

from tokenmill.operators import packing as K

KEYS = [(1, "abcde"), (1, "fghij"), (2, "klmno"), (None, "pqrst"), (None, "uvwxy")]


def test_repeated_and_null_keys_keep_their_tokens(spark):
    df = spark.createDataFrame(KEYS, "k long, text string")
    got = K.pack_chars(df, "text", ["k"], 5, 2, 3, insert_special=False, insert_eos=False).collect()
    assert sorted(r["block_id"] for r in got) == [0, 1, 2, 3, 4]
    # ids of the 25 letters, each once
    assert sorted(x for r in got for x in r["input_ids"]) == list(range(8, 33))


def test_the_two_packers_agree_on_repeated_keys(spark):
    from pyspark.sql import functions as F

    from tokenmill.functions import tokens as T
    df = spark.createDataFrame(KEYS, "k long, text string").withColumn("ids", T.char_ids("text"))
    wide = K.pack_wrapped(df, F.col("ids"), ["k"], 7, 2, 3).collect()
    assert sorted(r["block_id"] for r in wide) == [0, 1, 2, 3, 4]
    assert sorted(x for r in wide for x in r["input_ids"][1:-1]) == list(range(8, 33))


def packed(rows, chunk):
    """Blocks of each group in plain Python; rows: (group, key, text) with different keys in a group."""
    out = {}
    for g in {g for g, _, _ in rows}:
        body = "".join(t for _, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]))
        for i in range(len(body) // chunk):
            out[g, i] = body[i * chunk:(i + 1) * chunk]
    return out


@pytest.mark.parametrize("chunk, partitions", [(1, 7), (4, 7), (50, 3), (1000, 8)])
def test_groups_over_many_ranges(spark, chunk, partitions):
    """A hot group, one without a name, short ones, blocks that straddle several ranges, empty and long texts."""
    from pyspark.sql import functions as F

    from tokenmill.functions import tokens as T
    from tokenmill.operators.rangepack import pack_ranges
    rng = random.Random(chunk)
    word = lambda n: "".join(rng.choice("abcdé😀") for _ in range(n))
    rows = [("hot", i, word(rng.choice([0, 1, 3, 9, 30]))) for i in range(300)] + [("hot", 1000, word(4000))]
    rows += [(None, i, word(5)) for i in range(40)] + [(f"g{j}", i, word(rng.randint(0, 6))) for j in range(30) for i in range(3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, t string").repartition(5)
    ready = df.select("g", "k", F.col("t").alias("_t"))
    out = pack_ranges(ready, ["g"], ["k"], chunk, True, partitions=partitions).collect()
    assert len(out) == len({(r["g"], r["block_id"]) for r in out})
    assert {(r["g"], r["block_id"]): r["_body"] for r in out} == packed(rows, chunk)
    ids = df.select("g", "k", F.transform(F.split("t", ""), lambda c: F.ascii(c)).alias("_t"))
    ids = ids.withColumn("_t", F.expr("filter(_t, x -> x > 0)"))
    got = {(r["g"], r["block_id"]): "".join(map(chr, r["_body"])) for r in pack_ranges(ids, ["g"], ["k"], chunk, False, partitions=partitions).collect()}
    assert got == packed(rows, chunk)


def test_one_order_key_for_all_rows_is_many_ranges(spark):
    from pyspark.sql import functions as F

    from tokenmill.operators import rangepack
    df = spark.range(0, 4000).select(F.lit(None).cast("long").alias("k"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("_t"))
    seen, real = [], rangepack.cut_lineage
    rangepack.cut_lineage = lambda x: seen.append(real(x)) or seen[-1]
    try:
        out = rangepack.pack_ranges(df, [], ["k"], 10, True, partitions=8)
    finally:
        rangepack.cut_lineage = real
    sizes = [r["count"] for r in seen[0].groupBy("_pid").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    body = "".join(r["_body"] for r in out.orderBy("block_id").collect())
    assert sum(len(f"t{i}") for i in range(4000)) - len(body) < 10 and pack_empty(df)


def pack_empty(df):
    from tokenmill.operators.rangepack import pack_ranges
    return pack_ranges(df.limit(0), [], ["k"], 10, True).collect() == []


def test_every_progress_record_of_a_stream_is_kept(spark, tmp_path):
    from tokenmill.streaming import jobs as J
    src = str(tmp_path / "in")
    spark.range(0, 130, 1, 130).write.parquet(src)
    sdf = J.read_stream(spark, src, "id long")
    progress = J.run_to_parquet(sdf, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sum(n for _, n, _ in J.throughput(progress)) == 130
