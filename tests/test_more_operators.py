"""More operator checks against brute force on small inputs."""

from pyspark.sql import functions as F

from tokenmill.functions import tokens as T
from tokenmill.functions import vocab as V
from tokenmill.operators import joins as J
from tokenmill.operators import offsets as O
from tokenmill.operators import packing as K


def test_block_context_ranges_equal_pair_masks(spark):
    nbs = {1: 1, 2: 3, 3: 5}
    blocks = spark.createDataFrame([(s, b) for s, nb in nbs.items() for b in range(nb)], "seq long, blk long")
    ranges = K.block_context_ranges(blocks, "seq", "blk").collect()
    got = set()
    for r in ranges:
        for k in range(r["kv_lo"], r["kv_hi"] + 1):
            got.add((r["seq"], r["q_kind"], r["q_block"], r["kv_kind"], k))
    want = set()
    for s, nb in nbs.items():
        for q in range(nb):
            for k in range(nb):
                if k == q:
                    want.add((s, "noisy", q, "noisy", k))   # block diagonal
                if k < q:
                    want.add((s, "noisy", q, "clean", k))   # offset block-causal
                if k <= q:
                    want.add((s, "clean", q, "clean", k))   # block-causal
    assert got == want


def test_join_vocab_both_paths(spark):
    rows = spark.createDataFrame([(1, "CC(=O)O[UNK]X"), (2, "c1ccccc1Cl"), (3, ""), (4, None)], "k long, s string")
    toks = rows.select("k", T.smiles_tokens("s").alias("toks"))
    vocab = spark.createDataFrame(sorted(V.SMILES_VOCAB.items(), key=lambda kv: kv[1]), "token string, id int")
    want = {r["k"]: list(r["ids"]) for r in rows.select("k", T.smiles_ids("s").alias("ids")).collect()}
    got = {r["k"]: list(r["ids"]) for r in J.join_vocab(toks, ["k"], "toks", vocab, V.SMILES_UNK).collect()}
    assert got == want
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # shuffle-join path
    try:
        got2 = {r["k"]: list(r["ids"]) for r in J.join_vocab(toks, ["k"], "toks", vocab, V.SMILES_UNK).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got2 == want and want[3] == want[4] == []


def test_offset_strategies_agree(spark):
    df = spark.range(0, 400).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"),
                                    (F.col("id") * 13 % 11).alias("n"))
    a = {(r["g"], r["k"]): r["o"] for r in O.running_offset(df, "n", ["k"], ["g"], "o").collect()}
    b = {(r["g"], r["k"]): r["o"] for r in O.running_offset(df, "n", ["k"], ["g"], "o", strategy="window").collect()}
    assert a == b


def test_fixed_rows_observed_accounting(spark, tmp_path):
    df = spark.createDataFrame([(i, "C" * (i % 20)) for i in range(100)], "k long, s string")
    rows, accounting = K.build_fixed_rows_observed(df, T.smiles_ids("s"), 16, 1, 2, 0)
    rows.write.parquet(str(tmp_path / "out"))  # the one pass that produces the rows
    acc = accounting()
    kept = sum(1 for i in range(100) if i % 20 <= 14)
    assert acc == {"original": 100, "kept": kept, "dropped": 100 - kept, "ratio_pct": (100 - kept) * 1.0}


def test_chunk_text_matches_python(spark):
    texts = ["", "a", "abcdefghij" * 7 + "é😀z", "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = sorted((r["id"], r["chunk_idx"], r["chunk"]) for r in K.chunk_text(df, "t", 16, keep=["id"]).collect())
    want = sorted((i, j, t[s:s + 16]) for i, t in enumerate(texts) for j, s in enumerate(range(0, len(t), 16)))
    assert got == want
    got_d = K.chunk_text(df, "t", 16, drop_last=True, keep=["id"]).count()
    assert got_d == sum(1 for (_, _, c) in want if len(c) == 16)
