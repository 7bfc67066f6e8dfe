"""Literal cases (FIXTURES section 2): values fixed by the reference semantics."""

import math

from pyspark.sql import functions as F

from tokenmill.functions import noise as N
from tokenmill.functions import text as X
from tokenmill.functions import tokens as T
from tokenmill.functions import vocab as V
from tokenmill.operators import packing as K
from tokenmill.operators import sampling as L
from tokenmill.operators import seqeval as E
from tokenmill.operators.ema import ema


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_red_green_packing(spark):
    # two molecules, block 16, no EOS between: ids from the vocabulary head
    df = spark.createDataFrame([(0, "CC(=O)O"), (1, "c1ccccc1")], "k long, s string")
    ids = df.select("k", T.smiles_ids("s").alias("ids")).orderBy("k").collect()
    assert ids[0]["ids"] == [20, 20, 21, 26, 23, 22, 23]
    assert ids[1]["ids"] == [19, 24, 19, 19, 19, 19, 19, 24]
    green = K.pack_wrapped(df, T.smiles_ids("s"), ["k"], 16, V.SMILES_BOS, V.SMILES_EOS).collect()
    assert len(green) == 1
    assert green[0]["input_ids"] == [1, 20, 20, 21, 26, 23, 22, 23, 19, 24, 19, 19, 19, 19, 19, 2]
    assert list(green[0]["attention_mask"]) == [1] * 16
    # the "red" case: CLS/SEP taken as ends
    red = K.pack_wrapped(df, T.smiles_ids("s"), ["k"], 16, V.SMILES_CLS, V.SMILES_SEP).collect()
    assert red[0]["input_ids"][0] == 16 and red[0]["input_ids"][-1] == 17


def test_smiles_tokens(spark):
    toks = one(spark, T.smiles_tokens(F.col("v")), "CC(=O)OC1=CC=CC=C1C(=O)O")
    assert " ".join(toks) == "C C ( = O ) O C 1 = C C = C C = C 1 C ( = O ) O"
    assert len(toks) == 24


def test_fragment_brackets_stay_whole(spark):
    toks = one(spark, T.smiles_tokens(F.col("v")), "[*+]NC[SEP][*+]CC[*-][SEP]")
    assert toks[:4] == ["[*+]", "N", "C", "[SEP]"]
    assert "[*-]" in toks


def test_unmatched_characters_dropped(spark):
    assert one(spark, T.smiles_tokens(F.col("v")), "Cl%12BrXX\\/") == ["Cl", "%12", "Br", "\\", "/"]


def test_vocabulary_head():
    assert V.SMILES_VOCAB["[UNK]"] == 13
    assert V.SMILES_VOCAB["[MASK]"] == 18
    assert V.SMILES_VOCAB["[PAD]"] == 0 and V.SMILES_VOCAB["[BOS]"] == 1 and V.SMILES_VOCAB["[EOS]"] == 2
    assert V.SMILES_VOCAB["c"] == 19 and V.SMILES_VOCAB["="] == 26


def test_scan_vocab_last_duplicate_wins(spark, tmp_path):
    from tokenmill.sources.corpus import scan_vocab
    p = tmp_path / "vocab.txt"
    p.write_text("\n".join(V.SMILES_VOCAB_HEAD) + "\n")
    v = {r["token"]: r["id"] for r in scan_vocab(spark, str(p)).collect()}
    assert v["[UNK]"] == 13 and v["[MASK]"] == 18 and v["\\"] == 64
    assert len(v) == len(V.SMILES_VOCAB_HEAD) - 2  # two repeated [UNK] lines


def test_char_vocab(spark):
    assert one(spark, T.char_ids(F.col("v")), "Ab z!") == [8, 9, 34, 33, 7]
    assert one(spark, T.char_ids(F.col("v")), "") == []
    assert one(spark, T.char_ids(F.col("v")), None) == []
    assert one(spark, T.char_count(F.col("v")), "Ab z!") == 5


def test_cleaning(spark):
    assert one(spark, X.clean_generated_text(F.col("v")), "[BOS] C C [EOS] N [PAD]") == "CC"
    assert one(spark, X.clean_generated_text(F.col("v")), None) == ""


def test_ema_warmup(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)], "k string, n int, x double")
    out = ema(df, "x", ["n"], ["k"], decay=0.9999).orderBy("n").collect()
    assert math.isclose(out[-1]["ema"], 2.6013986013986012, rel_tol=1e-12)
    # warm-up decays 2/11, 3/12, 4/13
    s = 0.0
    for n, x in [(1, 1.0), (2, 2.0), (3, 3.0)]:
        d = min(0.9999, (1 + n) / (10 + n))
        s = s - (1 - d) * (s - x)
    assert math.isclose(out[-1]["ema"], s, rel_tol=1e-12)


def test_windows_1025(spark):
    df = spark.createDataFrame([(1025,)], "L long")
    w = E.sliding_windows(df, "L", 1024, 512).orderBy("window_id").collect()
    assert len(w) == 2
    assert (w[0]["score_from"], w[0]["score_to"]) == (1, 1024)
    assert (w[1]["score_from"], w[1]["score_to"]) == (1024, 1025)


def test_clip_grid():
    g = N.clip_grid_values([0.9], 0.05)
    assert g[0] == (1e-3, 1.0)
    starts = [a for a, _ in g[1:]]
    assert [round(x, 9) for x in starts] == [1e-3, 0.05, 0.1]
    assert N.clip_grid_values([0.9], 0.05, block_size=1) == [(1e-3, 1.0), (1.0, 1.0)]


def test_eos_cut(spark):
    b, x, e, y, z = 1, 5, 2, 6, 7
    assert one(spark, E.eos_truncate(F.col("v"), e), [b, x, e, y, e, z], "v array<int>") == [b, x, e, y, e]
    assert one(spark, E.eos_truncate(F.col("v"), e), [b, e, x], "v array<int>") == [b, e, x]


def test_shards_pad_and_drop(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "doc long, pos long")
    padded = L.pad_to_even(df, "pos", 10, 4)
    rows = sorted((r["sample_pos"], r["doc"]) for r in padded.collect())
    assert [d for _, d in rows] == list(range(10)) + [0, 1]
    sh = L.round_robin_shard(padded, "sample_pos", 4)
    rank1 = sorted(r["doc"] for r in sh.where("rank = 1").collect())
    assert rank1 == [1, 5, 9]
    resumed = L.resume_from_counter(sh.where("rank = 1"), "rank_pos", 2).collect()
    assert [r["doc"] for r in resumed] == [9]
    dropped = L.round_robin_shard(L.pad_to_even(df, "pos", 10, 4, drop_last=True), "sample_pos", 4)
    assert sorted(r["doc"] for r in dropped.where("rank = 1").collect()) == [1, 5]


def test_detokenizers(spark):
    assert one(spark, X.detok_ptb(F.col("v")), "a N N b") == "a 1 1 b"
    assert one(spark, X.detok_lambada(F.col("v")), "“x” ") == '\n"x"'
    assert one(spark, X.detok_lm1b(F.col("v")), "Hello , world .") == "Hello, world."
    assert one(spark, X.detok_wikitext(F.col("v")), "1 @,@ 000 ( a )") == "1,000 (a)"
    assert one(spark, X.detok_lm1b(F.col("v")), "abc été .") == "abc été."
    assert one(spark, X.detok_lm1b(F.col("v")), "x foo .\n") == "x foo.\n"


def test_fixture_numbers_sf001(spark):
    """Figures stated for the derived fixtures at sf0.01."""
    import os
    import pytest
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("sf0.01 tables not present")
    from tokenmill.operators.metrics import loss_metrics
    from tokenmill.plans.fixtures import losses, molecules
    m = molecules(spark, sf)
    assert m.count() == 2000
    assert m.select("smiles").distinct().count() == 48
    assert m.where("qed >= 0.6 and sa <= 4").count() == 916
    got = {r["phase"]: r for r in loss_metrics(losses(spark, sf), ["phase"]).collect()}
    assert round(got["train"]["nll"], 9) == 0.538731827 and round(got["val"]["nll"], 9) == 0.535614167
    assert round(got["train"]["ppl"], 9) == 1.713832047 and round(got["val"]["ppl"], 9) == 1.708497223


def test_detok_rules_match_python_semantics(spark):
    """Every rule table gives in Spark what Python's str.replace / re.sub give."""
    import re as pyre

    def py_apply(s, rules):
        for kind, a, b in rules:
            s = s.replace(a, b) if kind == "lit" else pyre.sub(a, b, s)
        return s

    samples = [
        "a ( b c ) [ d ] { e } \" f \" ' g ' = = = = h = = = i = = j @-@ k @,@ l @.@ m N o 's p",
        "Hello , world . foo ? bar ! baz : qux ; end .\n",
        "x 'tis y . z \n w s ' v ° u /' 3/",
        "été ( ça ) , déjà vu .",
        "http : / / x.com / y https : / / z \" quoted words \" ( par ) [ br ]",
        "$ 5 £ 3 <unk> \\/ don n't a N N N b # 1 $ 1 s ' x",
        "tail ?", "tail !", "word .",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    for fn, rules in [(X.detok_wikitext, X.WIKITEXT_RULES), (X.detok_ptb, X.PTB_RULES), (X.detok_lm1b, X.LM1B_RULES)]:
        got = [r["r"] for r in df.select(fn(F.col("v")).alias("r")).collect()]
        assert got == [py_apply(s, rules) for s in samples], fn.__name__
