"""The one-call entry points give the same rows as the operators they compose."""

import os

from pyspark.sql import functions as F

from tokenmill.functions import tokens as T
from tokenmill.operators import packing as K
from tokenmill.plans import q_forms
from tokenmill.plans.prepare import epoch_batches, prepare_corpus


def test_prepare_corpus_wrapped_and_cached(spark, sf_small, tmp_path):
    path = os.path.join(sf_small, "documents.parquet")
    got = prepare_corpus(spark, "openwebtext-train", path, block_size=64, order_cols=["doc_id"],
                         cache_root=str(tmp_path))
    docs = spark.read.parquet(path)
    want = K.pack_chars(docs, "text", ["doc_id"], 64, 2, 3)
    assert sorted(map(list, (r["input_ids"] for r in got.collect()))) == \
        sorted(map(list, (r["input_ids"] for r in want.collect())))
    assert any(p.startswith("openwebtext-train-") for p in os.listdir(tmp_path))


def test_prepare_corpus_flags(spark, sf_small):
    path = os.path.join(sf_small, "documents.parquet")
    docs = spark.read.parquet(path)
    raw = prepare_corpus(spark, "x", path, block_size=32, order_cols=["doc_id"], insert_special=False)
    want = K.pack_wrapped(docs, T.append_eos(T.char_ids("text"), 3), ["doc_id"], 32, 2, 3, insert_special=False)
    assert sorted(map(list, (r["input_ids"] for r in raw.collect()))) == \
        sorted(map(list, (r["input_ids"] for r in want.collect())))
    no_eos = prepare_corpus(spark, "x", path, block_size=32, order_cols=["doc_id"], insert_eos=False)
    assert all(3 not in list(r["input_ids"])[1:-1] for r in no_eos.collect())


def test_prepare_corpus_unwrapped_text(spark, sf_small):
    path = os.path.join(sf_small, "documents.parquet")
    out = prepare_corpus(spark, "wikitext2", path, wrap=False, block_size=32, order_cols=["doc_id"])
    r = out.orderBy("doc_id").first()
    assert len(r["input_ids"]) == 32 and r["input_ids"][0] == 0  # [CLS]
    assert sum(r["attention_mask"]) == min(len(r["input_ids"]), 32)


def test_epoch_batches_cover_epoch(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "doc")
    seen = []
    for rank in range(4):
        part = epoch_batches(df, "doc", 42, 0, 4, rank, 8)
        seen += [r["doc"] for r in part.collect()]
    assert sorted(set(seen)) == list(range(103)) and len(seen) == 104  # one padded repeat
    resumed = epoch_batches(df, "doc", 42, 0, 4, 1, 8, counter=16)
    assert resumed.agg(F.min("rank_pos")).first()[0] == 16


def test_text8_crop_prepares_the_whole_text(spark, tmp_path):
    texts = [f"{chr(97 + i % 26)}bc " * 2_500 for i in range(30)]  # 300,000 letters and spaces
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    raw = "".join(t.strip() + " " for t in texts)
    whole = "".join(raw[i:i + 256] + "$" for i in range(0, len(raw) // 256 * 256, 256))  # a chunk and its end
    rows = [list(map(int, r["input_ids"].split())) for r in q_forms.q_prepare_text8_crop(spark, str(tmp_path)).orderBy("block_id").collect()]
    ids = {" ": 34, "$": 3} | {chr(97 + i): 8 + i for i in range(26)}
    assert rows == [[2, *[ids[c] for c in whole[i:i + 126]], 3] for i in range(0, len(whole) // 126 * 126, 126)]
