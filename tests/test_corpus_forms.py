"""Corpus forms against plain Python: byte ranges with whole characters, parts of one text, hold-outs with ties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenmill.plans.prepare import prepare_corpus, valid_batches
from tokenmill.sources import corpus as C


def _parts(folder, data: bytes, cuts):
    folder.mkdir()
    edges = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        (folder / f"part-{i:03d}.txt").write_bytes(data[a:b])
    (folder / "_SUCCESS").write_bytes(b"not text")
    return str(folder)


@settings(max_examples=6, deadline=None)
@given(text=st.text(alphabet="ab é漢😀", max_size=200), chunk=st.integers(4, 40), cuts=st.lists(st.integers(0, 300), max_size=3),
       start=st.integers(0, 20))
def test_chunks_hold_whole_characters(spark, tmp_path_factory, text, chunk, cuts, start):
    data = text.encode()
    path = _parts(tmp_path_factory.mktemp("t") / "parts", data, cuts)
    rows = sorted(tuple(r) for r in C.read_byte_chunks(spark, path, start, None, chunk).collect())
    first = start
    while first and first < len(data) and data[first] & 0xC0 == 0x80:
        first += 1
    assert "".join(t for _, t in rows) == data[first:].decode()
    assert [i for i, _ in rows] == list(range(-(-max(len(data) - start, 0) // chunk)))
    assert all(len(t.encode()) <= chunk + 3 for _, t in rows)


def test_bytes_that_are_no_text_and_empty_files(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"ab\xff\xfecd" + b"\x80" * 9)
    got = "".join(r["text"] for r in C.read_byte_chunks(spark, str(tmp_path / "bad"), 0, None, 4).orderBy("chunk_idx").collect())
    assert got.startswith("ab\ufffd\ufffdcd") and set(got[6:]) == {"\ufffd"} and len(got) == 15
    (tmp_path / "empty").write_bytes(b"")
    assert C.read_byte_chunks(spark, str(tmp_path / "empty"), 0, None, 4).count() == 0
    assert C.read_byte_chunks(spark, str(tmp_path / "bad"), 100, None, 4).count() == 0


def test_text8_splits_and_short_chunks(spark, tmp_path):
    (tmp_path / "raw").write_text("abcdefghij" * 10)
    splits = (("train", 0, 50), ("validation", 50, 75), ("test", 75, None))

    def texts(mode, **kw):
        df = C.scan_text8(spark, str(tmp_path / "raw"), mode, 20, splits=splits, **kw)
        return [r["text"] for r in df.orderBy("id").collect()]

    assert texts("train") == ["abcdefghij" * 2] * 2  # the last ten letters are no whole chunk
    assert texts("train", drop_last=False)[-1] == "abcdefghij"
    assert texts("validation") == ["abcdefghij" * 2] and texts("test") == ["fghijabcdefghijabcde"]
    with pytest.raises(ValueError):
        texts("dev")
    rows = prepare_corpus(spark, "text8", str(tmp_path / "raw"), mode="train", block_size=20, splits=splits).collect()
    assert len(rows) == 2 and all(len(r["input_ids"]) == 20 for r in rows)  # 42 tokens in bodies of 18


@pytest.mark.parametrize("holdout", [0, 1, 3, 6, 9, 12, 50])
def test_tail_holdout_with_ties_nulls_and_equal_rows(spark, holdout):
    rows = [(None, "n1"), (None, "n2"), (1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, None), (2, "x"), (3, "y"), (3, "y"), (9, "")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    train, hold = C.tail_holdout(df, ["k"], holdout)
    a, b = [tuple(r) for r in train.collect()], [tuple(r) for r in hold.collect()]
    assert len(b) == min(holdout, len(rows))

    def key(r):
        return (r[0] is not None, r[0] or 0, str(r[1]))

    assert sorted(a + b, key=key) == sorted(rows, key=key)
    assert not a or not b or max(key(r)[:2] for r in a) <= min(key(r)[:2] for r in b)
    empty = C.tail_holdout(df.where("k > 99"), ["k"], holdout)
    assert [d.count() for d in empty] == [0, 0]


def test_forms_by_mode(spark, tmp_path):
    df = spark.range(30).select("id", F.concat(F.lit("t"), "id").alias("text"))
    df.write.parquet(str(tmp_path / "web"))
    ids = {n: {r["id"] for r in C.scan_corpus(spark, n, str(tmp_path / "web"), mode="train", holdout=7).collect()}
           for n in ("openwebtext-train", "openwebtext-valid")}
    assert ids == {"openwebtext-train": set(range(23)), "openwebtext-valid": set(range(23, 30))}
    df.withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train")).write.partitionBy("split").parquet(str(tmp_path / "s"))
    picked = C.scan_corpus(spark, "ag_news", str(tmp_path / "s"), mode=C.validation_split_name("ag_news"))
    assert {r["id"] for r in picked.collect()} == set(range(0, 30, 3))
    assert "PartitionFilters: [isnotnull(split" in picked._jdf.queryExecution().toString()
    assert C.scan_corpus(spark, "ag_news", str(tmp_path / "web"), mode="test").count() == 30  # no such column: one split


def test_valid_batches(spark):
    df = spark.range(21).withColumnRenamed("id", "doc")
    plain = [tuple(r) for r in valid_batches(df, "doc", 8).orderBy("epoch_pos").collect()]
    assert plain == [(i, i, i // 8) for i in range(21)]
    orders = [[r["doc"] for r in valid_batches(df, "doc", 8, s).orderBy("epoch_pos").collect()] for s in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == list(range(21))


def test_vocabulary_file_with_its_own_special_ids(spark, tmp_path):
    lines = ["C", "[BOS]", *[f"[X{i}]" for i in range(90)], "[PAD]", "%12", "[UNK]", "[EOS]", "[CLS]", "[SEP]", "[UNK]", "c"]
    (tmp_path / "vocab.txt").write_text("\n".join(lines) + "\n")
    spark.createDataFrame([(1, "C[X77]c%12"), (2, "NC"), (3, None)], "id long, input string").write.parquet(str(tmp_path / "mols"))
    out = prepare_corpus(spark, "smiles", str(tmp_path / "mols"), wrap=False, block_size=7, tokenizer="smiles",
                         vocab_path=str(tmp_path / "vocab.txt"))
    at = {t: i for i, t in enumerate(lines)}
    b, e, p, u = at["[BOS]"], at["[EOS]"], at["[PAD]"], at["[UNK]"]
    got = {r["id"]: (list(r["input_ids"]), sum(r["attention_mask"])) for r in out.collect()}
    assert got == {1: ([b, 0, at["[X77]"], at["c"], at["%12"], e, p], 6), 2: ([b, u, 0, e, p, p, p], 4), 3: ([b, e, *[p] * 5], 2)}
    (tmp_path / "none.txt").write_text("C\n")
    with pytest.raises(ValueError):
        prepare_corpus(spark, "smiles", str(tmp_path / "mols"), tokenizer="smiles", vocab_path=str(tmp_path / "none.txt"))
