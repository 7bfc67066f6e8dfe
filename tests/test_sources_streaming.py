"""Sources, sinks and streaming (streaming result = batch result)."""

import os

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import functions as F

from tokenmill.functions import tokens as T
from tokenmill.functions import vocab as V
from tokenmill.operators import packing as K
from tokenmill.sources import arrow_shards as A
from tokenmill.sources import corpus as C
from tokenmill.sources import sinks as S
from tokenmill.streaming import jobs as J


def test_arrow_shards_file_and_stream(spark, tmp_path):
    d = tmp_path / "shards"
    d.mkdir()
    for i, fmt in enumerate(["file", "stream", "stream"]):
        b = pa.RecordBatch.from_pydict({"input": [f"C{i}", f"N{i}"], "n_tokens": pa.array([i, i + 1], pa.int64())})
        with pa.OSFile(str(d / f"data-{i:05d}-of-00003.arrow"), "wb") as f:
            w = ipc.new_file(f, b.schema) if fmt == "file" else ipc.new_stream(f, b.schema)
            w.write_batch(b)
            w.close()
    df = A.scan_arrow_shards(spark, str(d))
    assert df.rdd.getNumPartitions() == 3
    rows = df.orderBy("_shard", "_row").collect()
    assert [r["input"] for r in rows] == ["C0", "N0", "C1", "N1", "C2", "N2"]
    try:
        A.find_shards(str(tmp_path / "missing"))
        raise AssertionError("missing folder must fail")
    except FileNotFoundError:
        pass


def test_arrow_shard_of_many_batches(spark, tmp_path):
    """One shard is read by several tasks, in the chosen columns; an empty table and empty shards read as no rows."""
    d = str(tmp_path / "one")
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("wide"), (F.col("id") % 7).cast("int").alias("_k"))
    assert S.write_arrow_shards(df, d, shards=1, batch_rows=10) == 1
    assert os.listdir(d) == ["data-00000-of-00001.arrow"]
    back = A.scan_arrow_shards(spark, d, split_bytes=20_000)
    assert back.rdd.getNumPartitions() >= 5
    rows = back.collect()
    assert sorted(r["id"] for r in rows) == list(range(1000)) and {len(r["wide"]) for r in rows} == {100}
    assert sorted(r["_row"] for r in rows) == list(range(1000))  # numbers go on from task to task
    order, _ = A.open_batches(os.path.join(d, "data-00000-of-00001.arrow"))
    stored = [i for b in order for i in b.column("id").to_pylist()]
    assert [r["id"] for r in sorted(rows, key=lambda r: r["_row"])] == stored
    few = A.scan_arrow_shards(spark, d, ["_row", "_k"], split_bytes=20_000)
    assert few.columns == ["_row", "_k"] and few.agg(F.sum("_k")).first()[0] == sum(i % 7 for i in range(1000))
    assert A.scan_arrow_shards(spark, d, ["_shard"]).count() == 1000
    none = str(tmp_path / "none")
    S.write_arrow_shards(df.where("id < 0"), none, shards=2, stream_every=2)
    assert A.scan_arrow_shards(spark, none).count() == 0


def test_sample_log_scan_nan_and_bad_nfes(spark, tmp_path):
    p = tmp_path / "logs"
    p.mkdir()
    (p / "run_a.csv").write_text("12.5,3,1.5,10,x,1\n[nan],4,2.5,20,y,1\n14.5,5,3.5,30,z,1\n")
    (p / "run_b.csv").write_text("2.0,,1.0,5,x,2\n3.0,7,1.0,5,x,2\n")  # one bad NFE cell zeroes the file
    from tokenmill.operators.metrics import sample_log_summary
    out = {r["file_name"]: r for r in sample_log_summary(C.sample_log_scan(spark, str(p))).collect()}
    a = out["run_a.csv"]
    assert a["n_samples"] == 2 and a["mean_gen_ppl"] == 13.5 and a["mean_nfes"] == 4.0
    assert a["median_length"] == 20.0 and a["max_length"] == 30.0
    assert out["run_b.csv"]["mean_nfes"] == 0.0


def test_jsonl_and_cache(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"text": "ab"}\n\n{"text": "c d"}\n')
    df = C.scan_jsonl(spark, str(p))
    assert sorted(r["text"] for r in df.collect()) == ["ab", "c d"]
    calls = []

    def build():
        calls.append(1)
        return df.select(T.char_ids("text").alias("ids"))

    root = str(tmp_path / "cache")
    assert S.cache_key("x", block_size=64, insert_eos=True) != S.cache_key("x", block_size=64, insert_eos=False)
    S.sink_cache(spark, build, root, "x", block_size=64).count()
    S.sink_cache(spark, build, root, "x", block_size=64).count()
    assert len(calls) == 1


def test_stream_pack_equals_batch(spark, tmp_path, sf_small):
    docs = spark.read.parquet(os.path.join(sf_small, "documents.parquet"))
    path = str(tmp_path / "in")
    J.stage_as_files(docs, path, "doc_id", 3)
    sdf = J.read_stream(spark, path, docs.schema)
    toks = J.stream_tokenize(sdf, eos=V.CHAR_EOS).select("source", "doc_id", "ids")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    progress = J.run_to_parquet(J.stream_pack(toks, "source", "doc_id", "ids", 64, 2, 3), out, ck)
    assert len(progress) >= 3  # several micro-batches, state carried across them
    stream = {(r["source"], r["block_id"]): list(r["input_ids"]) for r in spark.read.parquet(out).collect()}
    batch = K.pack_chars(docs, "text", ["doc_id"], 64, 2, 3, group_cols=["source"])
    want = {(r["source"], r["block_id"]): list(r["input_ids"]) for r in batch.collect()}
    assert stream == want


def test_stream_stop_rules_match_python(spark, tmp_path):
    rows = []
    samples = {1: [5, 9, 2, 9, 9, 2] + [9] * 40, 2: [7] * 400, 3: list(range(30)) * 20}
    for sid, toks in samples.items():
        rows += [(sid, i, t, i * 10 + sid) for i, t in enumerate(toks)]
    df = spark.createDataFrame(rows, "sample_id long, step int, token int, _o long")
    path = str(tmp_path / "in")
    J.stage_as_files(df, path, "_o", 4)
    sdf = J.read_stream(spark, path, df.schema)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    J.run_to_parquet(J.stream_stop_rules(sdf, "sample_id", "step", "token", eos=2, check_every=16), out, ck)
    got = {r["sample_id"]: (r["stop_len"], r["reason"], r["out_len"]) for r in spark.read.parquet(out).collect()}

    def brute(toks):
        import collections
        import math
        for n in range(16, len(toks) + 1, 16):
            buf = toks[:n]
            eos = [i for i, x in enumerate(buf) if x == 2]
            if len(eos) >= 2:
                return (n, "eos", eos[1] + 1)
            if n > 256:
                c = collections.Counter(buf[-256:])
                h = -sum(v / 256 * math.log(v / 256) for v in c.values())
                if h < 4:
                    return (n, "entropy", n - 256)
        return None

    want = {sid: brute(t) for sid, t in samples.items() if brute(t) is not None}
    assert got == want
    assert got[1] == (16, "eos", 6) and got[2] == (272, "entropy", 16)


def test_stream_resume_exactly_once(spark, tmp_path):
    df = spark.range(0, 100).select(F.col("id").alias("event_id"), (F.col("id") * 2).alias("v"))
    path = str(tmp_path / "in")
    J.stage_as_files(df.where("event_id < 50"), path, "event_id", 2)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    J.run_to_parquet(J.read_stream(spark, path, df.schema), out, ck)
    J.stage_as_files(df.where("event_id >= 50"), path, "event_id", 2)
    J.run_to_parquet(J.read_stream(spark, path, df.schema), out, ck)
    got = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert got == list(range(100))


def test_scan_limited_takes_the_cap_partition_by_partition(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("x"))
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for cap in (0, 1, 10, 799, 800, 801, 10**6):
        out = C.scan_limited(t, "x", cap)
        rows = [r["id"] for r in out.collect()]
        assert out.columns == ["id", "x"] and len(rows) == len(set(rows)) == min(cap, 800) and all(i % 5 for i in rows)
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    seen = C.scan_progress(t, "x").collect()
    assert sum(r["n_rows"] for r in seen) == 1000 and sum(r["n_null"] for r in seen) == 200 and len(seen) == 7


def test_the_corpus_own_column_is_read(spark):
    df = spark.createDataFrame([("t", "a", "s", "x")], "text string, article string, abstract string, other string")
    spec = C.corpus_spec("scientific_papers_arxiv")
    out = C.drop_source_columns(C.adapt_text(df, spec, detokenize=False), spec)
    assert out.columns == ["text", "other", "corpus"] and out.first()["text"] == "a"
    both = spark.createDataFrame([("t", "i")], "text string, input string")
    assert C.text_column(both, "input") == "input" and C.text_column(both) == "text" and C.text_column(both, "sentence") == "input"


def test_stop_state_is_bounded(spark, tmp_path):
    """A sample of 20,000 tokens over ten micro-batches, one that stops early and goes on, and one with an EOS in each of two batches."""
    rows = [(1, i, i % 97) for i in range(20_000)] + [(2, i, 5 if i in (3, 7) else 200 + i % 90) for i in range(4000)]
    rows += [(3, i, 5 if i in (10, 900) else 100 + i % 90) for i in range(2000)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "sample_id long, step int, token int, _o long")
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    J.stage_as_files(df, path, "_o", 10)
    stops = J.stream_stop_rules(J.read_stream(spark, path, df.schema), "sample_id", "step", "token", eos=5, threshold=1.0)
    J.run_to_parquet(stops.where("sample_id <> 1 or reason <> 'eos'"), out, ck)
    got = {r["sample_id"]: (r["stop_len"], r["reason"], r["out_len"]) for r in spark.read.parquet(out).collect()}
    assert got == {2: (16, "eos", 8), 3: (912, "eos", 901)}
