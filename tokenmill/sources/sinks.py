"""Sinks (S10-S14): parameter-keyed cache, sample-log CSV, text outputs,
Arrow shard writer and previews."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview_list


# ------------------------------------------------------------------ S10 --
def cache_key(corpus: str, **parameters) -> str:
    """Folder name: the corpus and a digest of every parameter that changes the rows."""
    import hashlib
    text = json.dumps({"corpus": corpus, **parameters}, sort_keys=True, default=repr)
    return f"{corpus}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def sink_cache(spark: SparkSession, build, root: str, corpus: str, streaming: bool = False, **parameters) -> DataFrame:
    """Materialise ``build()`` under ``root/cache_key(...)`` (parquet + manifest)
    unless it is already there; a folder whose manifest names other parameters
    is an error, and a streaming corpus is never cached."""
    if streaming:
        return build()
    key = cache_key(corpus, **parameters)
    said = json.dumps({"corpus": corpus, **parameters}, sort_keys=True, default=repr)
    path = os.path.join(root, key)
    manifest = os.path.join(path, "_manifest.json")
    if not _exists(spark, manifest):
        df = build()
        df.write.mode("overwrite").parquet(os.path.join(path, "data"))
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    elif spark.read.text(manifest).first()[0] != said:
        raise ValueError(f"the cache in {path} was made with other parameters")
    return spark.read.parquet(os.path.join(path, "data"))


# ------------------------------------------------------------------ S11 --
SAMPLE_LOG_COLUMNS = ["gen_ppl", "nfes", "entropy", "gen_lengths", "samples", "seed"]


def rows_from_lists(df: DataFrame, list_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Parallel lists -> rows, by position; the length of the first list rules."""
    first = list_cols[0]
    zipped = F.transform(F.col(first), lambda _x, i: F.struct(*[F.get(F.col(c), i).alias(c) for c in list_cols]))
    return df.select(*keep, F.inline(zipped))


def sink_sample_csv(df: DataFrame, path: str, partition_cols: Sequence[str] = ()) -> None:
    """Append sample-log rows as header-less CSV (the reader names the columns)."""
    w = df.select(*partition_cols, *[F.col(c).cast("string").alias(c) for c in SAMPLE_LOG_COLUMNS]).write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.option("header", "false").csv(path)


# ------------------------------------------------------------------ S12 --
def sink_text(samples: DataFrame, metrics: dict, folder: str, text_col: str = "text") -> None:
    """Samples one per line, and ``key: value`` metric lines."""
    samples.select(F.col(text_col).alias("value")).write.mode("overwrite").text(os.path.join(folder, "samples"))
    spark = samples.sparkSession
    lines = [f"{k}: {v}" for k, v in metrics.items()]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(folder, "metrics"))


# ---------------------------------------------------------------- S1 sink --
def write_arrow_shards(df: DataFrame, path: str, stream_every: int = 0, shards: int | None = None,
                       batch_rows: int | None = None) -> int:
    """Write ``df`` as ``shards`` Arrow IPC shards ``data-NNNNN-of-MMMMM.arrow`` (by default as many as
    ``spark.sql.shuffle.partitions``; rows dealt round-robin, a shard without rows is an empty file). IPC file format;
    with ``stream_every = k`` every k-th shard uses the IPC stream format. ``batch_rows`` bounds a record batch.

    Each attempt of a task writes a file of its own, which takes the shard's name once it is whole, so retried and
    speculative attempts are safe. Returns the shard count."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from . import fs
    n = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = to_arrow_schema(df.schema)
    fs.makedirs(path)

    def write(it):
        import pyarrow as pa
        import pyarrow.ipc as ipc
        from pyspark import TaskContext
        task = TaskContext.get()
        pid = task.partitionId()
        shard = path.rstrip("/") + f"/data-{pid:05d}-of-{n:05d}.arrow"
        attempt = path.rstrip("/") + f"/_{pid:05d}-{task.taskAttemptId()}"
        use_stream = stream_every and pid % stream_every == stream_every - 1
        rows = 0
        with fs.open_output(attempt) as sink, (ipc.new_stream if use_stream else ipc.new_file)(sink, schema) as w:
            for b in it:  # batches are written as they arrive, never held together
                w.write_table(pa.Table.from_batches([b]).cast(schema), max_chunksize=batch_rows)
                rows += b.num_rows
        fs.move(attempt, shard)
        yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([rows], pa.int64())], ["shard", "rows"])

    df.repartition(n).mapInArrow(write, "shard int, rows long").count()
    return n


# ---------------------------------------------------------------- S13, S14 --
def preview(df: DataFrame, order_cols: Sequence[str], n: int = 5, max_list: int = 32) -> DataFrame:
    """First ``n`` rows in order, list columns shown as their head and length."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(preview_list(f.name, max_list).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.orderBy(*order_cols).limit(n).select(*cols)


def schema_lines(df: DataFrame) -> list[str]:
    """``index: name: type`` per column."""
    return [f"{i}: {f.name}: {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields)]


def head_tail_tokens(ids, k: int = 64):
    """First and last ``k`` tokens of an id array (a short array gives what it has)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(a, 1, k), F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)
