"""Structured Streaming forms of the corpus and metric jobs (ST1-ST8).

The reference streams by lazy iteration; here the same operators run over a
file stream. Stateless operators (tokenise, filter, fixed rows) are the
batch column expressions unchanged. Stateful ones keep small bounded state
per key with ``applyInPandasWithState``:

* packing carries, per stream key, the tokens left over after the last full
  block (fewer than one block) and the next block number; ``stream_pack`` keeps
  them as state (a key's rows of a micro-batch are one task), while
  ``stream_pack_ranges`` packs each micro-batch by ranges, so a hot key is many tasks;
* the stop rules carry, per sample, the tokens received so far (a sample is
  bounded by the generation length) until the sample stops;
* metric and best-so-far monitors are plain streaming aggregations (their
  state is one buffer per group).

Every query writes through a checkpoint location in the shared checkpoint
folder, so a restart resumes after the last committed micro-batch.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import tokens as T
from ..operators import metrics as M
from ..operators.packing import _wrapped
from ..operators.rangepack import pack_on
from ..session import remove_folder, scratch_path


# ---------------------------------------------------------------- helpers --
def stage_as_files(df: DataFrame, path: str, order_cols: str | Sequence[str], n_files: int) -> str:
    """Write ``df`` as ``n_files`` parquet files, each a contiguous range of ``order_cols`` (ranges without rows have no
    file). All are written at once, a task each; then their times are set to follow the order, as a file stream takes
    files by time: however many files a micro-batch takes, none is out of order."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def staged() -> set:
        found = fs.listStatus(folder) if fs.exists(folder) else []
        return {f.getPath().getName() for f in found if f.getPath().getName().startswith("part-")}

    before = staged()
    order = [order_cols] if isinstance(order_cols, str) else order_cols
    df.repartitionByRange(n_files, *order).write.mode("append").parquet(path)
    names = sorted(staged() - before)  # part-00000-..., by range
    begin = int(time.time() - len(names)) * 1000
    for k, name in enumerate(names):
        file, at = spark._jvm.org.apache.hadoop.fs.Path(folder, name), begin + 1000 * k
        fs.setTimes(file, at, -1)
        if fs.getFileStatus(file).getModificationTime() != at:
            raise OSError(f"{path} is on storage that does not keep file times, so the order of a stream's files is lost")
    return path


class _ProgressLog(StreamingQueryListener):
    """Keeps the progress records of all runs, by run."""

    def __init__(self):
        self.records: list = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.records.append(event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def of(self, run_id) -> list:
        return [p for p in self.records if str(p.runId) == str(run_id)]


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def run_to_parquet(sdf: DataFrame, out: str, checkpoint: str, mode: str = "append",
                   max_batches: int | None = None) -> list:
    """Run a streaming query until the input is drained (availableNow), write
    parquet; returns every progress record of the run (the query object
    itself only remembers the last hundred)."""
    spark = sdf.sparkSession
    log = _ProgressLog()
    spark.streams.addListener(log)
    if mode == "append":
        q = (sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    else:
        def write_batch(bdf, epoch_id):
            bdf.write.mode("overwrite").parquet(out)
        q = (sdf.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    try:
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    return log.of(q.runId)


# -------------------------------------------------------------------- ST1 --
def stream_tokenize(sdf: DataFrame, text_col: str = "text", eos: int | None = None) -> DataFrame:
    ids = T.char_ids(text_col)
    if eos is not None:
        ids = T.append_eos(ids, eos)
    return sdf.withColumn("ids", ids)


# -------------------------------------------------------------------- ST2 --
#: Ids that ``stream_pack`` cuts into blocks at a time.
PIECE_IDS = 1 << 20


def stream_pack(sdf: DataFrame, key_col: str, order_col: str, ids_col: str, block_size: int,
                bos: int, eos: int, insert_special: bool = True) -> DataFrame:
    """K1 over a stream: per key, the remainder of the previous micro-batches
    is prepended, full blocks are emitted, the new remainder is kept in state.
    Within a micro-batch rows are taken in ``order_col`` order.

    A task holds the ids of a key's rows of one micro-batch, four bytes each, and blocks leave ``PIECE_IDS`` ids at a
    time; so the size of the micro-batches bounds its memory, not that of the stream."""
    chunk = block_size - 2 if insert_special else block_size

    def blocks(key, toks, first):
        n = len(toks) // chunk
        body = toks[:n * chunk].reshape(n, chunk)
        if insert_special:
            body = np.hstack([np.full((n, 1), bos, np.int32), body, np.full((n, 1), eos, np.int32)])
        return pd.DataFrame({key_col: [key[0]] * n, "block_id": np.arange(first, first + n, dtype=np.int64), "input_ids": list(body)})

    def pack(key, pdfs: Iterator[pd.DataFrame], state):
        rest, next_block = state.get if state.exists else ([], 0)
        held = [np.asarray(rest, np.int32)]
        n_held = len(rest)
        frames = [p for p in pdfs if not p.empty]
        rows = [np.asarray(x, np.int32) for p in frames for x in p[ids_col]]
        order = pd.concat([p[order_col] for p in frames], ignore_index=True).sort_values(kind="stable").index if frames else []
        del frames
        for k in order:
            held.append(rows[k])
            n_held += len(rows[k])
            if n_held >= PIECE_IDS:
                toks = np.concatenate(held)
                yield blocks(key, toks, next_block)
                next_block += n_held // chunk
                held = [toks[n_held // chunk * chunk:]]
                n_held = len(held[0])
        toks = np.concatenate(held)
        if n_held >= chunk:
            yield blocks(key, toks, next_block)
        state.update((toks[n_held // chunk * chunk:].tolist(), int(next_block) + n_held // chunk))

    key_type = dict(sdf.dtypes)[key_col]
    return sdf.groupBy(key_col).applyInPandasWithState(
        pack, f"{key_col} {key_type}, block_id long, input_ids array<int>",
        "rest array<bigint>, next_block long", "append", GroupStateTimeout.NoTimeout)


def stream_pack_ranges(sdf: DataFrame, key_col: str, order_col: str, ids_col: str, block_size: int, bos: int, eos: int,
                       out: str, checkpoint: str, insert_special: bool = True) -> list:
    """The rows of ``stream_pack``, with a key's rows of a micro-batch spread over as many tasks as they fill.

    Each micro-batch is packed by the batch operator (one range exchange by key, order and hash of the ids), with what
    the micro-batch before left over of each key as that key's first row. Block rows go to ``out/epoch=N``, left-overs
    (one row a key: the next block's number and fewer tokens than a block) to ``checkpoint-rest/epoch=N``. Both are
    written anew when a micro-batch is run again, from the same input and the left-overs of N - 1, so a restart
    repeats no row and loses none. Left-overs before N - 1 are removed. Runs until the input is drained; returns the
    progress records. Null keys are a key, null ids are empty; of equal order keys the hash of the ids decides.

    Left-overs are rewritten in every micro-batch: its cost includes one small row a key seen so far."""
    chunk = block_size - 2 if insert_special else block_size
    rest = checkpoint.rstrip("/") + "-rest"
    spark = sdf.sparkSession
    schema = f"`{key_col}` {dict(sdf.dtypes)[key_col]}, block_id long, _body array<int>"

    def pack(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.col(key_col), F.lit(True).alias("_new"), F.col(order_col).alias("_order"),
                            F.lit(0).cast("long").alias("_begin"), F.col(ids_col).cast("array<int>").alias("_t"))
        if epoch:
            before = batch.sparkSession.read.schema(schema).parquet(f"{rest}/epoch={epoch - 1}")
            order_type = rows.schema["_order"].dataType
            rows = rows.unionByName(before.select(
                key_col, F.lit(False).alias("_new"), F.lit(None).cast(order_type).alias("_order"),
                (F.col("block_id") * chunk).alias("_begin"), F.col("_body").alias("_t")))
        blocks, left = pack_on(rows, [key_col], ["_new", "_order"], chunk, text=False)
        blocks = _wrapped(blocks, F.col("_body"), [key_col], block_size, bos, eos, insert_special)
        blocks.drop("attention_mask").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        left.write.mode("overwrite").parquet(f"{rest}/epoch={epoch}")
        if epoch > 1:
            remove_folder(batch.sparkSession, f"{rest}/epoch={epoch - 2}")

    log = _ProgressLog()
    spark.streams.addListener(log)
    q = (sdf.writeStream.foreachBatch(pack).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    try:
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    return log.of(q.runId)


# -------------------------------------------------------------------- ST3 --
def stream_filter_fixed(sdf: DataFrame, ids, block_size: int, bos: int, eos: int, pad: int) -> DataFrame:
    from ..operators.packing import build_fixed_rows
    return build_fixed_rows(sdf, ids, block_size, bos, eos, pad)


# -------------------------------------------------------------------- ST4 --
def stream_metrics(sdf: DataFrame, group_cols: Sequence[str], value="nll", weight="mask") -> DataFrame:
    """Running NLL / BPD / PPL per group from mergeable (sum(v*w), sum(w)) buffers."""
    return M.loss_metrics(sdf, group_cols, value, weight)


# -------------------------------------------------------------------- ST5 --
class ThroughputListener:
    """Live progress of streaming queries: rows and rate per micro-batch, and
    a line every ``every_rows`` rows (the reference prints every 100k rows).
    Register with ``spark.streams.addListener(ThroughputListener(...).listener)``."""

    def __init__(self, every_rows: int = 100_000, log=print):
        from pyspark.sql.streaming import StreamingQueryListener

        outer = self
        self.batches: list[tuple] = []
        self.total = 0
        self._next = every_rows
        self.every_rows = every_rows

        class _L(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                p = event.progress
                outer.batches.append((int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond or 0.0)))
                outer.total += int(p.numInputRows)
                while outer.total >= outer._next:
                    log(f"{outer.total} rows, {p.processedRowsPerSecond or 0.0:.0f} rows/s")
                    outer._next += outer.every_rows

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        self.listener = _L()


def throughput(progress: list) -> list[tuple]:
    """(batch id, input rows, rows per second) from streaming progress records."""
    out = []
    for p in progress:
        out.append((int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond or 0.0)))
    return out


# -------------------------------------------------------------------- ST7 --
def stream_stop_rules(sdf: DataFrame, sample_col: str, step_col: str, token_col: str, eos: int,
                      check_every: int = 16, tail: int = 256, threshold: float = 4.0,
                      min_len: int = 256, idle_ms: int | None = None) -> DataFrame:
    """Per growing sample, stop at the first check point (every ``check_every``
    tokens) where the sample has two EOS tokens (cut after the second), or,
    past ``min_len`` tokens, the entropy of its last ``tail`` tokens is below
    ``threshold`` (drop the last ``tail`` tokens). Emits one row per stopped
    sample: (sample, stop_len, reason, out_len).

    The state of a sample is two counters, the place after its second EOS and its last ``tail`` tokens, however
    long it grows; once stopped, the flag alone. In a stream that runs on, ``idle_ms`` forgets samples that got no
    token for so long (processing time; a stream that ends with its input would wait for the timers)."""

    def entropy(x):
        x = np.sort(x)
        c = np.diff(np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]))
        p = c / len(x)
        return float(-(p * np.log(p)).sum())

    def step(key, pdfs: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        n, n_eos, cut, last, done = state.get if state.exists else (0, 0, 0, [], False)
        frames = [p for p in pdfs if not p.empty]
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if done or not frames:
            return
        # a sample's rows are few: plain arrays cost a tenth of what a frame's concat and sort do
        steps = np.concatenate([p[step_col].to_numpy() for p in frames])
        fresh = np.concatenate([p[token_col].to_numpy(dtype=np.int64) for p in frames])[np.argsort(steps, kind="stable")]
        seen = np.r_[np.asarray(last, np.int64), fresh]  # the last tokens and the new ones
        before, stop = n, None
        places = n + 1 + np.flatnonzero(fresh == eos)  # lengths at which an EOS has just come
        for at in range(n - n % check_every + check_every, n + len(fresh) + 1, check_every):
            both = n_eos + np.searchsorted(places, at, side="right")
            if both >= 2:
                stop = (key[0], at, "eos", int(cut if n_eos >= 2 else places[1 - n_eos]))
            elif at > min_len:
                end = len(last) + at - before
                if entropy(seen[max(0, end - tail):end]) < threshold:
                    stop = (key[0], at, "entropy", at - tail)
            if stop:
                break
        if stop:
            state.update((0, 0, 0, [], True))
            yield pd.DataFrame([stop], columns=[sample_col, "stop_len", "reason", "out_len"])
        else:
            if n_eos < 2 <= n_eos + len(places):
                cut = int(places[1 - n_eos])
            state.update((n + len(fresh), n_eos + len(places), cut, seen[-tail:].tolist(), False))

    key_type = dict(sdf.dtypes)[sample_col]
    return sdf.groupBy(sample_col).applyInPandasWithState(
        step, f"{sample_col} {key_type}, stop_len long, reason string, out_len long",
        "n bigint, n_eos bigint, cut bigint, last array<bigint>, done boolean", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


# -------------------------------------------------------------------- ST8 --
def stream_best_monitor(sdf: DataFrame, run_col: str, value_col: str) -> DataFrame:
    """Best (lowest) validation value per run so far, and how many values arrived."""
    return sdf.groupBy(run_col).agg(F.min(value_col).alias("best"), F.count(F.lit(1)).alias("n_seen"))


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new output folder and checkpoint folder under the shared checkpoint folder."""
    base = scratch_path(spark, name)
    return os.path.join(base, "out"), os.path.join(base, "_checkpoint")
