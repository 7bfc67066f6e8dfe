"""Helpers shared by the operators of this subpackage.

Two ideas recur. *Chunks*: documents are dealt by a hash of their id and text
(ids may be null or repeat) over ``n`` chunks of about ``CHUNK_BYTES`` of text, so a task holds one chunk.
*Question and answer*: a chunk asks something about its keys (how often does
this n-gram occur in the corpus?). Keys go, packed as byte arrays, to the
*part* that their hash names; the part answers in the order asked, and the
answers come back to the chunk as mail. Nothing passes through the driver, and
what a task holds is bounded by the chunk or part size, not by the corpus.
"""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import checkpoint_dir, cut_lineage, table

CHUNK_BYTES = 24 << 20

__all__ = ["CHUNK_BYTES", "bodies", "chunked", "checkpoint_dir", "cut_lineage", "documents",
           "forget", "key_bytes", "key_array", "segments", "settled", "table", "worker_state", "word_slots"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return table(spark, sf_dir, "documents")


def bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """doc_id (long), body (the text's UTF-8 bytes; null text is empty) and the columns ``more``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), *more)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``bodies`` rows with a ``chunk`` number; (frame, number of chunks, bytes of text)."""
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.xxhash64("body"), F.lit(17)), F.lit(n)).cast("int")
    return docs.withColumn("chunk", chunk), n, total


def settled(df: DataFrame) -> DataFrame:
    """A table that a loop makes, written in the shared checkpoint folder and read back.

    Like a checkpoint it cuts lineage. Small files are read by few tasks, and the
    files' size tells Spark whether a join may broadcast the table."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``settled`` wrote, once no plan that still runs reads them."""
    for t in tables:
        folder = t.inputFiles()[0].rpartition("/")[0]
        assert folder.rpartition("/")[0].endswith("/tables"), folder
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def key_bytes(h: np.ndarray, width: int = 6) -> bytes:
    """The low ``width`` bytes of each 64-bit hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def key_array(data: bytes, width: int = 6) -> np.ndarray:
    """Inverse of ``key_bytes``."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive segments of these lengths, and each element's segment."""
    lengths = np.asarray(lengths, np.int64)
    return np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)


def worker_state(name: str, make, group: str | None = None):
    """A value kept in a Python worker for its later tasks, until one of another ``group`` (``name``, if not
    given) is asked for: a worker that goes from stage to stage holds the tables of one.

    The package's functions reach workers by value, so their own module
    globals would not outlive one task."""
    mod = sys.modules.setdefault("tokenmill_worker_state", types.ModuleType("tokenmill_worker_state"))
    group = group or name
    if getattr(mod, "_group", None) != group:
        mod._held, mod._group = {}, group
    if name not in mod._held:
        mod._held[name] = make()
    return mod._held[name]


class _Slots(dict):
    def __missing__(self, word):
        slot = self[word] = len(self)
        return slot


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Lower-cases A-Z and takes the words ``[^\\x20\\x09-\\x0D]+`` of each text:
    (slot of each word, words in each text, the distinct words by slot)."""
    slots = _Slots()
    get = slots.__getitem__
    each = [np.fromiter(map(get, t.lower().split()), np.int32) for t in texts]
    flat = np.concatenate(each) if each else np.zeros(0, np.int32)
    return flat, np.array([len(x) for x in each], np.int64), list(slots)


def arrow_bytes(items) -> pa.Array:
    return pa.array(items, pa.binary())
