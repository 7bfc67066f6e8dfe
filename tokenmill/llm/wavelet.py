"""Token-id files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents (ascending id). Its file row
is a wavelet matrix: for every bit of the ids, most significant first, one
bit-plane, in which the ids are stably parted by the bits before. Each plane
carries a rank directory (ones before every 512-bit block). Planes are
zstd-compressed one by one, so a query opens only what it needs:

* ``access(i)``: the id at position i,
* ``rank(c, i)``: how often c occurs before i, ``count(c)``,
* ``select(c, k)``: where the k-th c stands.

The files are written and read by Spark (a Parquet row is the container), so
a lost executor's shards are written again and only whole ones are committed.

Edge cases: null text is empty (the end id alone); an empty table gives no
shard and no rows; repeated ids are documents of their own; rows with a null
id come first; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.session import scratch_path

from .common import bodies
from .tokens import encode_texts, groups_of_bytes, with_end

#: Ids after which a shard is closed.
SHARD_TOKENS = 1 << 20
BLOCK = 512
SHARD = ("part int, number int, n_tokens long, n_docs int, width int, zeros array<int>, doc_ids binary, "
         "doc_tokens binary, planes array<binary>, ranks array<binary>")


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


class WaveletMatrix:
    """Succinct sequence of unsigned ids below 2 ** width."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.width, self.zeros, self._planes, self._ranks = n, width, zeros, planes, ranks
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        blocks = -(-len(x) // BLOCK)
        for level in range(width - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            raw = np.packbits(bit, bitorder="little")
            wide = np.zeros(blocks * BLOCK // 8, np.uint8)
            wide[:len(raw)] = raw
            ones = np.bitwise_count(wide.view(np.uint64)).reshape(blocks, BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(_zip(wide.tobytes()))
            ranks.append(_zip((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()))
            low = x.take(np.flatnonzero(~bit))  # positions: faster than a mask where the bits are mixed
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(bit))])
        return cls(len(ids), width, zeros, planes, ranks)

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._open:
            blocks = -(-self.n // BLOCK)
            self._open[k] = (np.frombuffer(_unzip(self._planes[k], blocks * BLOCK // 8), np.uint8),
                             np.frombuffer(_unzip(self._ranks[k], blocks * 4), "<u4"))
        return self._open[k]

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        bits, ranks = self._plane(k)
        if i >= self.n:
            return self.n - self.zeros[k]
        b = i // BLOCK
        some = np.unpackbits(bits[b * BLOCK // 8: -(-i // 8)], bitorder="little")[: i - b * BLOCK]
        return int(ranks[b]) + int(some.sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.width):
            bits, _ = self._plane(k)
            bit, ones = int(bits[i >> 3] >> (i & 7)) & 1, self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _span(self, c: int, i: int) -> tuple[int, int]:
        """Where the occurrences of c before position i stand below the last plane."""
        lo, hi = 0, min(i, self.n)
        for k in range(self.width):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if c >> (self.width - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, c: int, i: int) -> int:
        lo, hi = self._span(c, i)
        return hi - lo

    def count(self, c: int) -> int:
        return self.rank(c, self.n)

    def select(self, c: int, k: int) -> int:
        """Position of the k-th c (from 0); -1 if there are fewer."""
        lo, hi = self._span(c, self.n)
        if k >= hi - lo:
            return -1
        at = lo + k
        for level in range(self.width - 1, -1, -1):
            at = self._find(level, at - self.zeros[level], 1) if c >> (self.width - 1 - level) & 1 else self._find(level, at, 0)
        return at

    def _find(self, k: int, nth: int, bit: int) -> int:
        """Position of the nth (from 0) such bit in plane k."""
        bits, ranks = self._plane(k)
        before = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * BLOCK - ranks
        b = int(np.searchsorted(before, nth, side="right")) - 1
        some = np.unpackbits(bits[b * BLOCK // 8:(b + 1) * BLOCK // 8], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(some == bit)[nth - int(before[b])])

    def all(self) -> np.ndarray:
        """Every id: the planes are merged from the last one upward."""
        x = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self._plane(k)[0], bitorder="little")[: self.n].view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[: self.zeros[k]]
            y[np.flatnonzero(bit)] = x[self.zeros[k]:] | x.dtype.type(1 << (self.width - 1 - k))
            x = y
        return x


def _shard_row(part: int, number: int, doc_ids: list, n: np.ndarray, ids: np.ndarray, width: int) -> dict:
    m = WaveletMatrix.build(ids, width)
    none = [d is None for d in doc_ids]
    known = [0 if d is None else d for d in doc_ids]
    return {"part": part, "number": number, "n_tokens": len(ids), "n_docs": len(n), "width": width,
            "zeros": m.zeros, "doc_ids": _zip(np.array([known, none], "<i8").tobytes()),
            "doc_tokens": _zip(n.astype("<i8").tobytes()), "planes": m._planes, "ranks": m._ranks}


_ARROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int32()), ("width", pa.int32()),
                    ("zeros", pa.list_(pa.int32())), ("doc_ids", pa.binary()), ("doc_tokens", pa.binary()),
                    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write(docs: DataFrame, path: str, tokenizer: str, width: int, end_id: int = 1, shard_tokens: int = SHARD_TOKENS,
          id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts and writes their ids, in ascending id order, as wavelet-matrix shards.

    Rows that share an id, or have none, are in the order of their texts' hashes, and may fill several ranges. A
    shard is known by its range and its number in it, whatever its ids are."""

    def build(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        held, n_held = [], 0  # (doc_id, ids) until a shard is full

        def close():
            row = _shard_row(part, number, [d for d, _ in held], np.array([len(x) for _, x in held]),
                             np.concatenate([x for _, x in held]), width)
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            doc, texts = b.column("doc_id").to_pylist(), b.column("body").to_pylist()
            for lo, hi in groups_of_bytes([len(t) for t in texts], 8 << 20):
                flat, n = with_end(*encode_texts(tokenizer, texts[lo:hi]), end_id)
                flat = flat.astype(np.uint16 if width <= 16 else np.uint32)
                for d, x in zip(doc[lo:hi], np.split(flat, np.cumsum(n)[:-1])):
                    held.append((d, x))
                    n_held += len(x)
                    if n_held >= shard_tokens:
                        yield close()
                        held, n_held, number = [], 0, number + 1
        if held:
            yield close()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bodies(docs, id_col, text_col).withColumn("_h", F.xxhash64("body"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    rows.mapInArrow(build, SHARD).write.option("compression", "uncompressed").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with ``base``: ids in all shards before, by range and number."""
    rows = spark.read.schema(SHARD).parquet(path)
    heads = rows.select("part", "number", "n_tokens")  # one small row per shard
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of the writing job
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(before("part")), F.lit(0)).alias("_part_base"))
    inner = F.coalesce(F.sum("n_tokens").over(before("part", "number")), F.lit(0))
    base = heads.select("part", "number", inner.alias("_inner")).join(parts, "part").select(
        "part", "number", (F.col("_part_base") + F.col("_inner")).alias("base"))
    return rows.join(base, ["part", "number"])


def open_shard(row) -> WaveletMatrix:
    """The matrix of one shard row."""
    return WaveletMatrix(row["n_tokens"], row["width"], row["zeros"], row["planes"], row["ranks"])


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 of every document."""

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = open_shard(row).all().astype("<u4")
                doc, none = np.frombuffer(_unzip(row["doc_ids"], 16 * row["n_docs"]), "<i8").reshape(2, -1)
                n = np.frombuffer(_unzip(row["doc_tokens"], 8 * row["n_docs"]), "<i8")
                start = np.cumsum(n) - n
                crc = [zlib.crc32(ids[s:s + m].tobytes()) for s, m in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(start + row["base"], pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    keep = ["base", "n_tokens", "n_docs", "width", "zeros", "doc_ids", "doc_tokens", "planes", "ranks"]
    return shards(spark, path).select(*keep).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, width: int, end_id: int = 1) -> DataFrame:
    """Writes all documents to a fresh folder of the shared checkpoint directory and reads them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "wavelet")
    write(docs, path, tokenizer, width, end_id)
    return documents_of(spark, path)
