"""Wrapped packing with one exchange of the payload (K1-K4).

1. Rows are range-partitioned and sorted by (group, order keys, hash of the
   payload) and written once: this is the only exchange that carries the
   payload. Rows of one order key, or without one, are many ranges, as the hash
   tells them apart.
2. Lengths are summed per range and group; the sums before a range give the
   place at which its first group goes on (at most one number a range).
3. Every task reads its range in order and cuts the running sequence at the
   block boundaries. Whole blocks leave as they are. Only the pieces of a
   block that straddles ranges are shuffled: one or two rows a task.

Rows that lie in order already (``in_order``) are their own ranges: they are not exchanged, nothing is written, and
steps 2 and 3 read them again.

A task holds one Arrow batch and the rest of a block. Equal rows follow each
other in any order, which changes nothing; other rows of one order key follow
by the hash of their payload.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..session import cut_lineage


class _Text:
    """Payload of strings; a token is a code point."""

    kind = StringType()

    def joined(self, rest, column: pa.Array):
        return rest + "".join(x or "" for x in column.to_pylist())

    empty = ""

    def blocks(self, body, chunk: int, n: int) -> pa.Array:
        return pa.array([body[i * chunk:(i + 1) * chunk] for i in range(n)], pa.string())


class _Ids:
    """Payload of integer arrays."""

    kind = ArrayType(IntegerType())

    def joined(self, rest, column: pa.Array):
        return np.concatenate([rest, column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])

    empty = np.zeros(0, np.int32)

    def blocks(self, body, chunk: int, n: int) -> pa.Array:
        at = pa.array(np.arange(n + 1, dtype=np.int32) * chunk)
        return pa.ListArray.from_arrays(at, pa.array(body[:n * chunk]))


def _same(a, b) -> bool:
    return a is not None and a.as_py() == b.as_py()


def _changes(groups: pa.StructArray) -> np.ndarray:
    """Rows that have another group than the row before (the first row is none)."""
    out = np.zeros(max(0, len(groups) - 1), bool)
    for f in groups.flatten():
        a, b = f.slice(1), f.slice(0, max(0, len(f) - 1))
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(out) + 1


def _cutter(payload, chunk: int, tails: bool):
    """Rows of one range, in order -> (_g, block_id, s, t, whole). With ``tails`` what is left at a group's end leaves too."""

    def out(groups, row, block, start, t, whole):
        k = len(t)
        return pa.RecordBatch.from_arrays(
            [groups.take(pa.array(np.full(k, row))), pa.array(block + np.arange(k)), pa.array(start + chunk * np.arange(k)), t,
             pa.array(np.full(k, whole))], ["_g", "block_id", "s", "t", "whole"])

    def run(batches):
        pos, rest, last = 0, payload.empty, None  # place and content of what is not out yet, and its group
        for b in batches:
            if not b.num_rows:
                continue
            groups, seq, base, begin = (b.column(c) for c in ("_g", "_t", "_base", "_begin"))
            starts = [0, *_changes(groups).tolist()]
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                if s or not _same(last, groups[0]):
                    # another group: what is left of the one before never fills its block
                    if tails and len(rest):
                        yield out(end, 0, pos // chunk, pos, payload.blocks(rest, len(rest), 1), False)
                    pos, rest = (base[s].as_py() or 0) + (begin[s].as_py() or 0), payload.empty
                rest = payload.joined(rest, seq.slice(s, e - s))
                need = -pos % chunk
                if need and len(rest) >= need:  # the end of a block that began in an earlier range
                    yield out(groups, s, pos // chunk, pos, payload.blocks(rest, need, 1), False)
                    pos, rest = pos + need, rest[need:]
                n = 0 if pos % chunk else len(rest) // chunk
                if n:
                    yield out(groups, s, pos // chunk, pos, payload.blocks(rest, chunk, n), True)
                    pos, rest = pos + n * chunk, rest[n * chunk:]
                last, end = groups[s], groups.slice(s, 1)
        if last is not None and len(rest):
            yield out(end, 0, pos // chunk, pos, payload.blocks(rest, len(rest), 1), False)

    return run


def pack_ranges(rows: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], chunk: int, text: bool,
                prepare: Callable[[Column], Column] | None = None, partitions: int | None = None,
                in_order: bool = False) -> DataFrame:
    """``rows``: group and order columns, ``_t`` (string or integer array; null is empty), made ready by ``prepare``
    once it is where it is cut. Returns the group columns, block_id and ``_body``, the whole blocks of ``chunk`` tokens
    of each group's sequence. ``in_order``: the rows of each partition, and the partitions, are in (group, order
    columns) order, and the same whenever they are read."""
    return _pack(rows, group_cols, order_cols, chunk, text, prepare, partitions, False, in_order)[0]


def pack_on(rows: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], chunk: int, text: bool,
            partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pack_ranges`` for sequences that go on from call to call, as (blocks, left over).

    ``rows`` has a column ``_begin`` too: in the row that comes first of its group, the place (a multiple of ``chunk``)
    at which its ``_t`` begins, else null or 0. ``left over`` has one row a group: the group columns, ``block_id`` of
    the block to go on with and ``_body``, its tokens so far (fewer than ``chunk``, maybe none)."""
    return _pack(rows, group_cols, order_cols, chunk, text, None, partitions, True)


def _pack(rows, group_cols, order_cols, chunk, text, prepare, partitions, tails, in_order=False) -> tuple[DataFrame, DataFrame | None]:
    spark = rows.sparkSession
    payload = _Text() if text else _Ids()
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = F.struct(*group_cols) if group_cols else F.struct(F.lit(0).alias("_all"))
    begin = F.coalesce(F.col("_begin") if tails else F.lit(0), F.lit(0)).cast("long").alias("_begin")
    named = rows.select(g.alias("_g"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                        F.xxhash64("_t").alias("_h"), F.xxhash64("_t", F.lit(1)).alias("_h2"), begin, "_t")
    keys = ["_g", *[f"_o{i}" for i in range(len(order_cols))], "_h", "_h2"]
    t = prepare(F.col("_t")) if prepare else F.col("_t")
    ranged = named if in_order else named.repartitionByRange(p, *keys).sortWithinPartitions(*keys)
    ranged = ranged.select("_g", "_begin", t.alias("_t"), F.spark_partition_id().alias("_pid"))
    n = F.char_length("_t") if text else F.size("_t")
    ranged = ranged.withColumn("_n", F.greatest(n, F.lit(0)).cast("long") + F.col("_begin"))
    if not in_order:
        ranged = cut_lineage(ranged)
    totals = ranged.groupBy("_g", "_pid").agg(F.sum("_n").alias("_n"))
    if in_order:
        totals = cut_lineage(totals)  # a row for each range
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = totals.select("_g", "_pid", F.sum("_n").over(before).alias("_base")).where("_base > 0")
    # one group at most goes on from range to range: a row for each range
    based = ranged.drop("_n").join(F.broadcast(base), ["_g", "_pid"], "left")
    schema = StructType([ranged.schema["_g"]]).add("block_id", "long").add("s", "long").add("t", payload.kind).add("whole", "boolean")
    cut = based.mapInArrow(_cutter(payload, chunk, tails), schema)
    if not in_order:
        cut = cut_lineage(cut)  # pieces and whole blocks are read apart
    parts = cut.where("not whole").groupBy("_g", "block_id").agg(F.array_sort(F.collect_list(F.struct("s", "t"))).alias("_p"))
    if text:
        joined, size = F.array_join(F.transform("_p", lambda x: x["t"]), ""), F.char_length("_body")
    else:
        joined, size = F.flatten(F.transform("_p", lambda x: x["t"])), F.size("_body")
    whole = cut.where("whole").select("_g", "block_id", F.col("t").alias("_body"))
    pieces = parts.select("_g", "block_id", joined.alias("_body"))
    named_groups = [F.col("_g")[c].alias(c) for c in group_cols]
    blocks = whole.union(pieces.where(size == chunk)).select(*named_groups, "block_id", "_body")
    if not tails:
        return blocks, None
    ends = totals.groupBy("_g").agg(F.floor(F.sum("_n") / chunk).cast("long").alias("block_id"))
    none = F.lit("") if text else F.array().cast("array<int>")
    left = ends.join(pieces.where(size < chunk), ["_g", "block_id"], "left")
    return blocks, left.select(*named_groups, "block_id", F.coalesce("_body", none).alias("_body"))
