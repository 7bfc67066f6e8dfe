"""Sequence packing as a cutting-stock problem, solved by column generation.

A document longer than a sequence is cut into full sequences and a rest; the
rests and the shorter documents are the pieces to pack. Their lengths are
counted in classes of ``STEP`` tokens (rounded up): a histogram of at most
``capacity / STEP`` numbers, whatever the corpus size. The driver solves

    min sum x_p   subject to   sum x_p * (pieces of class c in p) >= demand_c

by a revised simplex over the patterns found so far; an unbounded-knapsack
dynamic program over the dual prices finds the next pattern, until none pays.
Patterns are rounded down, what demand is left is packed first-fit decreasing
on the histogram, and the result, a list of (pattern, times), is again
bounded by the number of classes. Pieces get a rank in their class (counts
per partition, then prefix sums), and rank + pattern list give the sequence
and slot by arithmetic. Padding is the rounding to ``STEP``, about half a
step for each piece, plus the last few sequences.

Edge cases: null text is empty (one id, the end id); ties in length are
ranked by id; repeated ids are packed as documents of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bodies, cut_lineage
from .tokens import encode_texts, groups_of_bytes, with_end

CAPACITY = 4096
#: Tokens in one length class: half of it is the mean padding of a piece.
STEP = 16
BATCH_BYTES = 8 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and cuts each document's ids into pieces of at most ``capacity``."""

    def cut(batches):
        for b in batches:
            ids_, texts = b.column("doc_id").to_pylist(), b.column("body").to_pylist()
            for lo, hi in groups_of_bytes([len(t) for t in texts], BATCH_BYTES):
                flat, n = with_end(*encode_texts(tokenizer, texts[lo:hi]), end_id)
                flat, rows, at = flat.astype("<u4"), [], 0
                for doc, size in zip(ids_[lo:hi], n.tolist()):
                    for start in range(0, size, capacity):
                        m = min(capacity, size - start)
                        rows.append((doc, start, m, zlib.crc32(flat[at + start:at + start + m].tobytes()), size))
                    at += size
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return bodies(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_pattern(price: np.ndarray, demand: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over classes 1..len(price) (class c weighs c units): value and counts."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    classes = np.flatnonzero((demand > 0) & (price > 1e-12)) + 1
    for room in range(1, units + 1):
        best[room] = best[room - 1]
        fit = classes[classes <= room]
        if len(fit):
            value = best[room - fit] + price[fit - 1]
            k = int(np.argmax(value))
            if value[k] > best[room] + 1e-12:
                best[room], last[room] = value[k], fit[k]
    counts, room = np.zeros(len(price), np.int64), units
    while room > 0:
        if last[room] and best[room] > best[room - 1] + 1e-13:
            counts[last[room] - 1] += 1
            room -= int(last[room])
        else:
            room -= 1
    return float(best[units]), counts


def solve(demand: np.ndarray, units: int, max_rounds: int = 4000) -> tuple[list[np.ndarray], np.ndarray]:
    """Column generation: (patterns of the last basis, how often the relaxed plan uses each)."""
    rows = np.flatnonzero(demand > 0)
    basis = [np.eye(len(demand), dtype=np.int64)[c] * (units // (c + 1)) for c in rows]
    inverse = np.diag([1.0 / b[c] for b, c in zip(basis, rows)])
    x = inverse @ demand[rows]
    for k in range(max_rounds):
        if k and k % 200 == 0:  # against drift of the updated inverse
            inverse = np.linalg.inv(np.stack([b[rows] for b in basis], axis=1).astype(float))
            x = inverse @ demand[rows]
        price = np.zeros(len(demand))
        price[rows] = np.maximum(inverse.sum(axis=0), 0)  # every pattern costs one sequence
        value, column = best_pattern(price, demand, units)
        if value <= 1 + 1e-7:
            break
        way = inverse @ column[rows]
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(len(x), np.inf)
        ratio[up] = np.maximum(x[up], 0) / way[up]
        out = int(np.argmin(ratio))
        step = ratio[out]
        x -= step * way
        x[out] = step
        basis[out] = column
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
    return basis, np.maximum(x, 0)


def first_fit(left: np.ndarray, units: int) -> list[np.ndarray]:
    """First-fit decreasing of what rounding left over, as patterns used once."""
    out: list[np.ndarray] = []
    left = left.copy()
    while left.any():
        pattern, room = np.zeros_like(left), units
        for c in np.flatnonzero(left)[::-1]:
            k = min(int(left[c]), room // (c + 1))
            pattern[c] += k
            left[c] -= k
            room -= k * (c + 1)
        out.append(pattern)
    return out


def plan(demand: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) whose pieces are exactly the demand of each class."""
    if not demand.any():
        return []
    basis, x = solve(demand, units)
    left, out = demand.copy(), []
    for i in np.argsort(-x):
        p = basis[i]
        times = int(np.floor(x[i] + 1e-9))
        used = p > 0
        times = min(times, int((left[used] // p[used]).min())) if used.any() else 0
        if times > 0:
            out.append((p, times))
            left -= p * times
    return out + [(p, 1) for p in first_fit(left, units)]


def slots(packed: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """For each class, which ranks a pattern takes: rows (class, first_rank, per, first_seq, times, place).

    The pieces of class c with ranks first_rank .. first_rank + per * times - 1 go to sequences
    first_seq + (rank - first_rank) // per. At most one row for each class of each pattern."""
    given: dict[int, int] = {}
    rows, seq = [], 0
    for p, times in packed:
        for c in np.flatnonzero(p)[::-1]:
            rows.append((int(c), given.get(int(c), 0), int(p[c]), seq, times))
            given[int(c)] = given.get(int(c), 0) + int(p[c]) * times
        seq += times
    return pd.DataFrame(rows, columns=["cls", "first_rank", "per", "first_seq", "times"])


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """``parts`` (PIECES columns) with sequence_id and offset: every piece in one place,
    sequences of at most ``capacity`` tokens, gapless from 0."""
    spark = parts.sparkSession
    units = capacity // step
    cls = (F.ceil(F.col("length") / step) - 1).cast("int")
    # full pieces are a sequence each; the rest has a rank in its class
    parts = parts.withColumn("cls", F.when(F.col("length") == capacity, F.lit(-1)).otherwise(cls))
    order = F.xxhash64("doc_id", "start")
    deal = F.pmod(order, F.lit(64)).cast("int")  # salts the few classes: no class is one group
    parts = cut_lineage(parts.withColumn("deal", deal))
    counts = parts.groupBy("cls", "deal").count().collect()  # at most 64 * (classes + 1) rows
    demand = np.zeros(units, np.int64)
    for r in counts:
        if r["cls"] >= 0:
            demand[r["cls"]] += r["count"]
    packed = plan(demand, units)
    n_packed = sum(t for _, t in packed)
    begin, given = [], {}
    for r in sorted(counts, key=lambda r: (r["cls"], r["deal"])):
        begin.append((r["cls"], r["deal"], given.get(r["cls"], 0)))
        given[r["cls"]] = given.get(r["cls"], 0) + r["count"]
    begins = spark.createDataFrame(begin, "cls int, deal int, begin long")
    table = slots(packed)
    where = spark.createDataFrame(table.values.tolist(), "cls int, first_rank long, per long, first_seq long, times long")

    w = Window.partitionBy("cls", "deal").orderBy("doc_id", "start", "ids_crc32")
    ranks = (parts.withColumn("local", F.row_number().over(w) - 1)
             .join(F.broadcast(begins), ["cls", "deal"])  # bounded: 64 * (classes + 1) rows
             .withColumn("rank", F.col("local") + F.col("begin")))
    full = ranks.filter("cls < 0").withColumn("sequence_id", F.lit(n_packed) + F.col("rank"))
    # bounded: one row for each class of each pattern, at most classes ** 2 + their rest
    short = (ranks.filter("cls >= 0").join(F.broadcast(where), "cls")
             .filter("rank >= first_rank and rank < first_rank + per * times")
             .withColumn("sequence_id", F.col("first_seq") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per"))))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    both = full.select(*cols).unionByName(short.select(*cols))
    inside = (Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                F.col("sequence_id").cast("long").alias("sequence_id"), "offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, step: int = STEP,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents: one row per piece (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)."""
    return pack_pieces(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity, step)
