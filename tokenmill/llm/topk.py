"""Exact top-k inner-product search on a bit-sliced index.

Vectors are dealt into blocks. A block's index holds, for each attribute, the
``BITS`` most significant bits of its values as bitmaps over the block's rows
(bit slices). A query's score over the quantised values is a sum of slices at
binary weights, added with carry-save bitmap arithmetic into score slices.
Going from the most significant score slice downward finds the k-th largest
quantised score; what quantising can have hidden bounds how far below it a
top row can be, and all rows down to there (the boundary) are scored exactly.
Nothing is approximate in the result.

Edge cases: vectors that are null or hold a null or non-finite component take
no part; where a block's scores could leave 64 bits its boundary is scored in
wider integers; a quantised value or a returned score beyond 64 bits is an
error; a shorter vector is padded with zeros; ties go to the smaller id;
repeated ids are rows of their own, and a query never meets its own row; fewer
than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in an index block, queries that meet a block in one task, sliced bits of an attribute.
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
BITS = 5
#: The largest score that is returned lies below; scores of this size stand for all beyond.
MOST = (1 << 63) - 1
HITS = "query_row long, query_id long, vec_row long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component as long; null if the vector takes no part."""
    fits = lambda v: (v.cast("double") >= -(2.0 ** 53)) & (v.cast("double") < 2.0 ** 53)
    far = F.raise_error(F.lit("a component times 1024 is beyond 64 bits")).cast("long")
    x = F.transform(vector, lambda v: F.when(fits(v), F.floor(v.cast("double") * 1024)).otherwise(far))
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(v))
    return F.when(vector.isNotNull() & fine, x)


class SliceIndex:
    """Bit slices of a block of integer rows (rows x attributes)."""

    def __init__(self, values: np.ndarray, bits: int = BITS):
        self.values, self.n = values, len(values)
        low, high = values.min(axis=0), values.max(axis=0)
        self.widest = max((max(-int(a), int(b)) for a, b in zip(low, high)), default=0)
        # differences of longs fit 64 bits without a sign
        above = values.astype(np.uint64) - low.astype(np.uint64)
        spread = int(above.max(initial=0))
        self.drop = max(0, spread.bit_length() - bits)  # low bits that the slices leave out
        self.bits = max(1, spread.bit_length() - self.drop)
        small = (above >> np.uint64(self.drop)).astype(np.uint32)
        words = -(-self.n // 64)
        self.alive = np.zeros(words * 8, np.uint8)
        self.alive[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.alive = self.alive.view(np.uint64)
        self.slices = np.zeros((values.shape[1], self.bits, words), np.uint64)
        for j in range(self.bits):
            raw = np.packbits((small >> j & 1).astype(np.uint8), axis=0, bitorder="little").T
            wide = np.zeros((values.shape[1], words * 8), np.uint8)
            wide[:, : raw.shape[1]] = raw
            self.slices[:, j] = wide.view(np.uint64)

    def add(self, weights: np.ndarray) -> list[np.ndarray]:
        """Score slices of sum |w_d| * u_d, least significant first; u_d is the sliced value, or
        its complement where w_d is negative."""
        size = np.abs(weights).astype(np.uint64)  # -2**63 too
        piles: list[list[np.ndarray]] = [[] for _ in range(self.bits + int(size.max(initial=0)).bit_length() + 1)]
        turned = np.where((weights < 0)[:, None, None], ~self.slices & self.alive, self.slices)
        for level in range(int(size.max(initial=0)).bit_length()):
            used = np.flatnonzero(size >> np.uint64(level) & np.uint64(1))
            for j in range(self.bits):
                if len(used):
                    piles[level + j].append(turned[used, j])
        out, w = [], 0
        while w < len(piles):
            pile = np.concatenate(piles[w]) if piles[w] else np.zeros((0, len(self.alive)), np.uint64)
            while len(pile) > 1:  # carry-save: three bitmaps of a weight become one, and one of the next
                third = len(pile) // 3
                if third:
                    a, b, c = pile[:third], pile[third:2 * third], pile[2 * third:3 * third]
                    half = a ^ b
                    carry, pile = a & b | half & c, np.concatenate([half ^ c, pile[3 * third:]])
                else:
                    carry, pile = pile[:1] & pile[1:], pile[:1] ^ pile[1:]
                if w + 1 == len(piles):
                    piles.append([])
                piles[w + 1].append(carry)
            out.append(pile[0] if len(pile) else np.zeros_like(self.alive))
            w += 1
        return out

    @staticmethod
    def _count(x: np.ndarray) -> int:
        return int(np.bitwise_count(x).sum())

    def kth(self, score: list[np.ndarray], k: int, alive: np.ndarray) -> int:
        """k-th largest score among the rows of ``alive``, from the most significant slice downward."""
        sure, tied, value = 0, alive, 0
        for w in range(len(score) - 1, -1, -1):
            with_bit = tied & score[w]
            n = self._count(with_bit)
            if sure + n >= k:
                tied, value = with_bit, value | 1 << w
            else:
                sure, tied = sure + n, tied & ~score[w]
        return value

    @staticmethod
    def at_least(score: list[np.ndarray], least: int, alive: np.ndarray) -> np.ndarray:
        """Rows whose score is ``least`` or more."""
        if least <= 0:
            return alive
        if least >> len(score):
            return np.zeros_like(alive)
        over, equal = np.zeros_like(alive), alive
        for w in range(len(score) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & score[w]
            else:
                over, equal = over | equal & score[w], equal & ~score[w]
        return over | equal

    def top(self, query: np.ndarray, ids: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best rows but ``own``; ties to the smaller id."""
        alive, weight = self.alive.copy(), sum(map(abs, query.tolist()))
        if own >= 0:
            alive[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        if self._count(alive) > k:
            score = self.add(query)
            # a dropped part adds 0 .. 2 ** drop - 1 of each |w|, to one side or the other
            slack = -(-((1 << self.drop) - 1) * weight // (1 << self.drop))
            alive = self.at_least(score, self.kth(score, k, alive) - slack, alive)
        rows = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little"))
        if self.widest * weight < MOST:
            exact = self.values[rows] @ query
            best = np.lexsort((ids[rows], -exact))[:k]
            return rows[best], exact[best]
        wide = [sum(a * b for a, b in zip(v, query.tolist())) for v in self.values[rows].tolist()]
        best = sorted(range(len(rows)), key=lambda i: (-wide[i], ids[rows[i]]))[:k]
        # a score beyond 64 bits is MOST or -MOST, an error where it is among the k best of all blocks
        return rows[best], np.array([max(-MOST, min(MOST, wide[i])) for i in best], np.int64)


def _matrix(column: list, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows of ``vectors`` for each of its rows that ``queries`` (a condition on
    vec_id) selects: query_id, rank, vec_id, score."""
    from .common import cut_lineage
    rows = cut_lineage(vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"),
                                      F.monotonically_increasing_id().alias("row")).filter("v is not null"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked = rows.filter(F.coalesce(queries, F.lit(False)))
    n_asked = asked.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n_asked // QUERY_ROWS))
    deal = lambda m, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(m)).cast("int")
    # every query group meets every block once: a stated query set against all rows, in blocks
    left = rows.withColumn("block", deal(blocks, 1)).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("grp", deal(groups, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(block: pa.Table, asks: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if block.num_rows and asks.num_rows:
            ids = block.column("vec_id").combine_chunks()
            known = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max,
                             ids.fill_null(0).to_numpy(zero_copy_only=False))
            index = SliceIndex(_matrix(block.column("v").to_pylist(), width))
            own = {r: i for i, r in enumerate(block.column("row").to_pylist())}
            found = []
            wanted = _matrix(asks.column("v").to_pylist(), width)
            for q, row, qid in zip(wanted, asks.column("row").to_pylist(), asks.column("vec_id").to_pylist()):
                at, score = index.top(q, known, k, own.get(row, -1))
                found.append((np.full(len(at), row), np.full(len(at), qid), at, at, score))
            out = [np.concatenate(x) for x in zip(*found)]
            out[2] = np.array(list(own), np.int64)[out[2]]
            ids = ids.take(pa.array(out[3], pa.int64()))
        else:
            ids = pa.array([], pa.int64())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), ids,
                         pa.array(out[4], pa.int64())], ["query_row", "query_id", "vec_row", "vec_id", "score"])

    keys = ["block", "grp"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, HITS)
    # k hits a block for each query; the best k of them in (score, id) order
    order = F.struct((-F.col("score")).alias("worse"), F.col("vec_id").isNull().alias("none"), "vec_id", "vec_row")
    best = hits.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        F.when(F.abs("b.worse") < MOST, -F.col("b.worse"))
        .otherwise(F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).alias("score"))
