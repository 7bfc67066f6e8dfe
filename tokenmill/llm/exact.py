"""Exact dedup with static binary-fuse filters over immutable snapshots.

A *snapshot* is a set of documents that no longer changes. Its distinct
digests are dealt into buckets by hash; each bucket gets one static 3-wise
binary-fuse filter (8-bit fingerprints, about 9 bits a digest), built once.
An incoming batch is first grouped by digest on its own (new-batch
duplicates), each group then asks the filter of its bucket. A negative is
certainly new; positives join the snapshot's exact buckets. The bytes of every group that
holds more than one row are then compared, so equality is decided
on the normalised text itself and never on a digest or filter alone. Should
different texts share a digest, all is done again with a longer one.

Edge cases: null text is empty; rows with a null id count as rows of a group
(they sort last and keep their null id); repeated ids are rows of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Digests in one filter: bounds the memory of a task that builds or asks it.
FILTER_KEYS = 200_000
#: Words of the bitmap that says which texts are compared: bounds what is broadcast to 2 MB of marks. A corpus with
#: many more shared digests than its 16 million bits only sends more texts to the comparison.
SCREEN_WORDS = 1 << 18

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
        return x ^ (x >> np.uint64(31))


class BinaryFuse:
    """Static 3-wise binary-fuse filter with 8-bit fingerprints; no false negatives."""

    def __init__(self, seed: int, seg: int, slots: np.ndarray):
        self.seed, self.seg, self.slots = seed, seg, slots

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        seg = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        return seg, max(1, int(np.ceil(n * factor / seg)) - 2)

    @staticmethod
    def _places(h: np.ndarray, seg: int, spans: int) -> np.ndarray:
        """Three slots of each key, in three neighbouring segments."""
        first = ((h >> np.uint64(32)) * np.uint64(spans)) >> np.uint64(32)
        mask = np.uint64(seg - 1)
        parts = [h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36) ^ h >> np.uint64(9)) & mask]
        return np.stack([((first + np.uint64(j)) * np.uint64(seg) + p).astype(np.int64) for j, p in enumerate(parts)])

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        seg, spans = cls._shape(len(keys))
        seed = 0
        while True:
            seed += 1
            if seed % 8 == 0:
                spans += max(1, spans // 8)  # more room; any set can be placed in the end
            h = _mix(keys, seed)
            at = cls._places(h, seg, spans)
            layers = cls._peel(at, (spans + 2) * seg)
            if layers is not None:
                break
        slots, prints = np.zeros((spans + 2) * seg, np.uint8), cls._print(h)
        for key, j in reversed(layers):  # keys of a layer own slots that no other of the layer reads
            own = at[j, key]
            slots[own] = prints[key] ^ slots[at[(j + 1) % 3, key]] ^ slots[at[(j + 2) % 3, key]]
        return cls(seed, seg, slots)

    @staticmethod
    def _peel(at: np.ndarray, n: int):
        """Layers of (keys, which of the three slots is theirs alone), or None if a core is left."""
        count = np.bincount(at.ravel(), minlength=n)
        ident = np.zeros(n, np.int64)
        for j in range(3):
            np.bitwise_xor.at(ident, at[j], np.arange(at.shape[1]))
        alive, layers, left = np.ones(at.shape[1], bool), [], at.shape[1]
        lone = np.flatnonzero(count == 1)
        while len(lone):
            key, first = np.unique(ident[lone], return_index=True)
            slot = lone[first]
            j = np.argmax(at[:, key] == slot, axis=0)
            layers.append((key, j))
            alive[key] = False
            left -= len(key)
            places = at[:, key]
            np.subtract.at(count, places.ravel(), 1)
            np.bitwise_xor.at(ident, places.ravel(), np.tile(key, 3))
            lone = np.unique(places.ravel())
            lone = lone[count[lone] == 1]
        return layers if left == 0 else None

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._places(h, self.seg, len(self.slots) // self.seg - 2)
        return self.slots[a] ^ self.slots[b] ^ self.slots[c] == self._print(h)


def normalised(text):
    """One space for each run of ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _bucket(key, n: int):
    return F.pmod(F.shiftrightunsigned(key, 20), F.lit(n)).cast("int")


def build_filters(snapshot: DataFrame, n_buckets: int) -> DataFrame:
    """One filter row per bucket of the snapshot's distinct ``key`` (long) values."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [f.seed], "seg": [f.seg], "slots": [f.slots.tobytes()]})

    return (snapshot.select("key").distinct().withColumn("bucket", _bucket(F.col("key"), n_buckets))
            .groupBy("bucket").applyInPandas(build, "bucket int, seed int, seg int, slots binary"))


def screen(groups: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """``digest`` and ``maybe`` of each group: false means surely not in the snapshot."""

    def ask(rows: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"digest": rows["digest"], "maybe": False})
        if len(filt) and len(rows):
            x = filt.iloc[0]
            f = BinaryFuse(int(x["seed"]), int(x["seg"]), np.frombuffer(x["slots"], np.uint8))
            out["maybe"] = f.has(rows["key"].to_numpy().view(np.uint64))
        return out

    asked = groups.select("digest", "key", _bucket(F.col("key"), n_buckets).alias("bucket"))
    return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, "digest binary, maybe boolean")


def dedup(docs: DataFrame, in_snapshot=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known
    (a row of the new batch whose text the snapshot holds).

    ``in_snapshot`` is a condition on ``doc_id``: rows for which it holds are the
    snapshot, the rest the new batch; by default the lower half of the id range.
    """
    return _flagged(docs, None, in_snapshot, id_col, text_col).drop("row")


def dedup_rows(docs: DataFrame, row_col: str, in_snapshot=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup`` with ``row``, the value of ``row_col`` (a long that differs for every row of
    ``docs``): it says which of an id's rows is kept."""
    return _flagged(docs, row_col, in_snapshot, id_col, text_col)


def _screened(source: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of ``source`` whose digest may be a shared one: looked up in a bitmap of ``SCREEN_WORDS`` rows of 64 bits,
    which is all that is broadcast. It lets every shared digest through; others pass as far as the bitmap is full."""
    h = F.xxhash64("digest", F.lit(29))
    word = F.pmod(h, F.lit(SCREEN_WORDS)).cast("int")
    mark = F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, 58) as int))")
    marks = shared.withColumn("_h", h).select(word.alias("_word"), mark.alias("_mark")).groupBy("_word").agg(
        F.bit_or("_mark").alias("_marks"))
    own = source.withColumn("_h", h).withColumn("_word", word).withColumn("_mark", mark)
    return own.join(F.broadcast(marks), "_word").where("_marks & _mark != 0").select(source.columns)


def _sha(body):
    return F.unhex(F.sha2(body, 256))


def _sha_and_more(body):
    return F.concat(_sha(body), F.unhex(F.sha2(F.concat(F.lit("\x00check"), body), 512)))


def _flagged(docs: DataFrame, row_col: str | None, in_snapshot, id_col: str, text_col: str,
             digests=(_sha, _sha_and_more)) -> DataFrame:
    """``digests``: of a text, as binary; the second is used for all rows if different texts share one of the first."""
    text = normalised(F.col(text_col))
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), digests[0](text).alias("digest"),
                                   _sha(text).alias("sha"),
                                   (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")))
    rows = rows.withColumn("key", F.xxhash64("digest"))
    lo, hi, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    asked = in_snapshot
    if in_snapshot is None:
        mid = 0 if lo is None else (lo + hi) // 2
        in_snapshot = F.coalesce(F.col("doc_id") <= mid, F.lit(False))
    n_buckets = max(1, -(-total // FILTER_KEYS))
    flagged = rows.withColumn("old", in_snapshot)

    def grouped(part):
        return part.groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))

    old, new = grouped(flagged.filter("old")), grouped(flagged.filter("not old"))
    filters = build_filters(old, n_buckets)
    maybe = screen(new, filters, n_buckets).filter("maybe").select("digest")
    # exact buckets: a positive that the snapshot really holds, then copies inside either part
    known = maybe.join(old.select("digest"), "digest").withColumn("known", F.lit(True))
    inside = old.unionByName(new).filter("n > 1").select("digest").withColumn("known", F.lit(False))
    shared = cut_lineage(known.unionByName(inside).groupBy("digest").agg(F.max("known").alias("known")))

    # byte check: all texts of a shared digest are one if the least is the greatest; copies meet before they travel
    source = docs.select(text.alias("body")).withColumn("digest", digests[0](F.col("body")))
    ends = _screened(source, shared).groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
    clash = ends.filter("least != greatest").join(shared, "digest", "left_semi")
    if not clash.isEmpty():
        if len(digests) == 1:
            raise RuntimeError("different texts share a digest of 768 bits")
        return _flagged(docs, row_col, asked, id_col, text_col, digests[1:])
    # one text for each shared digest: the digest names the group, the first row stays
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    groups = (rows.join(shared, "digest").groupBy("digest")
              .agg(F.count(F.lit(1)).alias("group_size"), first.alias("least"), F.max("known").alias("known")))
    marked = rows.join(groups, "digest", "left")
    keep = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.id"))
    return marked.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("least").isNull() | (F.col("row") == F.col("least.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        (F.coalesce("known", F.lit(False)) & ~in_snapshot).alias("known"), "row")
