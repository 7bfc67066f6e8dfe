"""Byte-level BPE by a rank file, all words of a batch at once in numpy matrices.

A text is split by the vocabulary's pattern. A match that is itself a token is
that token. The distinct other matches of a batch become rows of symbol ids,
bucketed by length and padded in each bucket. In a round every row merges its
leftmost pair of least rank: pairs are looked up in an open-addressing hash
table of all (left id, right id), the row closes up behind the merge, only the
two new pairs are looked up, and rows without a pair left leave the matrix
(compaction). Rows of more than ``LONG`` bytes merge one by one, and there a
round merges the places of the least rank from the left, up to the first merge
that makes a pair of lower rank: the same order, in fewer rounds.
Decoding gathers the vocabulary's byte strings.

No state is kept from batch to batch but the vocabulary, so a worker's memory
is bounded by ``BATCH_BYTES`` of text (one text at least).

Edge cases: null text is empty (no ids, empty decoded text); texts and matches
of any length are encoded whole; repeated rows give repeated results, null ids
stay null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state
from .tokens import groups_of_bytes

#: Bytes of text encoded together.
BATCH_BYTES = 6 << 20
#: Widths of the padded matrices; a longer match is a row of its own.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
LONG = WIDTHS[-1]
#: Cells of one matrix.
CELLS = 1 << 21
#: Rank of "no such pair".
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 byte string and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of their concatenation, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        self.bits = max(4, int(max(1, len(key)) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        at, left = self._home(key), np.arange(len(key))
        while len(left):  # each free slot takes the first key that asks for it, the others move on
            free = self.keys[at[left]] < 0
            slot, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[slot], self.values[slot] = key[won], value[won]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is none or an id is negative (padding)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at, out = self._home(key), np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        while len(todo):
            have = self.keys[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out


class RankBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.ranks = read_ranks(path)
        self.pairs = PairTable(self.ranks)
        self.byte_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_id < 0).any():
            raise ValueError("the rank file lacks single bytes")
        # white space is the Unicode property here; the regex module's \s also takes U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        strings: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            strings[rank] = token
        self.strings = pa.array(strings, pa.binary())

    def merged(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the matches, none of which is a token: (all ids, number of each match's ids)."""
        size = np.array([len(m) for m in matches], np.int64)
        flat = self.byte_id[np.frombuffer(b"".join(matches), np.uint8)]
        begin, n = np.cumsum(size) - size, np.ones(len(matches), np.int64)
        low = 0
        for width in WIDTHS:
            bucket = np.flatnonzero((size > low) & (size <= width))
            low = width
            step = max(1, CELLS // width)
            for s in range(0, len(bucket), step):
                rows = bucket[s:s + step]
                self._matrix(flat, rows, begin, size, n, width)
        for row in np.flatnonzero(size > LONG).tolist():
            ids = self._long(flat[begin[row]:begin[row] + size[row]])
            flat[begin[row]:begin[row] + len(ids)], n[row] = ids, len(ids)
        out = np.cumsum(n)
        at = np.arange(out[-1] if len(out) else 0) + np.repeat(begin - (out - n), n)
        return flat[at], n

    def _matrix(self, flat, rows, begin, size, n, width) -> None:
        """Merges the rows of one bucket; results go back to the start of each row's place in ``flat``."""
        col = np.arange(width)
        live = col < size[rows, None]
        ids = np.where(live, flat[np.where(live, begin[rows, None] + col, 0)], -1)
        left = size[rows].copy()
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            at = rank.argmin(1)  # the leftmost of the least
            r = np.arange(len(rows))
            least = rank[r, at]
            done = least == NONE
            if done.any():
                d = np.flatnonzero(done)
                keep = col[:ids.shape[1]] < left[d, None]
                flat[(begin[rows[d], None] + col[:ids.shape[1]])[keep]] = ids[d][keep]
                n[rows[d]] = left[d]
                go = np.flatnonzero(~done)
                rows, left, at, least = rows[go], left[go], at[go], least[go]
                w = int(left.max()) if len(go) else 0  # the matrix narrows with its longest row
                ids, rank, r = ids[go, :w], rank[go, :max(0, w - 1)], np.arange(len(go))
                if not len(rows):
                    return
            w = ids.shape[1]
            ids[r, at] = least  # a token's id is its rank
            shift = col[:w] + (col[:w] > at[:, None])
            ids = np.where(shift < w, np.take_along_axis(ids, np.minimum(shift, w - 1), 1), -1)
            left -= 1
            shift = col[:w - 1] + (col[:w - 1] > at[:, None])
            rank = np.where(shift < w - 1, np.take_along_axis(rank, np.minimum(shift, max(0, w - 2)), 1), NONE)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < w - 1)
            rank[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """One long match; a round takes several places of the least rank."""
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank):
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            # in a run of neighbouring places every second one merges, from the left
            run = np.r_[0, np.cumsum(np.diff(at) > 1)]
            first = np.r_[True, np.diff(run) > 0]
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            # ... up to the first merge that makes a pair of lower rank, which has to go first
            padded = np.r_[-1, ids, -1, -1]
            before = np.where(np.r_[False, np.diff(at) == 2], least, padded[at])
            merged = np.full(len(at), least)
            lower = np.minimum(self.pairs.find(before, merged), self.pairs.find(merged, padded[at + 3])) < least
            if lower.any():
                at = at[:int(lower.argmax()) + 1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            rank = np.append(rank, NONE)[keep][:len(ids) - 1] if len(ids) > 1 else rank[:0]
            at = at - np.arange(len(at))  # places after closing up
            for p in (at - 1, at):
                p = p[(p >= 0) & (p < len(ids) - 1)]
                rank[p] = self.pairs.find(ids[p], ids[p + 1])
        return ids

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts: (all ids, number of each text's ids)."""
        slots: dict[str, int] = _Slots()
        get = slots.__getitem__
        each = [np.fromiter(map(get, self.split.findall(t)), np.int32) for t in texts]
        # no match crosses texts; what the pattern leaves out of a text is no token, as in the library
        known = [self.ranks.get(m.encode("utf-8")) for m in slots]
        rest = [i for i, rank in enumerate(known) if rank is None]
        size = np.ones(len(known), np.int64)
        ids, n = self.merged([m.encode("utf-8") for m, rank in zip(slots, known) if rank is None])
        size[rest] = n
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int32)
        whole = np.array([i for i, rank in enumerate(known) if rank is not None], np.int64)
        flat[begin[whole]] = np.array([rank for rank in known if rank is not None], np.int32)
        if len(rest):
            ends = np.cumsum(n)
            flat[np.arange(ends[-1]) + np.repeat(begin[rest] - (ends - n), n)] = ids
        at = np.concatenate(each) if each else np.zeros(0, np.int32)
        n = size[at]
        out = np.cumsum(n)
        total = int(out[-1]) if len(out) else 0
        ids = flat[np.arange(total) + np.repeat(begin[at] - (out - n), n)]
        ends = np.r_[0, out][np.cumsum([len(x) for x in each], dtype=np.int64)] if each else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends])

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' byte strings one after the other: the value buffer of the gathered array."""
        if not len(ids):
            return b""
        got = self.strings.take(pa.array(ids))
        offsets = np.frombuffer(got.buffers()[1], np.int32)
        return got.buffers()[2][int(offsets[got.offset]):int(offsets[got.offset + len(got)])].to_pybytes()


class _Slots(dict):
    def __missing__(self, match):
        slot = self[match] = len(self)
        return slot


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256
    (the decoded bytes) of every whole text; ``with_ids`` adds the ids themselves."""

    def run(batches):
        bpe = worker_state(f"rankbpe_{path}", lambda: RankBPE(path, pattern))
        for b in batches:
            doc, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in groups_of_bytes([len(t) for t in texts], BATCH_BYTES):
                flat, n = bpe.encode_batch(texts[lo:hi])
                ends = np.cumsum(n)
                parts = [flat[e - k:e] for e, k in zip(ends.tolist(), n.tolist())]
                cols = [pa.array(doc[lo:hi], pa.int64()), pa.array(n, pa.int64()),
                        pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in parts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(parts, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, kind + (", ids array<int>" if with_ids else ""))
