"""Byte-level BPE encoding and decoding.

A pre-token's bytes form a doubly linked list of symbols. A heap holds the
mergeable neighbours by (merge rank, position); the least is taken, skipped if
stale (one of its symbols is gone or was merged since), else its right symbol
is unlinked and the pairs with the new neighbours are pushed. Decoding
concatenates the vocabulary strings of the ids.

A text is cut into units at single spaces, each distinct unit is split into
pre-tokens and merged once per worker, and ids are gathered with numpy. A text
that holds three or more white-space characters in a row is split as a whole,
as there a space does not always begin a pre-token.

Edge cases: null text is empty (no ids, empty decoded text); texts of any
length are encoded whole; repeated rows give repeated results; an empty table
gives an empty result. The end-of-text string in a text becomes its own id, as
in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state
from .tokens import PieceTable, groups_of_bytes

#: Fixed value: how byte-level BPE files split text (white space spelled as the Unicode property).
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def printable_bytes() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary: itself if printable,
    else the next unused one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = printable_bytes()
        back = {c: b for b, c in chars.items()}
        self.byte_id = {b: vocab[c] for b, c in chars.items() if c in vocab}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.text = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t.encode("utf-8") for t, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        left, right, merge = list(range(-1, n - 1)), [*range(1, n), -1], self.merge
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, whole, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: a neighbour was merged meanwhile
            ids[i], ids[j] = whole, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if m := merge.get((whole, ids[k])):
                    heapq.heappush(heap, (*m, i, whole, ids[k]))
            h = left[i]
            if h >= 0 and (m := merge.get((ids[h], whole))):
                heapq.heappush(heap, (*m, h, ids[h], whole))
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        out: list[int] = []
        for piece in self.split.findall(text):
            ids = self.known.get(piece)
            if ids is None:
                if len(self.known) > 400_000:
                    self.known.clear()
                ids = self.merged(piece.encode("utf-8"))
                if len(piece) <= 40:
                    self.known[piece] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        parts = self.apart.split(text) if self.special else [text]
        return [i for p in parts if p for i in ([self.special[p]] if p in self.special else self.plain(p))]

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


_RUN = re.compile(r"\s{3}")


def _table(path: str):
    bpe = ByteBPE(path)
    return bpe, PieceTable(lambda units: [bpe.encode(u) for u in units])


def units(text: str) -> list[str]:
    """Parts that split into pre-tokens as the whole text does."""
    if _RUN.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + r for r in rest]]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and
    decoded_sha256 (the decoded text in UTF-8) of every whole text."""

    def run(batches):
        for b in batches:
            doc, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            bpe, table = worker_state(f"bpe_{path}", lambda: _table(path), "bpe")
            strings = worker_state(f"strings_{path}", lambda: _strings(bpe), "bpe")
            for lo, hi in groups_of_bytes([len(t) for t in texts], 6 << 20):
                flat, n = table.rows([units(t) for t in texts[lo:hi]])
                ends = np.cumsum(n)
                rows = []
                for d, s, e in zip(doc[lo:hi], (ends - n).tolist(), ends.tolist()):
                    ids = flat[s:e]
                    raw = _join(strings, ids).decode("utf-8", "replace").encode("utf-8")
                    rows.append((d, e - s, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                                 hashlib.sha256(raw).hexdigest()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _strings(bpe: ByteBPE) -> pa.Array:
    """Vocabulary strings by id."""
    return pa.array([bpe.text.get(i) for i in range(max(bpe.text) + 1)], pa.binary())


def _join(strings: pa.Array, ids: np.ndarray) -> bytes:
    """The ids' vocabulary strings one after the other: the value buffer of the gathered array."""
    if not len(ids):
        return b""
    got = strings.take(pa.array(ids))
    offsets = np.frombuffer(got.buffers()[1], np.int32)
    return got.buffers()[2][int(offsets[got.offset]):int(offsets[got.offset + len(got)])].to_pybytes()
