"""Ids of whole texts by a tokenizers file, one encoding per distinct piece.

The tokenizers used here never join characters across ASCII white space (the
file drops it), so a text's ids are those of its white-space-separated pieces
one after the other. Pieces repeat; each distinct one is encoded once per
worker and its ids are gathered with numpy.

A file that lower-cases and splits as ``NORMALIZER`` and ``SPLIT`` say gives a
piece of printable ASCII and Latin-1 letters the ids of its parts (word,
digit, run of signs) one after the other. Parts repeat far more than pieces
do, so the library's model is asked once for each distinct part. All other
pieces, and those of all other files, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import worker_state

#: Bytes that a worker's table may hold; past it the table starts anew (memory only, not results).
KEEP_BYTES = 160 << 20
#: Bytes of a piece in the table besides its own (objects, the dictionary's place, ids).
_OVERHEAD = 140
#: Bytes that a worker's table of parts may hold, and pieces given to the library at a time.
PART_BYTES, BATCH = 96 << 20, 10_000
_PART_OVERHEAD = 220

#: The normaliser and pre-tokeniser whose parts are known here. On the characters of ``_PLAIN``
#: NFC and the white-space rule change nothing, and every part but a contraction is a maximal run of its kind.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
          "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class _Pieces(dict):
    def __init__(self):
        self.new: list = []

    def __missing__(self, piece):
        slot = self[piece] = len(self)
        self.new.append(piece)
        return slot


class PieceTable:
    """piece -> ids. ``encode`` takes a list of new pieces and gives their id lists in order."""

    def __init__(self, encode):
        self.encode = encode
        self._clear()

    def _clear(self):
        self.slots, self.flat, self.size = _Pieces(), array("I"), array("I")
        self.view, self.held = None, 0

    def rows(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts given as lists of pieces: (all ids, ids in each text)."""
        if self.held > KEEP_BYTES:
            self._clear()
        get = self.slots.__getitem__
        each = [np.fromiter(map(get, x), np.int32, len(x)) for x in split]
        if self.slots.new:
            self.held += sum(map(len, self.slots.new)) + _OVERHEAD * len(self.slots.new)
            for ids in self.encode(self.slots.new):
                self.flat.extend(ids)
                self.size.append(len(ids))
            self.slots.new.clear()
            self.view = None
        if self.view is None:
            size = np.array(self.size, np.int64)
            self.view = np.array(self.flat, np.uint32), np.cumsum(size) - size, size
        flat, begin, size = self.view
        at = np.concatenate(each) if each else np.zeros(0, np.int32)
        n = size[at]
        out = np.cumsum(n)
        ids = flat[np.arange(out[-1] if len(out) else 0) + np.repeat(begin[at] - (out - n), n)]
        ends = np.r_[0, out][np.cumsum([len(x) for x in each], dtype=np.int64)] if each else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends])


class _Parts(dict):
    """part -> its ids by the library's model; starts anew past ``PART_BYTES``."""

    def __init__(self, model):
        from .bpe import printable_bytes
        self.tokens, self.chars, self.held = model.tokenize, printable_bytes(), 0

    def __missing__(self, part):
        if self.held > PART_BYTES:
            self.clear()
            self.held = 0
        shown = part if part.isascii() else "".join(map(self.chars.__getitem__, part.encode("utf-8")))
        ids = self[part] = array("I", [t.id for t in self.tokens(shown)])
        self.held += _PART_OVERHEAD + len(part) + 4 * len(ids)
        return ids


def _has_known_parts(spec: dict) -> bool:
    norm, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    return (norm.get("type") == split.get("type") == "Sequence" and norm["normalizers"] == NORMALIZER
            and split["pretokenizers"] == SPLIT and spec["model"].get("type") == "BPE"
            and not spec["model"].get("ignore_merges") and spec["model"].get("dropout") is None
            and not any(t["normalized"] for t in spec["added_tokens"]))


def _library_table(path: str) -> PieceTable:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def whole(texts):
        for i in range(0, len(texts), BATCH):
            yield from (x.ids for x in tok.encode_batch_fast(texts[i:i + BATCH], add_special_tokens=False))

    if not _has_known_parts(spec):
        return PieceTable(lambda pieces: whole([p.decode("utf-8") for p in pieces]))
    parts = _Parts(tok.model)
    added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")

    def encode(pieces):
        texts = [p.decode("utf-8") for p in pieces]
        plain = [_PLAIN.fullmatch(t) and not added.search(t) for t in texts]
        others = whole([t for t, p in zip(texts, plain) if not p])
        for t, p in zip(texts, plain):
            if p:
                first, *rest = _PARTS.findall(t.lower())
                ids = parts[first]
                for x in rest:
                    ids = ids + parts[x]
                yield ids
            else:
                yield next(others)

    return PieceTable(encode)


def encode_texts(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (UTF-8): (all ids, ids in each text)."""
    t = worker_state(f"pieces_{path}", lambda: _library_table(path))
    return t.rows([x.split() for x in texts])


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` appended to each text's ids."""
    out = np.insert(ids, np.cumsum(n), end) if len(n) else ids
    return out, n + 1


def groups_of_bytes(sizes, limit: int):
    """Slices of consecutive items of about ``limit`` bytes, one item at least."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
