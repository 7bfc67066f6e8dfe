"""Repeated substrings across documents, by a distributed difference-cover sort.

A byte is removed if a ``length``-byte string that covers it also starts in a
document with a smaller id. Only the first ``length`` bytes of a suffix matter,
which bounds the depth of the suffix sort.

1. *Screen.* The least hash among the ``GRAM``-byte strings of a window marks
   it; equal windows have equal marks. Chunks ask which marks occur in a second
   document; windows whose mark doesn't are unique, and leave.
2. *Sample.* Of what is left, positions p with p mod 13 in the difference
   cover {0, 1, 3, 9} are sampled: for any two positions i, j there is a shift
   d < 13 with i + d and j + d both sampled. The sampled triples (three symbols
   of 13, 13 and 12 bytes) are dealt by hash, and the hash is the name: equal
   triples are wanted, not their lexicographic order. The depth is bounded, so one level of names is deep enough
   and the recursion ends here: name + 12 bytes of either side is all of
   every window that the sampled position serves.
3. *Group.* Window i is hashed from (bytes up to i + d, name of i + d, bytes
   after), once for each of the thirteen shifts; two equal windows meet at the
   shift that the difference cover promises. Windows of equal hashes are taken
   for one string (the bytes are not compared), and all but its smallest
   document lose it.

Whole texts that a smaller id repeats byte for byte lose everything at once and
take no part in the sort; equal samples of a chunk are sent once. No task holds
more than its chunk or its share of the names.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing;
equal ids are no reason to remove (only a smaller id is); null ids sort after
all others and among themselves lose nothing; repeats inside one document
stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import bodies, chunked, key_array, key_bytes
from .setjoin import chunk_order, chunk_rows, mix, part_of
from .tokens import groups_of_bytes

LENGTH = 50
PERIOD = 13
COVER = (0, 1, 3, 9)
GRAM = 32
#: Text hashed at a time: keeps the arrays in cache.
SPAN_BYTES = 1 << 19
PART_KEYS = 2_000_000
MAIL = "chunk int, kind int, part int, a binary, b binary, c binary, d binary"
ASK = "part int, chunk int, a binary, b binary, c binary, d binary"
NO_ID = (1 << 63) - 1

_C = np.uint64(0x9E3779B97F4A7C15)


def _zip(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unzip(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", kind)


def gram_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position (of fewer at the end), by doubling."""
    with np.errstate(over="ignore"):
        power = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _C)[raw]
        out, done, width = None, 0, 1
        n = len(raw)
        while True:
            if length & width:
                if out is None:
                    out = power.copy()
                else:
                    out *= _C
                    out[: max(0, n - done)] += power[done:]
                    out ^= out >> np.uint64(29)
                done += width
            width *= 2
            if width > length:
                return mix(out)
            step = power * np.uint64(0xD6E8FEB86659FD93)
            step[: max(0, n - width // 2)] += power[width // 2:]
            power = step ^ (step >> np.uint64(32))


def window_marks(raw: np.ndarray) -> np.ndarray:
    """The least GRAM hash inside the LENGTH bytes from each position."""
    h, width, over = gram_hashes(raw, GRAM), 1, LENGTH - GRAM + 1
    while width * 2 <= over:
        h[: len(h) - width] = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    rest = over - width
    if rest:
        h[: len(h) - rest] = np.minimum(h[: len(h) - rest], h[rest:])
    return h


def _spans(texts: list[bytes]):
    """Consecutive texts of about SPAN_BYTES that can hold a window: (first, raw, sizes, starts, doc, valid)."""
    for lo, hi in groups_of_bytes([len(t) for t in texts], SPAN_BYTES):
        sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
        if sizes.max(initial=0) < LENGTH:
            continue
        raw = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        doc = np.repeat(np.arange(hi - lo), sizes)
        starts = np.cumsum(sizes) - sizes
        valid = np.arange(len(raw)) <= (starts + sizes - LENGTH)[doc]
        yield lo, raw, sizes, starts, doc, valid


def _runs(marks: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where a run of equal marks in one document begins."""
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (doc[1:] != doc[:-1])
    return np.flatnonzero(new)


def _split_by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[bounds[p]:bounds[p + 1]]) for p in range(parts) if bounds[p + 1] > bounds[p]]


def _frame(rows: list[tuple], names: str) -> pa.Table:
    fields = [(x.split()[0], pa.int32() if x.split()[1] == "int" else pa.binary()) for x in names.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [f for f, _ in fields])


def _copies(docs: DataFrame) -> DataFrame:
    """Mail (kind 4): id and MD5 of every text of LENGTH bytes or more that a smaller id has too."""
    rows = docs.filter(F.octet_length("body") >= LENGTH).select("chunk", "doc_id", F.unhex(F.md5("body")).alias("md5"))
    least = rows.groupBy("md5").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    gone = rows.join(least, "md5").filter("least is not null and (doc_id is null or doc_id > least)")
    none = F.lit(None).cast("binary")
    return gone.select((F.col("chunk") + 0).alias("chunk"), F.lit(4).alias("kind"), F.lit(0).alias("part"), "md5",
                       F.coalesce("doc_id", F.lit(NO_ID)).cast("string").cast("binary").alias("b"), none.alias("c"), none.alias("d")) \
        .withColumnRenamed("md5", "a")


def _whole_copies(ids: list, texts: list[bytes], mail: pa.Table) -> set[int]:
    """Places of the chunk's texts that are copies."""
    told = {(b, a) for kind, a, b in zip(*(mail.column(c).to_pylist() for c in ("kind", "a", "b"))) if kind == 4}
    wanted = {b for b, _ in told}
    key = [b"%d" % (NO_ID if d is None else d) for d in ids]
    return {i for i, k in enumerate(key) if k in wanted and (k, hashlib.md5(texts[i]).digest()) in told}


def _without(texts: list[bytes], copies: set[int]) -> list[bytes]:
    return [b"" if i in copies else t for i, t in enumerate(texts)] if copies else texts


def _chunk_marks(ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks of a chunk, sorted, and whether two of its documents hold them."""
    marks, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, raw, _, _, doc, valid in _spans(texts):
        at = np.flatnonzero(valid)
        m, d = window_marks(raw)[at], doc[at]
        r = _runs(m, d)
        marks.append(m[r])
        docs.append(d[r] + lo)
    marks, docs = np.concatenate(marks), np.concatenate(docs)
    order = np.argsort(marks)
    marks, docs = marks[order], docs[order]
    at = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]]) if len(marks) else np.zeros(0, np.int64)
    if not len(at):
        return marks, np.zeros(0, bool)
    return marks[at], np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)


def _ask_marks(parts: int):
    def ask(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _frame([], ASK)
        chunk = docs.column("chunk")[0].as_py()
        ids, texts = chunk_rows(docs)
        keys, several = _chunk_marks(ids, _without(texts, _whole_copies(ids, texts, mail)))
        return _frame([(p, chunk, key_bytes(keys[o], 5), np.packbits(several[o]).tobytes(), None, None)
                       for p, o in _split_by_part(part_of(keys, parts), parts)], ASK)
    return ask


def _answer_marks(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    keys = [key_array(x, 5) for x in table.column("a").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("b").to_pylist(), keys)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    repeated = np.bincount(inverse, weights=1 + np.concatenate(several))[inverse] > 1
    cut = np.split(repeated, np.cumsum([len(k) for k in keys])[:-1])
    return _frame([(c, 0, part, np.packbits(x).tobytes(), None, None, None) for c, x in zip(chunks, cut)], MAIL)


def _chunk_samples(ids: list, texts: list[bytes], repeated: np.ndarray):
    """Sampled positions of the windows whose mark is in ``repeated`` (sorted): document, place
    in it, name hash, 24 context bytes, and a bit for each shift whose window is left."""
    name_length = LENGTH - PERIOD + 1
    shifts = np.arange(PERIOD)
    out = []
    for lo, raw, sizes, starts, doc, valid in _spans(texts):
        marks = window_marks(raw)
        at = np.flatnonzero(valid)
        runs = _runs(marks[at], doc[at])
        m = marks[at][runs]
        k = np.searchsorted(repeated, m)
        hit = np.zeros(len(m), bool)
        hit[k < len(repeated)] = repeated[k[k < len(repeated)]] == m[k < len(repeated)]
        live = np.zeros(len(raw) + PERIOD, bool)
        live[at + PERIOD] = np.repeat(hit, np.diff(np.r_[runs, len(at)]))  # live[p + PERIOD]: window p is left
        if not hit.any():
            continue
        place = np.arange(len(raw)) - starts[doc]
        covered = np.cumsum(live)
        near = covered[PERIOD:] - np.r_[0, covered[:-1]][1:len(raw) + 1] > 0  # a window p - 12 .. p is left
        sampled = np.isin(place % PERIOD, COVER) & near
        p = np.flatnonzero(sampled)
        bits = np.zeros(len(p), np.uint16)
        for d in shifts:
            inside = live[p - d + PERIOD] & (place[p] >= d)
            bits |= inside.astype(np.uint16) << np.uint16(d)
        some = bits > 0
        p, bits = p[some], bits[some]
        context = np.zeros((len(p), 2 * (PERIOD - 1)), np.uint8)
        left, right = place[p], sizes[doc[p]] - place[p]
        for j in range(1, PERIOD):
            ok = left >= j
            context[ok, PERIOD - 1 - j] = raw[p[ok] - j]
            ok = right > name_length + j - 1
            context[ok, PERIOD - 2 + j] = raw[p[ok] + name_length + j - 1]
        names = gram_hashes(raw, name_length)[p]
        out.append((doc[p] + lo, place[p], names, context, bits))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), np.zeros((0, 2 * (PERIOD - 1)), np.uint8), z.astype(np.uint16)
    return tuple(np.concatenate(x) for x in zip(*out))


def _twelve(context: np.ndarray, shift: int) -> np.ndarray:
    """Hash of a window's bytes around the name: the ``shift`` before it, the rest after."""
    words = np.ascontiguousarray(context[:, PERIOD - 1 - shift:2 * (PERIOD - 1) - shift]).view("<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix((words[:, 0] << np.uint64(32) | words[:, 1]) * _C + mix(words[:, 2] * _C + np.uint64(1)))


def _ask_names(mark_parts: int, parts: int):
    """Sends the chunk's different samples to the parts, and itself (part -1 - chunk) what it needs
    to read the answers."""

    def ask(docs: pa.Table, mail: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _frame([], ASK)
        chunk = docs.column("chunk")[0].as_py()
        ids, texts = chunk_rows(docs)
        texts = _without(texts, _whole_copies(ids, texts, mail))
        keys, _ = _chunk_marks(ids, texts)
        repeated = np.zeros(len(keys), bool)
        got = {p: a for kind, p, a in zip(*(mail.column(c).to_pylist() for c in ("kind", "part", "a"))) if kind == 0}
        for p, o in _split_by_part(part_of(keys, mark_parts), mark_parts):
            repeated[o] = np.unpackbits(np.frombuffer(got[p], np.uint8), count=len(o))
        doc, place, name, context, bits = _chunk_samples(ids, texts, keys[repeated])
        del texts
        # equal samples (62 bytes, same windows left): the smallest document's is sent
        owner = np.array([NO_ID if d is None else d for d in ids], np.int64)[doc]
        wide = np.ascontiguousarray(context).view("<u8").astype(np.uint64) if len(doc) else np.zeros((0, 3), np.uint64)
        with np.errstate(over="ignore"):
            same = mix(name + mix(wide[:, 0] * _C + mix(wide[:, 1] + mix(wide[:, 2] + bits.astype(np.uint64) * _C))))
        order = np.lexsort((owner, same))
        first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        lead = np.repeat(order[first], np.diff(np.r_[first, len(order)]))
        leader = np.empty(len(order), np.int64)
        leader[order] = lead
        sent = np.sort(order[first])
        rows = []
        part = part_of(name[sent], parts)
        for p, o in _split_by_part(part, parts):
            k = sent[o]
            rows.append((p, chunk, key_bytes(name[k], 6), _zip(context[k]), _zip(owner[k]), _zip(bits[k])))
        slot = np.full(len(doc), -1, np.int64)
        slot[sent] = np.arange(len(sent))
        rows.append((-1 - chunk, chunk, _zip(np.stack([doc, place]).astype("<u4")), _zip(part.astype("<u2")),
                     _zip(slot[leader].astype("<u4")), _zip(np.stack([bits, (owner > owner[leader]).astype(np.uint16)]))))
        return _frame(rows, ASK)
    return ask


def _answer_names(table: pa.Table) -> pa.Table:
    """For every sample, the shifts whose window also starts in a document with a smaller id."""
    part = table.column("part")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    if part < 0:  # a chunk's own layout, on its way back
        return _frame([(c, 2, part, *row) for c, *row in zip(chunks, *(table.column(x).to_pylist() for x in "abcd"))], MAIL)
    names = [key_array(x) for x in table.column("a").to_pylist()]
    sizes = [len(x) for x in names]
    name = np.concatenate(names)
    context = np.concatenate([_unzip(x, np.uint8) for x in table.column("b").to_pylist()]).reshape(-1, 2 * (PERIOD - 1))
    owner = np.concatenate([_unzip(x, np.int64) for x in table.column("c").to_pylist()])
    bits = np.concatenate([_unzip(x, np.uint16) for x in table.column("d").to_pylist()])
    order = np.argsort(name)  # sorted triples: equal neighbours share a name
    start = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    low, high = np.minimum.reduceat(owner[order], start), np.maximum.reduceat(owner[order], start)
    live = order[np.repeat(low != high, np.diff(np.r_[start, len(order)]))]
    gone = np.zeros(len(name), np.uint16)
    for d in range(PERIOD):
        k = live[bits[live] >> np.uint16(d) & 1 == 1]
        if not len(k):
            continue
        with np.errstate(over="ignore"):
            window = mix(name[k] * _C ^ _twelve(context[k], d))
        o = np.argsort(window)
        w, own = window[o], owner[k][o]
        start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        least = np.repeat(np.minimum.reduceat(own, start), np.diff(np.r_[start, len(w)]))
        later = k[o][own > least]
        gone[later] |= np.uint16(1 << d)
    cut = np.split(gone, np.cumsum(sizes)[:-1])
    return _frame([(c, 1, part, _zip(x), None, None, None) for c, x in zip(chunks, cut)], MAIL)


def removed_masks(texts: list[bytes], mail: list[tuple]) -> dict[int, np.ndarray]:
    """Document -> mask of its removed bytes, from a chunk's layout and answers."""
    layout = next(((a, b, c, d) for kind, _, a, b, c, d in mail if kind == 2), None)
    if layout is None:
        return {}
    doc, place = _unzip(layout[0], "<u4").reshape(2, -1).astype(np.int64)
    part, slot = _unzip(layout[1], "<u2"), _unzip(layout[2], "<u4").astype(np.int64)
    bits, copy = _unzip(layout[3], np.uint16).reshape(2, -1)
    answers = np.zeros(len(part), np.uint16)
    got = {p: a for kind, p, a, *_ in mail if kind == 1}
    order = np.argsort(part, kind="stable")
    if got:
        answers[order] = np.concatenate([_unzip(got[p], np.uint16) for p in sorted(got)])
    gone = answers[slot] | np.where(copy == 1, bits, 0).astype(np.uint16)
    out: dict[int, np.ndarray] = {}
    hit = np.flatnonzero(gone)
    ends = np.searchsorted(doc[hit], np.arange(len(texts) + 1))  # samples stand in document order
    for d in np.unique(doc[hit]).tolist():
        k = hit[ends[d]:ends[d + 1]]
        step = np.zeros(len(texts[d]) + 1, np.int32)
        for s in range(PERIOD):
            i = place[k][gone[k] >> np.uint16(s) & 1 == 1] - s
            step[np.unique(i)] = 1
        starts = np.flatnonzero(step)
        change = np.zeros(len(texts[d]) + 1, np.int32)
        change[starts] += 1
        np.subtract.at(change, starts + LENGTH, 1)
        out[d] = np.cumsum(change[:-1]) > 0
    return out


def _masks(docs: DataFrame, finish, schema, id_col: str, text_col: str, *more) -> DataFrame:
    rows, _, total = chunked(bodies(docs, id_col, text_col, *more))
    mark_parts = max(1, min(60_000, -(-(total // 10) // PART_KEYS)))
    name_parts = max(1, min(60_000, -(-(total // 12) // PART_KEYS)))
    copies = _copies(rows)
    asks = rows.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(_ask_marks(mark_parts), ASK)
    marks = asks.groupBy("part").applyInArrow(_answer_marks, MAIL).unionByName(copies)
    sent = rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_ask_names(mark_parts, name_parts), ASK)
    names = sent.groupBy("part").applyInArrow(_answer_names, MAIL).unionByName(copies)
    return rows.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(finish, schema)


def _mail_rows(mail: pa.Table) -> list[tuple]:
    return list(zip(*(mail.column(c).to_pylist() for c in ("kind", "part", "a", "b", "c", "d"))))


def _cuts(docs: pa.Table, mail: pa.Table):
    ids, texts = chunk_rows(docs)
    copies = _whole_copies(ids, texts, mail)
    masks = removed_masks(_without(texts, copies), _mail_rows(mail))
    for i, (d, t) in enumerate(zip(ids, texts)):
        mask = masks.get(i)
        if i in copies:
            yield d, len(t), len(t), 1, b""
        elif mask is None:
            yield d, len(t), 0, 0, t
        else:
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
            yield d, len(t), int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()), kept


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes) and
    kept_sha256 of every document."""

    def finish(rows: pa.Table, mail: pa.Table) -> pa.Table:
        out = [(*r, hashlib.sha256(r[4]).hexdigest()) for r in _cuts(rows, mail)] if rows.num_rows else []
        cols = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)],
                        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _masks(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string",
                  id_col, text_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``substring_dedup`` without the kept bytes."""
    return substring_dedup(docs, id_col, text_col).drop("kept")


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with the repeated strings cut out of the text; ``n_chars``, where the
    table has it, counts the new text. Rows that lose nothing are passed on unchanged.

    The rows travel whole with their texts, so the texts are shuffled once and no join finds the rows again."""
    # the other columns are one struct, so that none of theirs can be taken for one of ours
    others = F.struct(F.col(text_col).isNull().alias("none"), F.struct(*(c for c in docs.columns if c != text_col)).alias("row"))
    row = docs.select(others.alias("doc")).schema["doc"].dataType["row"].dataType

    def finish(rows: pa.Table, mail: pa.Table) -> pa.Table:
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("body").to_pylist()
        doc = rows.column("doc").take(pa.array(chunk_order(ids, texts), pa.int64())).combine_chunks()
        del ids, texts
        cut, new = [], []
        for gone, kept in ((gone, kept) for _, _, gone, _, kept in (_cuts(rows, mail) if rows.num_rows else ())):
            cut.append(gone > 0)
            new.append(kept.decode("utf-8", "ignore").encode("utf-8") if gone else kept)
        texts = pa.array([None if none else t for t, none in zip(new, doc.field("none").to_pylist())], pa.binary())
        return pa.table([texts.view(pa.string()), pa.array(cut, pa.bool_()), doc.field("row")], ["text", "cut", "row"])

    schema = StructType([StructField("text", StringType()), StructField("cut", BooleanType()), StructField("row", row)])
    out = _masks(docs, finish, schema, id_col, text_col, others.alias("doc"))
    columns = {text_col: F.col("text").alias(text_col)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        columns["n_chars"] = F.when(F.col("cut"), F.length("text").cast(kind)).otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return out.select([columns.get(c, F.col("row")[c].alias(c)) for c in docs.columns])
