"""Collocations: phrases of two to five words, counted with HAT-tries and scored by their weakest cut.

1. *Chunks.* Each task tokenises its texts into chunks of about ``CHUNK_BYTES``
   and writes, once, a chunk's words as numbers of its own vocabulary and that
   vocabulary with counts. Everything later reads this table.
2. *Words.* One exchange brings a word's counts of all chunks together (one row
   a chunk); words of ``min_count`` occurrences get dense ids, which return,
   packed, to the chunks that hold them. A phrase that is frequent has only
   frequent parts, so all else ends a run of words.
3. *Pairs, then phrases of three to five words* inside runs of frequent pairs,
   both by ``HatTrie``: a shallow trie over word ids (one word deep for pairs,
   two for longer phrases) with hash containers of the phrases' remaining words
   below. Prefixes share prefix partitions of some ``PREFIXES``; one that is
   frequent in the corpus has its own, and its container is burst into buckets
   by the hash of what remains. How many is told by the prefix' count, so all
   tasks burst alike. When a trie holds too many entries, its largest subtrees
   leave whole, as sorted runs. Spark deals the runs by (prefix partition,
   bucket), and a task merges the runs of each.
4. *Scores.* Counts of both parts of every cut are joined to the phrases.

No count is approximate: word ids are unique numbers, not hashes, and products
are decimal. A task holds a chunk, a trie of ``MOST_ENTRIES`` and the runs of one
(prefix partition, bucket): some ``BURST`` different phrases a prefix, or one entry a run.

Ids are 31-bit numbers: more than 2 billion different frequent words end with an error.

Edge cases: null text is empty, null lang is ``und``; a null id matters to nothing; repeated
rows count as often as they occur; texts and pieces of any length are read whole; score ties go to
more occurrences, then to the smaller phrase; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settled

CHUNK_BYTES = 6 << 20
#: Occurrences of a prefix for each bucket of its container.
BURST = 1 << 14
#: Prefixes (that are not burst) of a prefix partition.
PREFIXES = 64
#: Entries of a trie before subtrees leave.
MOST_ENTRIES = 400_000
MOST_WORDS = 5
#: Rows of a batch that leaves a task.
_ROWS = 50_000

_SEPARATORS = re.compile(rb"[.,;:!?\x0a-\x0d]+")


class _Words(dict):
    """Numbers of one language's words in a chunk; b"." (a separator, so never in a word) is -1."""

    def __init__(self, words: list, langs: list, lang: int):
        self.words, self.langs, self.lang = words, langs, lang
        self[b"."] = -1

    def __missing__(self, word):
        slot = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return slot


def _spans(text: bytes, size: int):
    """A text in parts of about ``size`` bytes, cut at separators only."""
    start = 0
    while start < len(text):
        cut = _SEPARATORS.search(text, start + size)
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


def _chunk_rows(chunk: int, spans: list[tuple[str, bytes]]):
    words: list[bytes] = []
    langs: list[int] = []
    names: list[str] = []
    own: dict[str, _Words] = {}
    parts = []
    for lang, text in spans:
        if lang not in own:
            own[lang] = _Words(words, langs, len(names))
            names.append(lang)
        tokens = _SEPARATORS.sub(b" . ", text.lower()).split()
        parts.append(np.fromiter(map(own[lang].__getitem__, tokens), np.int32, len(tokens)))
        parts.append(np.array([-1], np.int32))
    seq = np.concatenate(parts)
    n = np.bincount(seq[seq >= 0], minlength=len(words)).astype(np.int64)
    lang_of = pa.array(names, pa.string()).take(pa.array(np.array(langs, np.int32)))
    word = pa.array(words, pa.binary()).cast(pa.string())
    for s in range(0, len(words), _ROWS):
        k = min(_ROWS, len(words) - s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, chunk, np.int64)), lang_of.slice(s, k), word.slice(s, k), pa.array(np.arange(s, s + k, dtype=np.int32)),
             pa.array(n[s:s + k]), pa.nulls(k, pa.binary())], ["chunk", "lang", "word", "slot", "n", "seq"])
    packed = pa.Codec("zstd").compress(seq.tobytes(), asbytes=True)
    yield pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()),
         pa.array([len(seq)], pa.int64()), pa.array([packed], pa.binary())], ["chunk", "lang", "word", "slot", "n", "seq"])


def chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int | None = None) -> DataFrame:
    """chunk, lang, word, slot, n for the words of each chunk; one row with seq (and its length n) for its text."""
    chunk_bytes = chunk_bytes or CHUNK_BYTES

    def run(batches):
        from pyspark import TaskContext
        chunk, spans, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("body")):
                for span in _spans(text.as_py(), chunk_bytes // 2):
                    spans.append((lang, span))
                    size += len(span)
                    if size >= chunk_bytes:
                        yield from _chunk_rows(chunk, spans)
                        chunk, spans, size = chunk + 1, [], 0
        if spans:
            yield from _chunk_rows(chunk, spans)

    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    return settled(rows.mapInArrow(run, "chunk long, lang string, word string, slot int, n long, seq binary"))


_ANSWERS = "part int, lang string, word string, n long, number int, chunk long, slots binary, numbers binary, buckets binary"


def _answers(min_count: int):
    """Rows (lang, word, chunk, slot, n) ordered by word -> the frequent words, numbered in this task (``part``), and for
    each chunk its frequent words' numbers. A word has one row for each chunk that holds it."""

    def words(rows, part):
        lang, word, n, number = zip(*rows)
        k = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64()),
             pa.array(number, pa.int32()), pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.binary())] * 3], schema=schema)

    def answers(held, part):
        chunk, slot, number, buckets = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(chunk, kind="stable")
        chunk, slot, number, buckets = chunk[order], slot[order], number[order], buckets[order]
        begin = np.flatnonzero(np.r_[True, np.diff(chunk) != 0])
        cuts = [[x.tobytes() for x in np.split(a.astype("<i4"), begin[1:])] for a in (slot, number, buckets)]
        k = len(begin)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.int32()), pa.array(chunk[begin]), *[pa.array(c, pa.binary()) for c in cuts]], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("number", pa.int32()),
                        ("chunk", pa.int64()), ("slots", pa.binary()), ("numbers", pa.binary()), ("buckets", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        part, number = TaskContext.get().partitionId(), 0
        key, total, chunks_, slots = None, 0, [], []  # of the word at hand
        out, held, size = [], [], 0

        def close():
            nonlocal number, size
            if key is not None and total >= min_count:
                out.append((*key, total, number))
                chunk, slot = np.concatenate(chunks_), np.concatenate(slots)
                held.append((chunk, slot, np.full(len(chunk), number), np.full(len(chunk), total // BURST + 1)))
                number, size = number + 1, size + len(chunk)

        for b in batches:
            if not b.num_rows:
                continue
            lang, word = b.column("lang"), b.column("word")
            chunk, slot, n = (b.column(c).to_numpy() for c in ("chunk", "slot", "n"))
            new = [pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False) for x in (lang, word)]
            begin = np.r_[0, np.flatnonzero(new[0] | new[1]) + 1]
            sums = np.add.reduceat(n, begin)
            ends = np.r_[begin[1:], b.num_rows]
            # a word inside the batch that is too rare needs no look; the first and last may go on in other batches
            for i in np.flatnonzero((sums >= min_count) | (begin == 0) | (ends == b.num_rows)).tolist():
                s, e = int(begin[i]), int(ends[i])
                own = (lang[s].as_py(), word[s].as_py())
                if own != key:
                    close()
                    key, total, chunks_, slots = own, 0, [], []
                total += int(sums[i])
                chunks_.append(chunk[s:e])
                slots.append(slot[s:e])
            if len(out) > _ROWS:
                yield words(out, part)
                out = []
            if size > MOST_ENTRIES:
                yield answers(held, part)
                held, size = [], 0
        close()
        if out:
            yield words(out, part)
        if held:
            yield answers(held, part)

    return run


def _hash(columns: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each row of ids."""
    h = np.zeros(len(columns), np.uint64)
    for c in columns.T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class HatTrie:
    """Counts of phrases: prefix partitions, below them prefixes of word ids, below them hash containers of the rest.

    A prefix with more than ``BURST`` occurrences in the corpus is a partition of its own and its container is burst
    into buckets by the rest's hash; the others share ``parts`` partitions by the hash of the prefix."""

    def __init__(self, width: int, most: int, parts: int):
        self.width, self.most, self.parts, self.entries = width, most, parts, 0
        self.tree: dict[tuple[int, int], dict[int, Counter]] = {}

    def add(self, prefix: np.ndarray, buckets: np.ndarray, rest: np.ndarray) -> None:
        """``prefix``: packed ids; ``buckets``: of each prefix in the corpus; ``rest``: (m, width) ids."""
        if not len(prefix):
            return
        bucket = (_hash(rest) % buckets.astype(np.uint64)).astype(np.int64)
        part = np.where(buckets > 1, -1 - prefix, (_hash(prefix[:, None]) % np.uint64(self.parts)).astype(np.int64))
        order = np.lexsort((bucket, prefix))
        prefix, bucket, part, rest = prefix[order], bucket[order], part[order], rest[order]
        begin = np.flatnonzero(np.r_[True, (np.diff(prefix) != 0) | (np.diff(bucket) != 0)])
        keys = np.ascontiguousarray(rest.astype(">u4")).view(f"V{4 * self.width}").ravel().tolist()
        for s, e, at, p in zip(begin.tolist(), np.r_[begin[1:], len(keys)].tolist(),
                               zip(part[begin].tolist(), bucket[begin].tolist()), prefix[begin].tolist()):
            node = self.tree.get(at)
            if node is None:
                node = self.tree[at] = {}
            container = node.get(p)
            if container is None:
                container = node[p] = Counter()
            before = len(container)
            container.update(keys[s:e])
            self.entries += len(container) - before

    def full(self) -> bool:
        return self.entries > self.most

    def leave(self, share: float = 1.0):
        """The largest subtrees, until ``share`` of the entries has left, as sorted runs:
        (part, bucket, (prefix, entries) of each prefix, rests, counts)."""
        size = {at: sum(map(len, node.values())) for at, node in self.tree.items()}
        going, gone = [], 0
        for at in sorted(size, key=size.get, reverse=True):
            if gone >= share * self.entries:
                break
            going.append(at)
            gone += size[at]
        self.entries -= gone
        for at in sorted(going):
            heads, rests, counts = [], [], []
            for p, container in sorted(self.tree.pop(at).items()):
                keys = sorted(container)
                heads += [p, len(keys)]
                rests += keys
                counts += map(container.__getitem__, keys)
            yield *at, np.array(heads, "<i8").tobytes(), b"".join(rests), np.array(counts, "<u4").tobytes()


_RUNS = "part long, bucket long, chunk long, heads binary, rests binary, counts binary"


def _run_batches(rows, chunk: int):
    """Arrow batches of what leaves a trie, a few megabytes each."""
    held, size = [], 0

    def batch():
        p, b, h, r, c = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(p), chunk, np.int64)), pa.array(h, pa.binary()),
             pa.array(r, pa.binary()), pa.array(c, pa.binary())], ["part", "bucket", "chunk", "heads", "rests", "counts"])

    for row in rows:
        held.append(row)
        size += sum(map(len, row[2:])) + 60
        if size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _packed(a: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(np.ascontiguousarray(a).tobytes(), asbytes=True)


def _unpacked(b: pa.RecordBatch, i: int) -> np.ndarray:
    """The sequence of row ``i``: ``n`` numbers of 32 bits."""
    return np.frombuffer(pa.Codec("zstd").decompress(b.column("seq")[i].as_buffer(), 4 * b.column("n")[i].as_py()), np.int32)


def _coded(base: dict[int, int]):
    """Chunks with corpus ids in place of their own numbers (0 ends a run of frequent words), and the buckets of
    their words that have several. ``base``: ids before those of each part."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                seq, got = _unpacked(b, i), b.column("words")[i].as_py()
                ids = np.zeros(int(seq.max(initial=-1)) + 2, np.int32)  # -1 is the last place, which no word has
                hot = []
                for x in got:
                    slot, number, buckets = (np.frombuffer(x[c], "<i4") for c in ("slots", "numbers", "buckets"))
                    own = base[x["part"]] + number + 1
                    ids[slot] = own
                    hot += [{"id": k, "buckets": m} for k, m in zip(own[buckets > 1].tolist(), buckets[buckets > 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk").slice(i, 1), b.column("n").slice(i, 1), pa.array([_packed(ids[seq])], pa.binary()),
                     pa.array([hot], pa.list_(pa.struct([("id", pa.int64()), ("buckets", pa.int64())])))], ["chunk", "n", "seq", "hot"])

    return run


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
    at = order[at]
    return np.where(keys[at] == wanted, values[at], 0)


def _pairs(parts: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, hot = _unpacked(b, i).astype(np.int64), b.column("hot")[i].values
                buckets = np.maximum(1, _looked_up(hot.field("id").to_numpy(), hot.field("buckets").to_numpy(), ids))
                at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                trie = HatTrie(1, MOST_ENTRIES, parts)
                chunk = b.column("chunk")[i].as_py()
                for s in range(0, len(at), 1 << 18):
                    p = at[s:s + (1 << 18)]
                    trie.add(ids[p], buckets[p], ids[p + 1][:, None])
                # a chunk's trie leaves at its end, so that a frequent pair's chunks are known
                yield from _run_batches(trie.leave(), chunk)

    return run


def _long_runs(batches):
    """Sequences with 0 for all words outside runs of three frequent words or more: no longer phrase has them."""
    for b in batches:
        for i in range(b.num_rows):
            ids = _unpacked(b, i)
            some = np.r_[False, False, ids > 0, False, False]
            three = some[:-2] & some[1:-1] & some[2:]  # of the places p, p + 1, p + 2
            keep = three[2:] | three[1:-1] | three[:-2]
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk").slice(i, 1), b.column("n").slice(i, 1), pa.array([_packed(np.where(keep, ids, 0).astype(np.int32))], pa.binary())],
                ["chunk", "n", "seq"])


def _phrases(parts: int):
    def run(batches):
        trie = HatTrie(MOST_WORDS - 2, MOST_ENTRIES, parts)
        for b in batches:
            for i in range(b.num_rows):
                ids = _unpacked(b, i).astype(np.int64)
                got = b.column("pairs")[i].as_py()
                key = np.frombuffer(b"".join(x["pairs"] for x in got), np.int64)
                buckets = np.frombuffer(b"".join(x["buckets"] for x in got), np.int32).astype(np.int64)
                own = np.r_[np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] << 32 | ids[1:], 0), 0]
                own_buckets = _looked_up(key, buckets, own)
                linked = own_buckets > 0
                for start in range(0, len(ids), 1 << 18):
                    p = np.arange(start, min(len(ids), start + (1 << 18)))
                    p = p[linked[p]]
                    for length in range(3, MOST_WORDS + 1):
                        p = p[p + length - 2 < len(ids)]
                        p = p[linked[p + length - 2]]
                        rest = np.zeros((len(p), trie.width), np.int64)
                        for j in range(2, length):
                            rest[:, j - 2] = ids[p + j]
                        trie.add(own[p], own_buckets[p], rest)
                    if trie.full():
                        yield from _run_batches(trie.leave(0.5), -1)
        yield from _run_batches(trie.leave(), -1)

    return run


def _merge(width: int, min_count: int, answer):
    """Merges the sorted runs of each (part, bucket); rows come in that order. ``answer`` makes batches of
    (row, prefix, rest, total) entries of the frequent phrases, a row for each run that has one."""

    def merged(rows: list[tuple]):
        _, _, chunk, heads, rests, counts = zip(*rows)
        head = [np.frombuffer(h, "<i8").reshape(-1, 2) for h in heads]
        sizes = np.array([len(c) // 4 for c in counts], np.int64)
        head_all = np.concatenate(head)
        p = np.repeat(head_all[:, 0], head_all[:, 1])
        rest = np.frombuffer(b"".join(rests), ">u4").reshape(-1, width).astype(np.int64)
        count = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        row = np.repeat(np.array(chunk, np.int64), sizes)
        order = np.lexsort((*rest.T[::-1], p))
        p, rest, count, row = p[order], rest[order], count[order], row[order]
        begin = np.flatnonzero(np.r_[True, (np.diff(p) != 0) | (np.diff(rest, axis=0) != 0).any(1)])
        total = np.add.reduceat(count, begin)
        each = np.diff(np.r_[begin, len(p)])
        keep = np.repeat(total >= min_count, each)
        if keep.any():
            yield from answer(row[keep], p[keep], rest[keep], np.repeat(total, each)[keep], np.repeat(np.arange(len(begin)), each)[keep])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("part", "bucket", "chunk", "heads", "rests", "counts"))):
                if size > 8 << 20 and held[-1][:2] != r[:2]:
                    yield from merged(held)
                    held, size = [], 0
                held.append(r)
                size += sum(map(len, r[3:]))
        if held:
            yield from merged(held)

    return run


def _phrase_rows(row, prefix, rest, total, phrase):
    """Each phrase once: ids (the prefix unpacked, zeros are no ids), n."""
    first = np.flatnonzero(np.r_[True, np.diff(phrase) != 0])
    ids = np.concatenate([(prefix[first] >> 32)[:, None], (prefix[first] & 0xFFFFFFFF)[:, None], rest[first]], 1)
    for s in range(0, len(ids), _ROWS):
        part = ids[s:s + _ROWS]
        ends = np.r_[0, np.cumsum((part > 0).sum(1))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(part[part > 0])), pa.array(total[first][s:s + _ROWS])], ["ids", "n"])


def _pair_rows(row, prefix, rest, total, phrase):
    """A row with all frequent pairs (chunk -1), and one for each chunk with those that it has."""
    pair, buckets = prefix << 32 | rest[:, 0], (total // BURST + 1).astype(np.int32)
    first = np.r_[True, np.diff(phrase) != 0]
    order = np.argsort(row, kind="stable")
    begin = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
    rows = [(-1, pair[first].tobytes(), total[first].astype("<i8").tobytes())]
    rows += [(int(row[x[0]]), pair[x].tobytes(), buckets[x].tobytes()) for x in np.split(order, begin[1:])]
    for s in range(0, len(rows), 1000):
        c, p, n = zip(*rows[s:s + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(p, pa.binary()), pa.array(n, pa.binary())], ["chunk", "pairs", "buckets"])


def _unpack_pairs(batches):
    for b in batches:
        for p, n in zip(b.column("pairs").to_pylist(), b.column("buckets").to_pylist()):
            pair = np.frombuffer(p, "<i8")
            ids = np.stack([pair >> 32, pair & 0xFFFFFFFF], 1)
            ends = np.arange(0, 2 * len(ids) + 1, 2, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.ravel())), pa.array(np.frombuffer(n, "<i8"))], ["ids", "n"])


def _merged(runs: DataFrame, run, schema: str) -> DataFrame:
    return runs.repartition("part", "bucket").sortWithinPartitions("part", "bucket").mapInArrow(run, schema)


def phrase_counts(docs: DataFrame, min_count: int = 100, text_col: str = "text", lang_col: str = "lang",
                  chunk_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): ids, n of the phrases of one to five words with ``min_count`` occurrences
    or more; lang, word, n, id of the words; lang, total of all word occurrences."""
    table = chunks(docs, text_col, lang_col, chunk_bytes)
    totals = settled(table.where("seq is null").groupBy("lang").agg(F.sum("n").alias("total")))
    rows = table.where("seq is null").select("lang", "word", "chunk", "slot", "n")
    got = settled(rows.repartition("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(_answers(min_count), _ANSWERS))
    base, count = {}, 0
    for part, k in sorted(got.where("chunk is null").groupBy("part").count().collect()):  # a row for each task
        base[part], count = count, count + k
    if count >= 1 << 31:
        raise ValueError("more than 2^31 - 1 frequent words")
    shift = F.broadcast(table.sparkSession.createDataFrame(list(base.items()), "part int, base long"))
    words = settled(got.where("chunk is null").join(shift, "part").select(
        "lang", "word", "n", (F.col("base") + F.col("number") + 1).alias("id")))
    slots = got.where("chunk is not null").groupBy("chunk").agg(
        F.collect_list(F.struct("part", "slots", "numbers", "buckets")).alias("words"))  # one chunk's vocabulary
    coded = settled(table.where("seq is not null").select("chunk", "n", "seq").join(slots, "chunk").mapInArrow(
        _coded(base), "chunk long, n long, seq binary, hot array<struct<id: long, buckets: long>>"))
    forget(got)
    forget(table)
    parts = 1 + words.count() // PREFIXES
    pairs = settled(_merged(coded.mapInArrow(_pairs(parts), _RUNS), _merge(1, min_count, _pair_rows), "chunk long, pairs binary, buckets binary"))
    two = settled(pairs.where("chunk = -1").mapInArrow(_unpack_pairs, "ids array<long>, n long"))
    by_chunk = pairs.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("pairs", "buckets")).alias("pairs"))
    runs = coded.select("chunk", "n", "seq").mapInArrow(_long_runs, "chunk long, n long, seq binary").join(by_chunk, "chunk")
    parts = 1 + two.count() // PREFIXES
    longer = _merged(runs.mapInArrow(_phrases(parts), _RUNS), _merge(MOST_WORDS - 2, min_count, _phrase_rows), "ids array<long>, n long")
    phrases = settled(words.select(F.array("id").alias("ids"), "n").union(two).union(longer))
    forget(coded, pairs, two)
    return phrases, words, totals


def collocations(docs: DataFrame, min_count: int = 100, absorb_per_cent: int = 100, top: int = 2000, text_col: str = "text",
                 lang_col: str = "lang", chunk_bytes: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    A phrase whose words lie inside a longer frequent one with ``absorb_per_cent`` of its occurrences or more is left out."""
    phrases, words, totals = phrase_counts(docs, min_count, text_col, lang_col, chunk_bytes)
    own = phrases.where("size(ids) > 1").withColumnRenamed("n", "a")
    inside = (own.where("size(ids) > 2").select("a", F.explode(F.expr(
        "flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), s -> slice(ids, s, k))))")).alias("ids"))
        .groupBy("ids").agg(F.max("a").alias("longer")))
    kept = own.join(inside, "ids", "left").where(f"longer is null or 100 * longer < {absorb_per_cent} * a").drop("longer")
    head = words.select(F.col("id").alias("_first"), "lang")
    kept = (kept.withColumn("_first", F.col("ids")[0]).join(head, "_first").drop("_first")
            .join(totals.withColumnRenamed("total", "n"), "lang"))
    cuts = kept.select("*", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cuts = (cuts.join(phrases.select(F.col("ids").alias("left"), F.col("n").alias("l")), "left")
            .join(phrases.select(F.col("ids").alias("right"), F.col("n").alias("r")), "right"))
    score = "cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)"
    scored = (cuts.groupBy("ids", "lang", "a", "n").agg(F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut"))
              .select("ids", "lang", "a", "n", "cut.*"))
    text = (scored.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids")
            .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled")))  # five words at most
    scored = settled(scored.join(text, "ids").withColumn("phrase", F.expr("array_join(spelled.word, ' ')")).drop("ids", "spelled", "k"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # each language's best of each part, then the best of those: no task sorts a whole language
    parts = 1 + scored.count() // 50_000
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
