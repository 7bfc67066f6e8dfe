"""Exact n-gram Jaccard join with set-relation skipping.

A document's set is its distinct word n-grams. Pairs with
100 * |A & B| >= per_cent * |A | B| are links; the result is the component of
each document under the links and, in ``jaccard_join``, the number of its links.

1. Every chunk asks how many documents hold each of its n-grams. The answers
   give one corpus-wide order, rare first, and each set keeps a *prefix* in
   that order that any linked set must meet. N-grams of one document are left
   out: they meet nobody.
2. Equal sets are one set from here on (one representative, any number of
   copies).
3. The prefixes form index lists. A list is cut into blocks by set size, and
   a probe reads its own and the two neighbouring blocks only; within them the
   positions bound the largest possible overlap, and entries that can't reach
   the threshold are skipped, as are pairs that meet in a list shortly before.
4. One set of each list is probed first; each set keeps a set it was linked with, its
   *reference* r (the one with the most links), and its difference from it (what it
   has beyond r, and what it lacks of r). Answers are then derived from the
   reference's: |y & z| = |r| - |r-y| - |r-z| + |(r-y) & (r-z)| + |(y-r) & (z-r)|, four
   small differences. ``jaccard_join`` counts the links among the sets of one reference
   from these alone, block against block, and makes no row for a pair. Where y and z
   were compared with the same set and their distances to it differ by more than the
   limit, the pair is out, as Jaccard distance is a metric. Only sets of different
   references are intersected as a whole, so no link is left out.
5. ``jaccard_components`` needs no link inside a known component: it probes a few
   sets of each list at a time (one, then sixteen times as many each round). A probed
   set has met its whole list and leaves it, so it is probed there once in all rounds;
   a list is done once the sets left are in one component. When the pairs left are few
   for the size of the lists, one last round probes all sets beside the largest
   component of their list.

Edge cases: null or empty text has no n-grams, is linked with nothing and is
its own component; fewer than n words give one n-gram, the whole sequence; a
null id is a row of its own and never names a component that has an id;
repeated ids are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bodies, chunked, cut_lineage, key_array, key_bytes, segments, settled, word_slots
from .components import contracted, stars

#: Distinct n-grams in one part: bounds the memory of a counting task.
PART_KEYS = 2_000_000
#: For components alone, all pairs left (of a set beside its list's largest component and any other) are looked at
#: once they are at most so many for each entry of the lists, or once so many sets of a list would be probed at a time.
#: Components are the same either way.
LINEAR, MOST_PROBES = 4, 4096
#: Text in one chunk: bounds the memory of a task that makes the sets.
SET_CHUNK_BYTES = 8 << 20
#: Distances are kept in steps of 1 / STEPS, rounded both ways, so that comparing them is exact.
STEPS = 4096
#: Sets, and n-grams of their differences, in a block of sets of one reference.
BLOCK_SETS, BLOCK_KEYS, SLAB = 256, 200_000, 4096
#: A list's entry carries so many n-grams that come before in its prefix: two sets that share one
#: of them meet in that list, so they needn't meet in this one.
BACK = 4
#: What a probe takes along from its list's entry.
FIELDS = ["n", "node", "pos", "comp", "ref", "near", "far", "back"]
ASK = "part int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, part int, data binary"
SETS = "node long, doc_id long, n int, sig binary, prefix array<long>, shared array<long>"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, n-gram hash) pairs of these texts, sorted by hash, then document."""
    import xxhash
    slots, counts, words = word_slots(texts)
    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))[slots]
    starts, doc = segments(counts)
    h = w.copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            h[: len(h) - j] = h[: len(h) - j] * _M2 + w[j:]
    h = mix(h)
    place = np.arange(len(w)) - starts[doc] if len(w) else np.zeros(0, np.int64)
    whole = place <= counts[doc] - n
    h, doc = h[whole], doc[whole].astype(np.int32)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = [xxhash.xxh64_intdigest(w[starts[d]:starts[d] + counts[d]].tobytes(), seed=int(counts[d])) for d in short]
        h, doc = np.concatenate([h, np.array(one, np.uint64)]), np.concatenate([doc, short.astype(np.int32)])
        back = np.argsort(doc, kind="stable")
        h, doc = h[back], doc[back]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def chunk_order(ids: list, texts: list[bytes]) -> list[int]:
    """The order of a chunk's rows in every pass."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))


def chunk_rows(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and bodies of a chunk in one order for every pass."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("body").to_pylist()
    order = chunk_order(ids, texts)
    return [ids[i] for i in order], [texts[i] for i in order]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(48)) % np.uint64(parts)).astype(np.uint16)


def range_part(h: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the hash's upper half, so that its lower bytes tell the keys of a part apart."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)


def _key_width(keys: int, parts: int) -> int:
    """Bytes of a key so that chance collisions stay under one in 65,536 keys."""
    return int(min(8, max(4, math.ceil((math.log2(max(keys, 2)) + 16 - math.log2(parts)) / 8))))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each occurs."""
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[at], np.diff(np.r_[at, len(h)])


def _count_asks(n: int, parts: int, width: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, texts = chunk_rows(table)
        keys, df = _distinct(shingles(texts, n)[0])
        part = range_part(keys, parts)
        asked, begin = np.unique(part, return_index=True)  # the keys ascend, so their parts do
        rows = [(p, chunk, key_bytes(keys[lo:hi], width), np.minimum(df[lo:hi], 255).astype(np.uint8).tobytes())
                for p, lo, hi in zip(asked.tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)])]
        p, c, k, d = zip(*rows) if rows else ((), (), (), ())
        return pa.table([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(k, pa.binary()),
                         pa.array(d, pa.binary())], ["part", "chunk", "keys", "counts"])
    return ask


def _count_answers(width: int):
    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = [key_array(x, width) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        sizes = [len(k) for k in keys]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts)
        # 0: one document; else 1 + floor(log2(documents)): the order needs no finer rarity
        rarity = np.where(total < 2, 0, 1 + np.floor(np.log2(np.maximum(total, 1)))).astype(np.uint8)[inverse]
        data = [x.tobytes() for x in np.split(rarity, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("chunk").combine_chunks(), pa.array([part] * len(data), pa.int32()),
                         pa.array(data, pa.binary())], ["chunk", "part", "data"])
    return answer


def _prefixes(n: int, parts: int, per_cent: int):
    def build(docs: pa.Table, answers: pa.Table) -> pa.Table:
        import hashlib
        schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()),
                            ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])
        if not docs.num_rows:
            return schema.empty_table()
        chunk = docs.column("chunk")[0].as_py()
        ids, texts = chunk_rows(docs)
        h, doc = shingles(texts, n)
        keys, df = _distinct(h)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("data").to_pylist()))
        rarity = np.repeat(np.frombuffer(b"".join(got[p] for p in sorted(got)), np.uint8), df)
        del keys, df, texts, answers, got
        order = np.argsort(rarity, kind="stable")  # the hashes ascend already; then by document
        order = order[np.argsort(doc[order], kind="stable")]
        h, doc, rarity = h[order].view(np.int64), doc[order], rarity[order]
        del order
        ends = np.searchsorted(doc, np.arange(len(ids) + 1))
        seen, rows = set(), []
        for i, d in enumerate(ids):
            lo, hi = int(ends[i]), int(ends[i + 1])
            size = hi - lo
            if not size:
                rows.append((chunk << 32 | i, d, 0, None, None, None))
                continue
            one = np.searchsorted(rarity[lo:hi], 1)  # where n-grams of several documents begin
            sig = hashlib.blake2b(np.sort(h[lo:hi]).tobytes(), digest_size=16).digest()
            prefix = size - -(-per_cent * size // 100) + 1
            if one >= prefix or sig in seen:
                rows.append((chunk << 32 | i, d, size, sig, None, None))
                continue
            seen.add(sig)
            # position in the order is where it stands: the skipped n-grams count
            rows.append((chunk << 32 | i, d, size, sig, h[lo + one:lo + prefix], np.sort(h[lo + one:hi])))
        cols = list(zip(*rows))
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)
    return build


def sets_of(docs: DataFrame, n: int, per_cent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: node (row key), doc_id, n (set size), sig (equal for equal sets),
    prefix (its n-grams of the prefix that other documents hold, rare first; they end the prefix)
    and shared (all its n-grams that other documents hold). Both are null where the prefix meets
    nobody, and for all but one of the equal sets of a chunk."""
    rows, _, total = chunked(bodies(docs, id_col, text_col), SET_CHUNK_BYTES)
    parts = max(1, -(-(total // 6) // PART_KEYS))
    width = _key_width(total // 4, parts)
    asks = rows.groupBy("chunk").applyInArrow(_count_asks(n, parts, width), ASK)
    answers = asks.groupBy("part").applyInArrow(_count_answers(width), ANSWER)
    return cut_lineage(rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
                       .applyInArrow(_prefixes(n, parts, per_cent), SETS))


def _limit(per_cent: int) -> int:
    """The largest distance of a link, in steps."""
    return STEPS * (100 - per_cent) // 100


def _index(sets: DataFrame, per_cent: int) -> tuple[DataFrame, int, DataFrame]:
    """The lists of n-grams that several of the sets have in their prefix (h, node, n, pos, block, back and what is
    known of the set so far), the number of their entries, and the sets (node, size, shared), dealt by node."""
    size = per_cent / 100
    last = F.col("n") - F.ceil(F.lit(size) * F.col("n") - 1e-9).cast("int")  # the prefix's last position
    # blocks are a little wider than a link's largest ratio of sizes, so that rounding can't put a link two blocks apart
    block = (F.floor(F.log("n") / (-math.log(size) * (1 + 1e-9))) if per_cent < 100 else F.col("n")).cast("int")
    met = sets.filter("prefix is not null")
    lists = (met.select("node", "n", last.alias("last"), "prefix", F.size("prefix").alias("k"), F.posexplode("prefix").alias("i", "h"))
             .select("h", "node", "n", (F.col("last") - F.col("k") + 1 + F.col("i")).alias("pos"), block.alias("block"),
                     F.slice("prefix", F.greatest(F.col("i") - BACK, F.lit(0)) + 1, F.least("i", F.lit(BACK))).alias("back")))
    many = lists.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    lists = settled(lists.join(many, "h").withColumns(
        {"comp": F.col("node"), "ref": F.lit(None).cast("long"), "near": F.lit(None).cast("int"), "far": F.lit(None).cast("int")}))
    # dealt by node once: later joins move only the pairs
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists, lists.count(), cut_lineage(met.select("node", F.col("n").alias("size"), "shared").repartition(parts, "node"))


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Different pairs (a, b, via) that are not among the tested ones."""
    if tested is None:
        return pairs.distinct()
    seen = pairs.withColumn("same", F.lit(None).cast("int")).unionByName(
        tested.select("a", "b", F.lit(None).cast("long").alias("via"), "same"))
    return (seen.groupBy("a", "b").agg(F.max("same").alias("same"), F.max("via").alias("via"))
            .filter("same is null").select("a", "b", "via"))


def _intersected(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b, same (overlap) and sum (of the sizes) from the whole sets."""
    both = (pairs.join(shared.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("shared").alias("sa")), "a")
            .join(shared.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("shared").alias("sb")), "b"))
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("same"), (F.col("na") + F.col("nb")).alias("sum"))


def _differences(learned: DataFrame, shared: DataFrame, per_cent: int) -> DataFrame:
    """Of each set that is close to its reference: node, size, whole (the reference's shared n-grams), more and less."""
    own = learned.filter(F.col("far") <= _limit(per_cent)).select("node", "ref").join(shared, "node")
    ref = shared.select(F.col("node").alias("ref"), F.col("shared").alias("r"))
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(own.join(ref, "ref").select(
        "node", "size", F.size("r").alias("whole"), F.array_except("shared", "r").alias("more"),
        F.array_except("r", "shared").alias("less")).repartition(parts, "node"))


def _derived(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """As ``_intersected``, for pairs of sets of one reference, from their differences alone."""
    side = lambda x: diffs.select(*[F.col(c).alias(c + "_" + x) for c in ("size", "whole", "more", "less")], F.col("node").alias(x))
    same = (F.col("whole_a") - F.size("less_a") - F.size("less_b") + F.size(F.array_intersect("less_a", "less_b"))
            + F.size(F.array_intersect("more_a", "more_b")))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", same.alias("same"), (F.col("size_a") + F.col("size_b")).alias("sum"))


def _linked(tested: DataFrame, per_cent: int) -> DataFrame:
    return tested.filter(100 * F.col("same") >= per_cent * (F.col("sum") - F.col("same"))).select("a", "b")


def _with(lists: DataFrame, learned: DataFrame) -> DataFrame:
    return (lists.select("h", "node", "n", "pos", "block", "back").join(learned, "node", "left")
            .withColumn("comp", F.coalesce("comp", "node")))


def _compared(sets: DataFrame, per_cent: int, grouped: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """(first links, other links, what the first round learned, differences). With ``grouped``, pairs of sets that
    are close to one reference are left out of the other links: ``_grouped`` counts them."""
    lists, entries, shared = _index(sets, per_cent)
    if not entries:
        return None
    # for answers to be derived, the set with the fewest rare n-grams: it is the closest to the others
    probed = _probes(lists, 1, "pos")
    tested = settled(_intersected(_untested(_candidates(lists, probed, per_cent, False), None), shared))
    learned = _learned(tested, None, per_cent)
    diffs = _differences(learned, shared, per_cent)
    pairs = settled(_untested(_candidates(settled(_with(lists, learned)), None, per_cent, False, grouped), tested))
    rest = _intersected(pairs.filter("via is null"), shared)
    rest = settled(rest if grouped else rest.unionByName(_derived(pairs.filter("via is not null"), diffs)))
    return _linked(tested, per_cent), _linked(rest, per_cent), learned, diffs


def links(sets: DataFrame, per_cent: int) -> DataFrame | None:
    """``sets``: node, n, prefix, shared of different sets. All links (a, b), a < b, of them."""
    found = _compared(sets, per_cent, False)
    return found and found[0].unionByName(found[1])


def link_counts(sets: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame] | None:
    """``sets``: as for ``links``, and copies (rows that have the set). (edges, counts): edges (a, b) with the
    components of all links; node and others, the rows of linked sets, of each set that has a link."""
    found = _compared(sets, per_cent, True)
    if found is None:
        return None
    first, rest, learned, diffs = found
    copies = sets.select("node", "copies")
    close = settled(learned.filter(F.col("far") <= _limit(per_cent)).select("node", "ref"))
    # first links among the sets of one reference are counted there
    side = lambda x: close.select(F.col("node").alias(x), F.col("ref").alias("ref_" + x))
    again = F.coalesce(F.col("ref_a") == F.col("ref_b"), F.lit(False))
    single = first.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(~again).select("a", "b").unionByName(rest)
    ends = single.select("a", "b").unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    paired = ends.join(copies.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("copies").alias("others"))
    inside = _grouped(close.join(copies, "node").join(diffs, "node"), per_cent)
    return first.unionByName(rest), paired.unionByName(inside).groupBy("node").agg(F.sum("others").alias("others"))


def _grouped(close: DataFrame, per_cent: int) -> DataFrame:
    """``close``: node, ref, copies, size, whole, more, less. node, others: rows of the linked sets of the same
    reference. A reference's sets are dealt to blocks of bounded size, and each two blocks meet in one group."""
    # what is beyond the reference and what is lacking of it have no n-gram in common
    rows = close.select("ref", "node", "copies", "size", "whole", F.size("less").alias("lack"), F.concat("less", "more").alias("diff"))
    blocks = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("diff")).alias("keys")).filter("c > 1")
    n = F.ceil(F.greatest(F.col("c") / BLOCK_SETS, F.col("keys") / BLOCK_KEYS)).cast("int")
    rows = (rows.join(blocks.select("ref", F.greatest(n, F.lit(1)).alias("n")), "ref")
            .withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}))
    return (rows.select("ref", "i", "j", "block", "node", "copies", "size", "whole", "lack", "diff")
            .groupBy("ref", "i", "j").applyInArrow(_block_counts(per_cent), "node long, others long"))


def _block_counts(per_cent: int):
    def count(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        node, copies, size, lack, block = (col(c).astype(np.int64) for c in ("node", "copies", "size", "lack", "block"))
        whole, i, j = int(col("whole")[0]), int(col("i")[0]), int(col("j")[0])
        diff = table.column("diff").combine_chunks()
        keys, owner = diff.flatten().to_numpy(), segments(diff.value_lengths().to_numpy())[1]
        _, key, times = np.unique(keys, return_inverse=True, return_counts=True)
        several = times[key] > 1
        key, owner = (np.cumsum(times > 1) - 1)[key[several]], owner[several]
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        both = np.zeros((len(a), len(b)), np.int64)
        for lo in range(0, int((times > 1).sum()), SLAB):
            x, y = np.searchsorted(key, [lo, lo + SLAB])
            has = np.zeros((len(node), SLAB), np.float32)
            has[owner[x:y], key[x:y] - lo] = 1
            both += (has[a] @ has[b].T).astype(np.int64)
        same = whole - lack[a][:, None] - lack[b][None, :] + both
        linked = (100 + per_cent) * same >= per_cent * (size[a][:, None] + size[b][None, :])
        if i == j:
            np.fill_diagonal(linked, False)
        nodes, others = [node[a]], [linked @ copies[b]]
        if i != j:
            nodes, others = [*nodes, node[b]], [*others, linked.T @ copies[a]]
        return pa.table([pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(others), pa.int64())], ["node", "others"])
    return count


def component_links(sets: DataFrame, per_cent: int) -> DataFrame | None:
    """Links (a, b) of the sets with the components of all links: pairs inside a component that is already
    known are left out."""
    lists, entries, shared = _index(sets, per_cent)
    if not entries:
        return None
    tested, probes, whole = None, 1, False  # tested: a, b, same (overlap), sum (of the sizes)
    while True:
        # a pair of two components has one set at least beside the list's largest component
        probed = lists.filter("comp <> main") if whole else settled(_probes(lists, probes))
        pairs = _untested(_candidates(lists, probed, per_cent, True), tested)
        found = settled(_intersected(pairs, shared))
        tested = found if tested is None else tested.unionByName(found)
        linked = _linked(tested, per_cent)
        if whole:
            return linked
        # a probed set has met all of its list: the pairs left are those of the others
        lists = _with(lists.join(probed.select("h", "node"), ["h", "node"], "left_anti"), _learned(tested, linked, per_cent))
        by_comp = lists.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"))
        open_ = settled(by_comp.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("c")).filter("c > most.c")
                        .select("h", F.col("most.comp").alias("main"), (F.col("c") * (F.col("c") - F.col("most.c"))).alias("left")))
        left = open_.agg(F.sum("left")).first()[0]
        if not left:
            return linked
        lists = settled(lists.join(open_.select("h", "main"), "h"))
        probes *= 16
        whole = left <= LINEAR * entries or probes > MOST_PROBES


def _probes(lists: DataFrame, probes: int, *first: str) -> DataFrame:
    """One set of each of ``probes`` salts of a list's block, by a hash of the set alone or the columns ``first`` and
    then a hash, so that lists over the same sets probe the same and repeat the same pairs."""
    salt = F.pmod(F.xxhash64("node", F.lit(probes)), F.lit(probes))
    return (lists.groupBy("h", "block", salt.alias("salt"))
            .agg(F.min(F.struct(*[F.col(c).alias("by_" + c) for c in first], F.xxhash64("node", F.lit(-probes)).alias("o"), *FIELDS)).alias("p"))
            .select("h", "block", *[f"p.{f}" for f in FIELDS]))


def _candidates(lists: DataFrame, probed: DataFrame | None, per_cent: int, components_only: bool, grouped: bool = False) -> DataFrame:
    """Pairs (a, b), perhaps repeated, of probed sets (None: all) and those of their list that the block, the
    positions, the distances to a common set, the lists before and, with ``components_only``, the
    components leave open; via is the reference of both, if both are close to it. With ``grouped``, pairs
    that have such a reference are left out too."""
    every, near = probed is None, (-1, 0, 1)
    if every:
        probed, near = lists, (0, 1)  # a pair is met from its lower block
    probed = (probed.select("h", "block", *FIELDS).withColumn("step", F.explode(F.array(*map(F.lit, near))))
              .withColumn("block", F.col("block") + F.col("step")))
    other = lists.select("h", "block", *[F.col(c).alias(c + "2") for c in FIELDS])
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    limit, one = _limit(per_cent), F.col("ref") == F.col("ref2")
    apart = F.greatest(F.col("near") - F.col("far2"), F.col("near2") - F.col("far")) * 100 > STEPS * (100 - per_cent)
    close = one & (F.col("far") <= limit) & (F.col("far2") <= limit)
    known = one & apart | close if grouped else one & apart
    differ = "comp" if components_only else "node"
    pairs = (probed.join(other, ["h", "block"]).filter(F.col(differ) != F.col(differ + "2"))
             .filter(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * per_cent)
             .filter(most * (100 + per_cent) >= (F.col("n") + F.col("n2")) * per_cent)
             .filter(~F.coalesce(known, F.lit(False))).filter(~F.arrays_overlap("back", "back2")))
    if every:
        pairs = pairs.filter("step = 1 or node < node2")
    via = F.when(close, F.col("ref"))
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), via.alias("via"))


def _learned(tested: DataFrame, linked: DataFrame | None, per_cent: int) -> DataFrame:
    """Per set compared so far: node, comp (null without ``linked``), and a reference (ref) at its distance in
    steps, rounded down (near) and up (far): the most similar set or, without ``linked``, of the sets close
    enough to be linked the one with the most of them."""
    union = F.col("sum") - F.col("same")
    out = (STEPS * (union - F.col("same")).cast("long")).alias("out")
    ends = tested.select(F.col("a").alias("node"), F.col("b").alias("ref"), out, union.alias("all"))
    ends = ends.unionByName(tested.select(F.col("b").alias("node"), F.col("a").alias("ref"), out, union.alias("all")))
    near = F.floor(F.col("out") / F.col("all"))  # a quotient of integers this small is exact to the step
    ends = ends.select("node", F.struct((near + F.when(near * F.col("all") < F.col("out"), 1).otherwise(0)).cast("int").alias("far"),
                                        near.cast("int").alias("near"), "ref").alias("r"))
    if linked is None:
        ends, close = settled(ends), F.col("r.far") <= _limit(per_cent)
        most = ends.filter(close).groupBy(F.col("r.ref").alias("ref")).agg(F.count(F.lit(1)).alias("c"))
        order = F.struct((~close).alias("alone"), F.when(close, -F.col("c")).otherwise(F.col("r.far")).alias("o"), "r.far", "r.near", "r.ref")
        ends = ends.withColumn("ref", F.col("r.ref")).join(most, "ref", "left").select("node", order.alias("r"))
    nearest = ends.groupBy("node").agg(F.min("r").alias("r")).select("node", "r.ref", "r.near", "r.far")
    if linked is None:
        return settled(nearest.withColumn("comp", F.lit(None).cast("long")))
    comp = stars(contracted(linked)).withColumnRenamed("component", "comp")
    return settled(nearest.join(comp, "node", "left"))


def jaccard_components(docs: DataFrame, n: int = 5, per_cent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links)
    and, for callers that need it, node (the row's own key)."""
    return _joined(docs, n, per_cent, id_col, text_col, True).drop("n_links")


def jaccard_join(docs: DataFrame, n: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``jaccard_components`` and n_links: how many other rows a row is linked with, rows of an
    equal set among them."""
    return _joined(docs, n, per_cent, id_col, text_col, False)


def _joined(docs: DataFrame, n: int, per_cent: int, id_col: str, text_col: str, components_only: bool) -> DataFrame:
    sets = sets_of(docs, n, per_cent, id_col, text_col)
    first = F.min(F.struct(F.col("prefix").isNull().alias("bare"), "node")).alias("f")
    reps = settled(sets.filter("sig is not null").groupBy("sig").agg(first, F.count(F.lit(1)).alias("copies"))
                   .select("sig", F.col("f.node").alias("rep"), "copies"))
    chosen = sets.join(reps.select(F.col("rep").alias("node"), "copies"), "node")
    none = {"component": F.lit(None).cast("long"), "others": F.lit(0).cast("long")}
    edges, others = (component_links(chosen, per_cent), None) if components_only else link_counts(chosen, per_cent) or (None, None)
    if edges is None:
        known = reps.withColumns(none)
    else:
        comp = stars(contracted(edges))
        known = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
        known = known.withColumn("others", none["others"]) if others is None else known.join(others.withColumnRenamed("node", "rep"), "rep", "left")
    rows = sets.select("node", "doc_id", "n", "sig").join(known, "sig", "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0))
    rows = settled(rows.select("node", "doc_id", "n", F.coalesce("component", "rep", "node").alias("root"), n_links.alias("n_links")))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "node")
