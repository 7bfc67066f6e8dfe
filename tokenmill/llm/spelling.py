"""Spelling variants: words one edit apart, found by a frontier on a relational trie.

The words form a trie twice, spelled forwards and backwards. Its chains are
compressed: nodes stay where words branch, end or start to be searched, and an
edge carries the letters between two of them. Edges are a distributed table
(node, label, child, the word that ends at the child). The frontier holds
states (word, position as the letters left, node, edits). Each level joins it with the edges of its
nodes: the word's own edge moves on with no edit; a state without an edit takes
every other edge with one (the letter is replaced, inserted or deleted); a
state with its edit follows the one edge that spells the rest of the word, and
is kept only if its node has an edge with the next letter. A state with one edit at the end of its word, on a node where a word ends, is a
pair of neighbours. As the edit is placed where the two words first differ, a
pair is met once in each direction.

Of two words one edit apart, one shares the first or the last half (rounded
down) of the other. So the search starts below the node of a word's first half
in the forward trie and of its last half in the backward one, and a word is in
the tries from just above that node on.

Nodes are named by 64-bit hashes of their prefixes. A collision can only add
candidates (the edges of two nodes meet), and every pair found is compared
letter by letter at the end.

Sizes: a word gives one row a letter to the tables, so long words cost their
length; the number of levels is that of the branching nodes on a word's path.
A node has no more edges than there are letters. All tables are joined and
grouped by Spark; nothing is collected. Spark takes the tries for as small as the
words' file, so tables are broadcast only if their rows were counted to be few.

Edge cases: null text has no words; a null id counts as the empty text before
the colon; repeated rows count as often as they occur; ties between forms go to
the smaller word; an empty table, or no word that is frequent enough, gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, segments, settled
from .tokens import groups_of_bytes

#: Fixed value: letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
#: A run whose hash this divides loses a letter.
DELETE_EVERY = 199
#: Bytes of rows in memory up to which Spark may broadcast a table, by way of the driver.
BROADCAST_BYTES = 8 << 20


def _held(df: DataFrame, text_col: str) -> int:
    """About the bytes that the rows take in memory, by counting: files are packed, and say nothing of rows to come."""
    return df.agg(F.sum(F.char_length(text_col) * 2 + 96)).first()[0] or 0


def _large(words: DataFrame) -> bool:
    """Whether the words, or their tries of about a row a letter, are too large to be broadcast."""
    return (words.agg(F.sum(F.char_length("word") * 64 + 256)).first()[0] or 0) > BROADCAST_BYTES


def _shuffled(df: DataFrame, large: bool) -> DataFrame:
    """A side of a join; if ``large``, neither side is broadcast, whatever Spark takes their sizes for."""
    return df.hint("merge") if large else df


def counted_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """word, n: the words of at least ``min_length`` letters with ``min_count`` occurrences or more."""
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(
        F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("_run"))
    run = run.select("_id", F.translate("_run", string.ascii_uppercase, string.ascii_lowercase).alias("_run"))
    run = run.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = F.pmod("_h", F.char_length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.expr("substring(_run, cast(pmod(_h, char_length(_run)) as int) + 2)"))
    word = F.when(F.pmod("_h", F.lit(DELETE_EVERY)) == 0, shorter).otherwise(F.col("_run"))
    return (run.select(word.alias("word")).where(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _paths(batches):
    """(wid, back, at, node, next, stop) for the prefixes of each word, of one letter less than its first half on."""
    for b in batches:
        wids, words = b.column("wid").to_numpy(), b.column("word").to_pylist()
        for lo, hi in groups_of_bytes([len(w) for w in words], 1 << 18):
            size = np.array([len(w) for w in words[lo:hi]], np.int64)
            begin, owner = segments(size)
            at = np.arange(len(owner)) - begin[owner] + 1
            power = np.full(int(size.max()) + 1, 0x2545F4914F6CDD1D, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
            half, end = (size // 2)[owner], at == size[owner]
            keep = at >= half - 1
            for back in (False, True):
                code = np.frombuffer("".join(w[::-1] if back else w for w in words[lo:hi]).encode("utf-32-le"), "<u4")
                term = _mixed(code.astype(np.uint64) | np.uint64(back << 40)) * power[at]
                total = np.cumsum(term)
                node = (total - (total[begin] - term[begin])[owner]).view(np.int64)
                following = np.where(end, -1, np.r_[code[1:], 0].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wids[lo:hi][owner][keep]), pa.array(np.full(int(keep.sum()), back)), pa.array(at[keep].astype(np.int32)),
                     pa.array(node[keep]), pa.array(following[keep].astype(np.int32)), pa.array(((at == half) | end)[keep])],
                    ["wid", "back", "at", "node", "next", "stop"])


def trie(words: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, starts) of the two tries. ``large``: see ``_large``.

    edges: node, label, child, opens (a bit for each first letter of the child's own edges), ends (the words
    that end at the child: none or one, but where hashes collide). starts: the states of all words at their halves."""
    paths = words.select("wid", "word").mapInArrow(_paths, "wid long, back boolean, at int, node long, next int, stop boolean")
    nodes = (paths.groupBy("node").agg(
        F.min("next").alias("a"), F.max("next").alias("b"), F.max("stop").alias("s"),
        F.bit_or(F.expr("if(next < 0, 0L, shiftleft(1L, next & 63))")).alias("opens")).where("s or a <> b").select("node", "opens"))
    stops = (paths.join(_shuffled(nodes, large), "node").groupBy("wid", "back")
             .agg(F.sort_array(F.collect_list(F.struct("at", "node", "opens"))).alias("stops")))  # at most one a letter
    walks = settled(stops.join(_shuffled(words.select("wid", "word"), large), "wid")
                    .select("wid", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("spelled"), "back", "stops"))
    steps = walks.select("wid", "spelled", F.posexplode(
        F.arrays_zip(F.expr("slice(stops, 1, size(stops) - 1)").alias("a"), F.expr("slice(stops, 2, size(stops) - 1)").alias("b"))))
    steps = steps.select(
        F.col("col.a.node").alias("node"), F.expr("substring(spelled, col.a.at + 1, col.b.at - col.a.at)").alias("label"),
        F.col("col.b.node").alias("child"), F.col("col.b.opens").alias("opens"),
        F.expr("if(col.b.at = char_length(spelled), wid, null)").alias("ends"))
    edges = steps.groupBy("node", "label", "child").agg(F.first("opens").alias("opens"), F.collect_set("ends").alias("ends"))
    edges = settled(edges.select("*", F.expr("substring(label, 2)").alias("tail"), F.char_length("label").alias("size")))
    starts = walks.select("wid", "spelled", F.explode("stops").alias("stop")).where("stop.at = char_length(spelled) div 2")
    starts = settled(starts.select("wid", F.expr("substring(spelled, stop.at + 1)").alias("rest"), F.col("stop.node").alias("node"),
                                   F.lit(0).alias("edits"), F.array().cast("array<long>").alias("ends")))
    forget(walks)
    return edges, starts


#: The states that a state and an edge of its node give: edits, letters of the word passed.
_STEP = """filter(array(
  if(startswith(rest, label), named_struct('edits', edits, 'by', size), null),
  if(other and rest <> '' and startswith(rest2, tail), named_struct('edits', 1, 'by', size), null),
  if(other and startswith(rest, tail), named_struct('edits', 1, 'by', size - 1), null),
  if(other and rest <> '' and startswith(rest2, label), named_struct('edits', 1, 'by', size + 1), null)
), x -> x is not null)"""

#: A state that may go on: without an edit, or where its node has an edge with the next letter.
_GOES_ON = "(edits = 0 or (rest <> '' and opens & shiftleft(1L, ascii(rest) & 63) <> 0))"
#: Neighbours: at the end with one edit, or with none and one letter left, which is then the one deleted.
_ENDS = "(size(ends) > 0 and char_length(rest) + edits = 1)"


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: all ordered pairs of words that are exactly one edit apart. ``words``: wid (unique), word,
    of three letters or more."""
    large = _large(words)
    edges, starts = trie(words, large)
    frontier, levels = starts, []
    while held := _held(frontier, "rest"):
        f = frontier.select("wid", "rest", F.expr("substring(rest, 2)").alias("rest2"), "node", "edits").alias("f")
        on = F.expr("f.node = e.node and (edits = 0 or startswith(rest, label))")  # with its edit, only the edge that spells on
        met = f.join(_shuffled(edges.alias("e"), held > BROADCAST_BYTES), on).withColumn("other", F.expr("edits = 0 and substring(rest, 1, 1) <> substring(label, 1, 1)"))
        moved = met.withColumn("to", F.explode(F.expr(_STEP))).select(
            "wid", F.expr("substring(rest, to.by + 1)").alias("rest"), F.col("child").alias("node"),
            F.col("to.edits").alias("edits"), "ends", "opens")
        level = settled(moved.where(f"{_GOES_ON} or {_ENDS}"))
        levels.append(level)
        frontier = level.where(_GOES_ON)
    pairs = words.select("wid", F.col("wid").alias("near")).where(F.lit(False))
    for level in levels:
        pairs = pairs.union(level.where(_ENDS).select("wid", F.explode("ends").alias("near")))
    names = _shuffled(words.select("wid", "word"), large)
    named = (pairs.distinct().join(names, "wid").join(names.select(F.col("wid").alias("near"), F.col("word").alias("_near")), "near")
             .select("word", F.col("_near").alias("near")))
    named = settled(named.where(F.expr("levenshtein(word, near, 1) = 1")))
    forget(edges, starts, *levels)
    return named


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms, by pointer jumping. ``forms``: word, form (not null)."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    large = _held(at, "word") > BROADCAST_BYTES
    while True:
        further = _shuffled(at.select(F.col("word").alias("root"), F.col("root").alias("_next")), large)
        step = settled(at.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        forget(at)
        at = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word. The form is the neighbour with the most occurrences
    if it has ``ratio`` times the word's or more."""
    words = settled(counted_words(docs, min_length, min_count, id_col, text_col)
                    .withColumn("wid", F.monotonically_increasing_id()))
    large = _large(words)
    near = neighbours(words)
    counts = _shuffled(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), large)
    best = (near.join(counts, "near").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")))
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"if(-best.minus >= {ratio} * n, best.near, null)").alias("form"),
        F.expr(f"if(-best.minus >= {ratio} * n, -best.minus, null)").alias("form_n"))
    out = settled(out)
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(_shuffled(ends, large), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
