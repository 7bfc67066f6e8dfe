"""Language-model scoring with a weighted backoff automaton.

Model: n-grams with Dirichlet smoothing. With c the training counts,

    p_1(w) = (c(w) + 1) / (N + V + 1)
    p_k(w | ctx) = (c(ctx w) + MASS * p_{k-1}(w | shorter ctx)) / (c(ctx) + MASS)

which sums to one on every level. As an automaton: each context seen in
training is a state; each n-gram seen after it is an arc with its log10
probability; a state's failure arc leads to the state of the shorter context
at the cost log10(MASS / (c(ctx) + MASS)), and is taken when no arc carries
the next word. A text starts in the state of the text-begin mark and is read
left to right once, with the state carried along.

The automaton of a large corpus fits no machine. Each chunk of documents asks
for the states and arcs that its texts can touch (question and answer, see
``common``): counts come from all training documents, the chunk's part of the
automaton is built from the answers, and the chunk is traversed with it.

Edge cases: null text is empty (one token, the end); a null id counts as
training; with no training text all words are unknown and score the uniform
rest; repeated rows are counted as often as they occur; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, key_array, key_bytes, segments, word_slots
from .setjoin import chunk_rows, mix, part_of
from .suffix import ASK, MAIL, _frame, _split_by_part, _unzip, _zip

#: Weight of the lower order, in counts.
MASS = 3.0
ORDER = 2
PART_KEYS = 2_000_000
#: Text of a chunk: a task holds some twenty eight-byte numbers for each of its tokens.
CHUNK_BYTES = 8 << 20

_M = np.uint64(0x94D049BB133111EB)
#: Hashes of the two marks around a text; words are hashed, so no word can spell them.
BEGIN, END = np.uint64(0x62656769), np.uint64(0x656E6400)


def _chunk_order(table: pa.Table):
    """Ids, bodies and training flags of a chunk, in the same order in every pass."""
    ids, texts = chunk_rows(table)
    flags = dict(zip(table.column("doc_id").to_pylist(), table.column("train").to_pylist()))
    return ids, texts, np.array([flags[i] for i in ids], bool)


class Grams:
    """Tokens of some texts (each closed by END) and their n-grams of order 1 .. order."""

    def __init__(self, texts: list[bytes], order: int):
        import xxhash
        slots, counts, words = word_slots(texts)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        ends = np.cumsum(counts)
        self.words = np.insert(mix(hashes[slots]), ends, END)
        self.sizes = counts + 1
        self.starts, self.doc = segments(self.sizes)
        self.order = order
        place = np.arange(len(self.words)) - self.starts[self.doc]
        # level k: hash of the k words up to each token; BEGIN stands before the first
        self.levels = [mix(self.words + np.uint64(1))]
        context = np.where(place >= 1, np.r_[BEGIN, self.words[:-1]], BEGIN) if len(self.words) else self.words
        self.contexts = []
        chain = context
        with np.errstate(over="ignore"):
            for k in range(2, order + 1):
                self.contexts.append(mix(chain + np.uint64(1)) if k == 2 else mix(chain * _M + np.uint64(k - 1)))
                self.levels.append(mix(mix(chain * _M + np.uint64(k)) * _M + self.words))
                back = np.where(place >= k, np.r_[np.zeros(k, np.uint64), self.words[:-k]][: len(self.words)], BEGIN)
                chain = mix(chain * _M + back)
        self.first = place == 0


def _ask(order: int, parts: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, texts, train = _chunk_order(table)
        keys, counts = _chunk_counts(Grams(texts, order), train)
        sent = []
        for i in (0, 1):
            sent.append({p: (key_bytes(keys[i][o]), _zip(counts[i][o].astype("<u4")))
                         for p, o in _split_by_part(part_of(keys[i], parts), parts)})
        none = (b"", _zip(np.zeros(0, "<u4")))
        return _frame([(p, chunk, *sent[0].get(p, none), *sent[1].get(p, none)) for p in sorted(sent[0].keys() | sent[1].keys())], ASK)
    return ask


def _distinct_counts(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[order][at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


def _chunk_counts(g: Grams, train: np.ndarray):
    """Distinct keys and training counts: of words, and of all else (longer n-grams, contexts, BEGIN)."""
    weight = train[g.doc].astype(np.int64)
    one = _distinct_counts(g.levels[0], weight)
    # a context counts as often as a token follows it; contexts of one word are words, or BEGIN
    more_h, more_w = list(g.levels[1:]), [weight] * (g.order - 1)
    for k, c in enumerate(g.contexts):
        use = g.first if k == 0 else np.ones(len(c), bool)
        more_h.append(c[use])
        more_w.append(weight[use])
    z = np.zeros(0, np.uint64)
    two = _distinct_counts(np.concatenate([z, *more_h]), np.concatenate([z.astype(np.int64), *more_w]))
    return (one[0], two[0]), (one[1], two[1])


def _totals(keys: list[bytes], counts: list[bytes]):
    k = [key_array(x) for x in keys]
    c = np.concatenate([_unzip(x, "<u4") for x in counts]).astype(np.float64)
    _, inverse = np.unique(np.concatenate(k), return_inverse=True)
    return np.bincount(inverse, weights=c).astype(np.int64), inverse, np.cumsum([len(x) for x in k])[:-1]


def _answer(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    out = []
    for a, b in ("ab", "cd"):
        total, inverse, cut = _totals(table.column(a).to_pylist(), table.column(b).to_pylist())
        out.append([_zip(x.astype("<u4" if total.max(initial=0) < 1 << 32 else "<u8")) for x in np.split(total[inverse], cut)])
    return _frame([(c, 1, part, x, y, None, None) for c, x, y in zip(table.column("chunk").to_pylist(), *out)], MAIL)


def _sums(table: pa.Table) -> pa.Table:
    """Training tokens and distinct training words of a part."""
    total, _, _ = _totals(table.column("a").to_pylist(), table.column("b").to_pylist())
    return pa.table([pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], ["n", "v"])


class Automaton:
    """The states and arcs that a chunk's texts can touch.

    ``arc[k]``: log10 weight of each token's arc of order k + 1 (nan where training has none);
    ``fail[k]``: log10 weight of the failure arc from its state of order k + 1 to order k."""

    def __init__(self, g: Grams, count, n: int, v: int):
        seen = count(0, g.levels[0]).astype(np.float64)
        p = (seen + 1) / (n + v + 1)
        self.known = seen > 0
        self.base = np.log10(p)
        self.arc, self.fail = [self.base], []
        for k in range(2, g.order + 1):
            context = g.contexts[k - 2]
            c = count(1, context, g.first if k == 2 else None)
            if k == 2:  # a context of one word is that word, unless it is BEGIN
                c = np.where(g.first, c, np.r_[0, seen[:-1]])
            c = c.astype(np.float64)
            times = count(1, g.levels[k - 1]).astype(np.float64)
            p = (times + MASS * p) / (c + MASS)
            self.arc.append(np.where(times > 0, np.log10(p), np.nan))
            self.fail.append(np.log10(MASS / (c + MASS)))

    def read(self) -> np.ndarray:
        """log10 weight of every step: the arc of the longest state that has one, after the
        failure arcs down to it."""
        step = self.arc[0]
        for arc, fail in zip(self.arc[1:], self.fail):
            step = np.where(np.isnan(arc), fail + step, arc)
        return step


def _finish(parts: int, order: int):
    def finish(docs: pa.Table, mail: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        ids, texts, train = _chunk_order(docs)
        g = Grams(texts, order)
        keys, _ = _chunk_counts(g, train)
        got = {p: (a, b) for kind, p, a, b in zip(*(mail.column(c).to_pylist() for c in ("kind", "part", "a", "b"))) if kind == 1}
        n, v = next(map(int, a.split(b" ")) for kind, a in zip(mail.column("kind").to_pylist(), mail.column("a").to_pylist()) if kind == 3)
        table = []
        for i in (0, 1):
            counts = np.zeros(len(keys[i]), np.int64)
            for p, o in _split_by_part(part_of(keys[i], parts), parts):
                raw = got[p][i]
                counts[o] = _unzip(raw, "<u4" if int.from_bytes(raw[:8], "little") == 4 * len(o) else "<u8")
            table.append(counts)

        def count(i: int, h: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
            out = np.zeros(len(h), np.int64)
            use = slice(None) if some is None else some
            if len(keys[i]):
                out[use] = table[i][np.searchsorted(keys[i], h[use])]
            return out

        m = Automaton(g, count, n, v)
        add = lambda x: np.add.reduceat(x, g.starts)  # noqa: E731  every text has its end token
        cols = [ids, ~train, g.sizes, add(m.known.astype(np.int64)), np.full(len(ids), n), add(m.base), add(m.read())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return finish


def score(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    The model learns from the documents for which ``held_out`` (a condition on doc_id) fails."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    rows, n_chunks, total = chunked(rows.withColumn("train", ~F.coalesce(held_out, F.lit(False))), CHUNK_BYTES)
    parts = max(1, min(60_000, -(-(total // 8) // PART_KEYS)))
    asks = rows.groupBy("chunk").applyInArrow(_ask(order, parts), ASK)
    answers = asks.groupBy("part").applyInArrow(_answer, MAIL)
    sums = asks.groupBy("part").applyInArrow(_sums, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    # one number pair for the whole corpus, posted to every chunk
    post = sums.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"),
                       F.lit(3).alias("kind"), F.lit(-1).alias("part"),
                       F.concat_ws(" ", F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0))).cast("binary").alias("a"),
                       *[F.lit(None).cast("binary").alias(c) for c in "bcd"])
    mail = answers.unionByName(post)
    return rows.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(
        _finish(parts, order), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
