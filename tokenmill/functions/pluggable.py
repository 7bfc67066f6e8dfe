"""Plug-in surface for user tokenisers, scorers and models.

Built-in expressions cover the shipped tokenisers; these Arrow-batched
iterator ``pandas_udf``s are for code that only exists in Python (a
tokenizer file, a chemistry scorer, a model). The factory runs once per
Python worker, not per row or per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType


def pluggable_ids(text: Column, factory: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Column:
    """Ids from any tokenizer. ``factory()`` returns ``encode(list[str]) -> list[list[int]]``."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = factory()
        for s in batches:
            yield pd.Series(enc(s.fillna("").tolist()))

    return encode(text)


def regex_tokenizer_factory(pattern: str, vocab: dict, unk_id: int, max_tokens: int | None):
    """A Python-side regex tokenizer (same rules as the built-in T2/T3), used
    to exercise and test the plug-in path."""

    def factory():
        import re
        rx = re.compile(pattern)

        def enc(texts):
            out = []
            for t in texts:
                toks = rx.findall(t)
                if max_tokens is not None:
                    toks = toks[:max_tokens]
                out.append([vocab.get(x, unk_id) for x in toks])
            return out

        return enc

    return factory


def pluggable_scores(col: Column, factory: Callable[[], Callable[[list], list[float]]]) -> Column:
    """A per-row scorer (qed, sa, validity, ...) supplied by the user."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for s in batches:
            yield pd.Series(fn(s.tolist()), dtype="float64")

    return score(col)


def map_batches(df, fn: Callable[[pd.DataFrame], pd.DataFrame], schema):
    """A user batch function (pandas frame in, frame out) over every
    Arrow batch of every partition. Built-in expressions are preferred."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)


def pluggable_predicate(col: Column, factory: Callable[[], Callable[[list], list[bool]]]) -> Column:
    """A user batch predicate; use as ``df.where(pluggable_predicate(...))``."""
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def keep(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for s in batches:
            yield pd.Series(fn(s.tolist()), dtype=bool)

    return keep(col)


def chunk_udtf():
    """The n-in/m-out chunker as a Python UDTF (an API alias; the
    operator itself is ``packing.chunk_text``, which stays in the JVM).
    Register with ``spark.udtf.register("chunks", chunk_udtf())``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_idx int, chunk string")
    class Chunks:
        def eval(self, text: str, size: int):
            t = text or ""
            for i, s in enumerate(range(0, len(t), size)):
                yield i, t[s:s + size]

    return Chunks


def join_and_cut_udtf():
    """U5 on a table argument: the texts of each (conv_id, batch) partition, in its order and each ended by a line
    break, joined and cut into pieces of ``size`` characters (the last may be short). Rows are read one by one and a
    piece leaves as soon as it is whole; null keys and texts are kept (a null text is empty)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="conv_id long, batch long, piece_idx long, piece string", useArrow=True)
    class JoinAndCut:
        def __init__(self):
            self.key, self.size, self.n, self.rest = (None, None), 1, 0, ""

        def eval(self, row, size: int):
            self.key, self.size = (row["conv_id"], row["batch"]), size
            self.rest += (row["text"] or "") + "\n"
            whole = len(self.rest) // size
            for i in range(whole):
                yield *self.key, self.n + i, self.rest[i * size:(i + 1) * size]
            self.n, self.rest = self.n + whole, self.rest[whole * size:]

        def terminate(self):
            if self.rest:
                yield *self.key, self.n, self.rest

    return JoinAndCut


def user_metric(col: Column, fn: Callable[[pd.Series], float]) -> Column:
    """A user-defined grouped metric (grouped-aggregate pandas UDF); the
    shipped metrics (nll, bpd, ppl, ...) are built-in aggregate expressions."""
    @F.pandas_udf(DoubleType())
    def agg(values: pd.Series) -> float:
        return float(fn(values))

    return agg(col)


#: Ids that a model gets in one call, unless a single sequence has more.
PIECE_IDS = 1 << 20


def _pieces(seqs: pd.Series, size: int, ids: Callable = len) -> Iterator[list]:
    """The sequences in runs of about ``size`` ids. An Arrow batch may hold tens of megabytes of ids, and scores take
    twice that, so they are made and sent run by run."""
    ends = np.cumsum([0 if x is None else ids(x) for x in seqs])
    for part in np.split(np.arange(len(seqs)), np.flatnonzero(np.diff(ends // size)) + 1):
        yield seqs.iloc[part].tolist()


def model_log_probs(ids: Column, factory: Callable[[], Callable[[list], list[list[float]]]], in_ranges: bool = False) -> Column:
    """U4: per-token log-probs of a user model for each id sequence (the model gets and may return numpy arrays).
    The model is called for about ``PIECE_IDS`` ids at a time, so a worker never holds the scores of a whole batch.
    ``in_ranges``: a row has an array of sequences and gets one of their scores."""
    if in_ranges:
        @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
        def run_ranges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = factory()
            for s in batches:
                for piece in _pieces(s, PIECE_IDS, lambda row: sum(map(len, row))):
                    scores = iter(model([x for row in piece for x in row]))
                    yield pd.Series([[next(scores) for _ in row] for row in piece], dtype=object)

        return run_ranges(ids)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            for piece in _pieces(s, PIECE_IDS):
                yield pd.Series(list(model(piece)), dtype=object)

    return run(ids)


def adaptive_unigram_factory(vocab_size: int):
    """A model for U4 without parameters: each token's log-probability from the counts of the tokens before it in
    the same sequence, (count + 1) / (tokens before + vocabulary). So a score depends on its context, as with a
    trained model: windows that overlap more give other scores."""

    def factory():
        import numpy as np

        def score(seqs):
            out = []
            for ids in seqs:
                a = np.asarray(ids, np.int32)
                order = np.argsort(a, kind="stable")
                at, before = np.arange(len(a)), np.zeros(len(a), np.int64)
                first = np.flatnonzero(np.diff(a[order], prepend=-1))  # where each token's run begins
                before[order] = at - np.repeat(first, np.diff(np.r_[first, len(a)]))
                out.append(np.log((before + 1.0) / (at + vocab_size)))
            return out

        return score

    return factory
