"""Toxicity severity by cumulative-link ordinal regression.

Grades 0 .. K - 1 are ordered; one weight vector w is shared by all thresholds:

    P(grade >= k | x) = sigmoid(w . x - t_k),    t_1 <= t_2 <= ...

x is sparse: for each word and word beginning (3 to 6 letters) of the text that
the feature selection kept, its count (at most ``COUNT_TOP``). Kept are features
tied to toxic texts (log-likelihood ratio of at least ``LEAST_G2``), and weights
are not negative: more clean text around a toxic passage doesn't excuse it. The expected
severity is sum_k P(grade >= k); a document is rejected if P(grade >= 1) is at
least ``REJECT``.

Labels say toxic or not. The grades of the toxic ones come from their cues: a
cue is a feature that the labelled rows tie to toxic texts; toxic texts with
more cue words than the median of their kind are grade 2, the others grade 1.

The fit uses at most ``FIT_ROWS`` labelled documents, the first by a hash of
their id (a documented bound; scoring covers every document). Features are
selected by a distributed count over those rows; what comes to the driver is
at most ``FEATURES`` features and the fit rows restricted to them.

Edge cases: null text is empty and scores as a text without features; null
labels or label ids are ignored; several labels of an id count as toxic if one
is; without labelled rows of both kinds nothing is rejected (severity 0);
repeated documents are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bodies, segments, worker_state
from .tokens import PieceTable, groups_of_bytes

FIT_ROWS = 12_000
FEATURES = 16_384
#: A feature must occur in so many fit rows.
LEAST_ROWS = 3
LEAST_G2 = 12.0
COUNT_TOP = 4
REJECT = 0.5
GRADES = 3
BEGINNINGS = (3, 4, 5, 6)


def word_features(piece: bytes) -> list[int]:
    """Feature hashes of the words in a white-space-free piece: each word, and its beginnings."""
    import regex
    out = []
    for word in regex.findall(r"\p{L}+", piece.decode("utf-8", "replace").lower()):
        out.append(zlib.crc32(word.encode("utf-8")))
        out += [zlib.crc32(f"{word[:n]}*".encode()) for n in BEGINNINGS if len(word) >= n]
    return out


def _features(texts: list[bytes], wanted: np.ndarray | None, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the texts: (row, feature, count). ``wanted``: sorted hashes to keep, as
    their places; else all, as hashes."""

    def encode(pieces):
        rows = [word_features(p) for p in pieces]
        if wanted is None:
            return rows
        flat, n = np.array([f for r in rows for f in r], np.uint32), [len(r) for r in rows]
        at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
        hit = wanted[at] == flat
        ends = np.r_[0, np.cumsum(hit)][np.cumsum(n, dtype=np.int64)] if n else []
        return [x.tolist() for x in np.split(at[hit], ends[:-1])]

    table = worker_state(f"tox_{key}", lambda: PieceTable(encode))
    ids, n = table.rows([t.split() for t in texts])
    _, row = segments(n)
    both, count = np.unique(row.astype(np.uint64) << np.uint64(32) | ids, return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), count


def fit_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, body, toxic of the labelled documents that the fit may use."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.join(F.broadcast(known), "doc_id")  # bounded: at most ``limit`` ids
    return rows.dropDuplicates(["body"])  # a copy is no further evidence


def select_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FEATURES hashes most tied to the label, sorted, and which of them are cues."""

    def count(batches):
        for b in batches:
            texts, toxic = b.column("body").to_pylist(), b.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi in groups_of_bytes([len(t) for t in texts], 4 << 20):
                row, feature, _ = _features(texts[lo:hi], None, "all")
                kinds, inverse = np.unique(feature, return_inverse=True)
                bad = np.bincount(inverse, weights=toxic[lo:hi][row] > 0, minlength=len(kinds))
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(np.bincount(inverse), pa.int64()),
                                                  pa.array(bad.astype(np.int64))], ["feature", "n", "bad"])

    n, bad = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not bad or n == bad:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    share = bad / n
    counts = (rows.select("body", "toxic").mapInArrow(count, "feature long, n long, bad long")
              .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("n") >= LEAST_ROWS))
    # log-likelihood ratio of the feature's toxic share against that of all fit rows
    rate = F.col("bad") / F.col("n")
    part = lambda k, q, p: F.when(k > 0, k * F.log(q / p)).otherwise(0.0)
    g2 = 2 * (part(F.col("bad"), rate, share) + part(F.col("n") - F.col("bad"), 1 - rate, 1 - share))
    best = (counts.filter(rate > share).select("feature", g2.alias("g2"), (rate >= 0.9).alias("cue"))
            .filter(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "feature").limit(FEATURES))
    got = sorted((r["feature"], r["cue"]) for r in best.collect())  # bounded: FEATURES rows
    return np.array([f for f, _ in got], np.uint32), np.array([c for _, c in got], bool)


class OrdinalModel:
    """Weights shared by all thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, a row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, count: np.ndarray, grade: np.ndarray, n_features: int,
                grades: int = GRADES, ridge: float = 5e-5, steps: int = 700, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (at least 0) and thresholds by projected Adam on the mean cumulative-link log loss."""
    n = len(grade)
    x = np.minimum(count, COUNT_TOP).astype(np.float64)
    gaps = np.zeros(grades - 1)  # thresholds: the first as is, each next by exp(gap) more
    gaps[0] = 3.0
    params = np.concatenate([np.zeros(n_features), gaps])
    m, s = np.zeros_like(params), np.zeros_like(params)
    above = np.arange(1, grades)
    for t in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        cut = np.cumsum(np.r_[raw[0], np.exp(raw[1:])])
        score = np.bincount(row, weights=w[feature] * x, minlength=n)
        p = 1 / (1 + np.exp(np.clip(cut - score[:, None], -60, 60)))
        edge = np.c_[np.ones(n), p, np.zeros(n)]
        mass = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        slope = p * (1 - p)
        # d(-log mass)/dp: minus for the lower edge of the own grade, plus for its upper edge
        dp = ((above == grade[:, None] + 1) * 1.0 - (above == grade[:, None]) * 1.0) / mass[:, None] * slope / n
        by_score = dp.sum(axis=1)
        grad_w = np.bincount(feature, weights=by_score[row] * x, minlength=n_features) + ridge * w
        by_cut = -dp.sum(axis=0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([grad_w, tail * np.r_[1.0, np.exp(raw[1:])]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
        params[:n_features] = np.maximum(params[:n_features], 0)
    raw = params[n_features:]
    return params[:n_features], np.cumsum(np.r_[raw[0], np.exp(raw[1:])])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> OrdinalModel | None:
    """Fits the model; None if there are not labelled rows of both kinds."""
    rows = fit_rows(docs, labels, limit)
    wanted, cues = select_features(rows)
    if not len(wanted):
        return None
    key = f"{zlib.crc32(wanted.tobytes()):x}"

    def vectors(batches):
        for b in batches:
            texts = b.column("body").to_pylist()
            r, f, c = _features(texts, wanted, key)
            cut = np.searchsorted(r, np.arange(1, len(texts)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([x.astype("<u4").tobytes() for x in np.split(f, cut)], pa.binary()),
                 pa.array([np.minimum(x, 255).astype(np.uint8).tobytes() for x in np.split(c, cut)], pa.binary())],
                ["doc_id", "toxic", "f", "c"])

    # bounded: ``limit`` rows, selected features only
    got = rows.select("doc_id", "toxic", "body").mapInArrow(vectors, "doc_id long, toxic int, f binary, c binary").collect()
    got.sort(key=lambda x: (x["doc_id"], bytes(x["f"])))
    feature = [np.frombuffer(x["f"], "<u4") for x in got]
    count = [np.frombuffer(x["c"], np.uint8) for x in got]
    toxic = np.array([x["toxic"] > 0 for x in got])
    heard = np.array([int(c[cues[f]].sum()) for f, c in zip(feature, count)])
    half = np.median(heard[toxic])
    grade = np.where(toxic, np.where(heard > half, 2, 1), 0)
    _, row = segments(np.array([len(f) for f in feature]))
    w, cut = fit_ordinal(row, np.concatenate(feature), np.concatenate(count), grade, len(wanted))
    return OrdinalModel(wanted, w, cut)


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic, rejected."""
    plain = bodies(docs, id_col, text_col)
    model = fit(plain, labels)
    score = scorer(model)

    def run(batches):
        for b in batches:
            s, p = score(b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(p), pa.array(p >= REJECT)],
                                             ["doc_id", "severity", "p_toxic", "rejected"])

    return plain.mapInArrow(run, "doc_id long, severity double, p_toxic double, rejected boolean")


def scorer(model: OrdinalModel | None):
    """texts -> (expected severity, P(toxic)) of each."""
    key = None if model is None else f"{zlib.crc32(model.features.tobytes()):x}"

    def score(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if model is None:
            return np.zeros(len(texts)), np.zeros(len(texts))
        total = np.zeros(len(texts))
        for lo, hi in groups_of_bytes([len(t) for t in texts], 4 << 20):
            r, f, c = _features(texts[lo:hi], model.features, key)
            total[lo:hi] = np.bincount(r, weights=model.weights[f] * np.minimum(c, COUNT_TOP), minlength=hi - lo)
        p = model.at_least(total)
        return p.sum(axis=1), p[:, 0]

    return score


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all their columns) whose text is not rejected."""
    score = scorer(fit(bodies(docs, id_col, text_col), labels))

    @F.pandas_udf("boolean")
    def rejected(text):
        import pandas as pd
        return pd.Series(score([("" if t is None else t).encode("utf-8") for t in text])[1] >= REJECT)

    return docs.filter(~rejected(F.col(text_col)))
