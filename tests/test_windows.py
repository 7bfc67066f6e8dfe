"""Overlapping windows, stitched, against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.functions.pluggable import adaptive_unigram_factory, model_log_probs
from tokenmill.operators import seqeval as E
from tokenmill.plans import q_eval

VOCAB = 7


def adaptive(ids):
    return [math.log((ids[:i].count(x) + 1) / (i + VOCAB)) for i, x in enumerate(ids)]


def stitched(ids, ctx, stride):
    """Scores of positions 1.. by the windows' rule."""
    out = {}
    n = max(math.ceil((len(ids) - ctx + stride) / stride), 1)
    for i in range(n):
        begin, end = i * stride, min(i * stride + ctx, len(ids))
        scores = adaptive(ids[begin:end])
        for p in range(1 if i == 0 else begin + ctx - stride, end):
            assert p not in out
            out[p] = scores[p - begin]
    return [out[p] for p in sorted(out)]


def run(spark, rows, ctx, stride, per_range):
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartition(3)
    w = E.window_ids(df, "ids", ctx, stride, ["seq"])
    w = w.withColumn("log_p", model_log_probs(F.col("win_ids"), adaptive_unigram_factory(VOCAB)))
    return E.stitch_windows(w, ["win_ids", "log_p"], ["seq"], per_range)


@pytest.mark.parametrize("ctx, stride, per_range", [(16, 8, 4), (16, 16, 1), (10, 3, 64), (5, 1, 7)])
def test_each_position_comes_from_its_owner(spark, ctx, stride, per_range):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(VOCAB) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 5, 15, 16, 17, 24, 25, 40, 100, 333])] + [(99, None)]
    parts = {}
    for r in run(spark, rows, ctx, stride, per_range).collect():
        parts.setdefault(r["seq"], []).append((r["range_id"], r["pos_from"], list(r["win_ids"]), list(r["log_p"])))
        assert len(r["log_p"]) <= per_range * stride + ctx
    for seq, ids in rows:
        got, at = [], 1
        for _, begin, tokens, scores in sorted(parts.get(seq, [])):
            assert begin == at and tokens == ids[begin:begin + len(tokens)]
            got += scores
            at += len(scores)
        assert got == pytest.approx(stitched(ids or [], ctx, stride))


def test_overlap_changes_the_scores(spark):
    rng = random.Random(2)
    rows = [(0, [rng.randrange(VOCAB) for _ in range(200)])]
    total = {s: sum(sum(r["log_p"]) for r in run(spark, rows, 32, s, 8).collect()) for s in (4, 16, 32)}
    assert len({round(v, 6) for v in total.values()}) == 3


@pytest.mark.parametrize("ctx, stride, per_range", [(16, 8, 4), (16, 16, 1), (10, 3, 64), (5, 1, 7)])
def test_ranges_dealt_before_they_are_scored(spark, ctx, stride, per_range):
    """The same rows as with shuffled scores, with keys that are null or come twice."""
    rng = random.Random(3)
    rows = [(i // 2 if i % 3 else None, [rng.randrange(VOCAB) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 5, 15, 16, 17, 24, 25, 40, 100, 333])]
    rows += [rows[-1], (99, None)] + [(7, [1, 2, 3] * 30)] * 3
    df = spark.createDataFrame(rows, "seq long, ids array<int>").repartition(3)
    w = E.window_ids(df, "ids", ctx, stride, ["seq"], windows_per_range=per_range)
    w = w.withColumn("log_p", model_log_probs(F.col("win_ids"), adaptive_unigram_factory(VOCAB), in_ranges=True))
    got = E.stitch_windows(w, ["win_ids", "log_p"], ["seq"], per_range, in_ranges=True)
    want = run(spark, rows, ctx, stride, per_range)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("query", [q_eval.q_sliding_window_stitch, q_eval.q_windowed_generative_ppl])
def test_scores_are_not_shuffled(spark, tmp_path, query):
    spark.createDataFrame([(i, "a text " * 400) for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    model = next(i for i, x in enumerate(plan) if "ArrowEvalPython" in x)
    assert not any("collect_list" in x for x in plan[:model])  # what lies above has scores
