"""Order statistics, histograms, moving averages and bounded redraws against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import corrupt as C
from tokenmill.operators import metrics as M
from tokenmill.operators import quantiles as Q
from tokenmill.operators.ema import ema


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 7, list(range(1000)), [1.0] * 500 + [9.0, 2.5, -4.0]])
def test_summary_equals_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    qs = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    row = Q.summary(Q.value_counts(df, "x"), qs).first()
    assert row["count"] == len(values) and (row["min"], row["max"]) == (min(values), max(values))
    assert np.allclose(row["q"], np.quantile(values, qs), rtol=1e-12, atol=1e-12) and math.isclose(row["mean"], np.mean(values))
    assert row["std"] is None if len(values) == 1 else math.isclose(row["std"], np.std(values, ddof=1), abs_tol=1e-12)


def test_groups_with_a_null_key_and_a_hot_one(spark):
    rng = random.Random(2)
    rows = [("hot", rng.random()) for _ in range(3000)] + [(None, float(i)) for i in range(11)] + [("one", 4.0), ("none", None)]
    out = Q.summary(Q.value_counts(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]), [0.5])
    got = {r["_g"]["g"]: (r["count"], r["q"][0]) for r in out.collect()}
    hot = [x for g, x in rows if g == "hot"]
    assert got == {"hot": (3000, pytest.approx(np.median(hot))), None: (11, 5.0), "one": (1, 4.0)}


def test_histogram_reads_the_data_once_and_no_values_give_no_bins(spark):
    values = [0.0, 1.0, 1.0, 2.5, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "n double")
    out = M.length_histogram(df, "n", 5).orderBy("bin").collect()
    assert [r["count"] for r in out] == [3, 1, 0, 0, 1] and [r["lo"] for r in out] == [0, 2, 4, 6, 8]
    none = spark.createDataFrame([], "n double")
    assert M.length_histogram(none, "n").collect() == [] and M.length_quantiles(none, "n").first()[0] is None
    row, hist = M.length_stats(none, "n")
    assert row["count"] == 0 and hist.collect() == []
    row, hist = M.length_stats(df, "n", bins=5)
    assert row["count"] == 5 and {r["bin"]: r["count"] for r in hist.collect()} == {1: 3, 2: 1, 5: 1}


def test_many_distinct_values_spread_over_tasks(spark):
    """No task of the plan holds all values: no percentile buffer and no single partition over rows."""
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("x"))
    counts = Q.value_counts(df, "x")
    row = Q.summary(counts, [0.5, 0.999]).first()
    values = [i * 7919 % 1_000_003 for i in range(200_000)]
    assert np.allclose(row["q"], np.quantile(values, [0.5, 0.999]))
    text = plan(Q.summary(counts, [0.5]))
    assert "percentile" not in text


# moving averages

def series():
    rng = random.Random(11)
    rows = [("hot", i, rng.random()) for i in range(700)] + [(f"k{j}", i, rng.random()) for j in range(9) for i in range(5)]
    rows += [(None, i, float(i)) for i in range(4)] + [("gaps", i, None if i % 3 else float(i)) for i in range(9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("decay, fan", [(0.9, 4), (0.9999, 256), (1.0, 16), (0.0, 16)])
def test_ema_is_the_recurrence(spark, decay, fan):
    rows = series()
    out = ema(spark.createDataFrame(rows, "key string, step long, x double").repartition(5), "x", ["step"], ["key"], decay, init=0.5, fan=fan)
    assert out.columns == ["key", "step", "x", "ema"]
    got = {(r["key"], r["step"]): r["ema"] for r in out.collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        s, n = 0.5, 0
        for k, i, x in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if x is not None:
                n += 1
                s -= (1 - min(decay, (1 + n) / (10 + n))) * (s - x)
            assert math.isclose(got[k, i], s, rel_tol=1e-11, abs_tol=1e-14)


def test_ema_runs_no_python(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "key string, step long, x double")
    assert "Python" not in plan(ema(df, "x", ["step"], ["key"])) and ema(df.limit(0), "x", ["step"], ["key"]).collect() == []


# bounded redraws

def blocks(spark, rows):
    return spark.createDataFrame(rows, "s long, off long, ids array<int>, p double")


def shares(rows, mask=18):
    return [sum(x == mask for x in r["xt"]) / len(r["xt"]) for r in rows]


@pytest.mark.parametrize("p", [0.0, 1.0, 1e-12, 1 - 1e-12, 0.5, 0.01])
def test_every_level_ends_inside_the_bounds(spark, p):
    df = blocks(spark, [(i, 0, [20, 21, 22, 23, 24, 25, 26, 27], p) for i in range(40)])
    out = C.resample_bounds(df, "ids", "p", 1, "s", "off", 18, 0.25, 0.75, attempts=3).collect()
    assert len(out) == 40 and all(0.25 <= x <= 0.75 for x in shares(out))
    assert all(y in (x, 18) for r in out for x, y in zip(r["ids"], r["xt"]))
    if p in (0.0, 1e-12):
        assert {r["attempt"] for r in out} == {-1} and set(shares(out)) == {0.25}
    if p in (1.0, 1 - 1e-12):
        assert set(shares(out)) == {0.75}


def test_levels_and_blocks_without_an_answer(spark):
    rows = [(1, 0, [20, 21], None), (2, 0, [], 0.5), (3, 0, None, 0.5), (4, 0, [20], 0.5), (5, 0, [18, 18, 18, 20], 0.0), (6, 0, [18, 18, 20, 21], 0.0)]
    got = {r["s"]: r for r in C.resample_bounds(blocks(spark, rows), "ids", "p", 1, "s", "off", 18, 0.25, 0.75).collect()}
    assert all(got[s]["attempt"] is None and got[s]["xt"] is None for s in (1, 2, 3, 4))
    assert got[5]["attempt"] == 0 and got[6]["xt"] == [18, 18, 20, 21]


def test_drawn_counts_follow_the_truncated_binomial(spark):
    n, p, lo, hi = 8, 0.2, 4, 6
    df = blocks(spark, [(i, 0, [20] * n, p) for i in range(6000)])
    # no attempt at all is allowed to decide: every block is drawn
    got = C.resample_bounds(df, "ids", "p", 3, "s", "off", 18, lo / n, hi / n, attempts=1).where("attempt = -1")
    counts = {k: c for k, c in got.groupBy(F.size(F.filter("xt", lambda x: x == 18)).alias("k")).count().collect()}
    weights = {k: math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(lo, hi + 1)}
    total, mass = sum(counts.values()), sum(weights.values())
    assert set(counts) <= set(weights) and all(abs(counts.get(k, 0) / total - w / mass) < 0.02 for k, w in weights.items())
