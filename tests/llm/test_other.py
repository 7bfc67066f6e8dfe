"""Search, toxicity, URL filter, components and the pipeline against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tokenmill.llm import components as C
from tokenmill.llm import topk, toxicity, urls

from .fixtures import frame, texts


def test_topk(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.choice([-1, 1]) * rng.random() for _ in range(8)]) for i in range(700)]
    rows += [(700, None), (701, [None] * 8), (800, [nan] * 8), (900, [inf] * 8), (3, rows[3][1]), (1000, rows[5][1]), (1001, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("x")).withColumn("score", F.lit(1))
    out = topk.search(df, F.col("vec_id") % 100 == 0, k=10, block_rows=200)
    q = [(i, v, [int(1024 * x // 1) for x in v]) for i, v in rows if v and all(x is not None and abs(x) < 9 for x in v)]
    want = []
    for n, (i, _, a) in enumerate(q):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for m, (j, _, b) in enumerate(q) if m != n)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    few = topk.search(df.filter("vec_id in (100, 200, 300)"), F.col("vec_id") == 100)
    assert few.count() == 2
    assert topk.search(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(200)] + \
        [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_url_rules_and_aliases(spark):
    canon = '<link href="{}" rel="x"><link rel="canonical" href="{}">'
    move = "<meta http-equiv='refresh' content='0; URL={}'>"
    rows = [
        (1, "http://A.Example.NET/en/1?q#f", None), (2, "https://x.net/a", ""), (3, "https://x.net", "plain"), (4, None, None),
        (5, "no scheme", "x"), (6, "http://example.com/de/x", None), (7, "http://example.comx/de/x", None),
        (8, "http://a.org/p", canon.format("/z", "http://b.net/q")),  # alias of a blocked url
        (9, "http://c.org/p", move.format("http://a.org/p")),  # and through it
        (10, "http://d.org/p", canon.format("", "http://b.net/r")), (11, "http://e.org/fr/1", canon.format("", "http://b.net/r")),
        (12, "http://b.net/r", None), (13, "http://f.org/p", move.format("/p2")), (13, "http://f.org/p", move.format("/p2")),
        (14, "http://g.org/a?x=http://n.net/", None), (15, "http://n.net?/en/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("rule", F.lit("r"))
    out = {r["page_id"]: r for r in urls.judge(df, RULES).collect()}
    said = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in out.items()}
    assert said == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("x.net", "/a", "net/", "block"), 3: ("x.net", "", None, "allow"),
        4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("example.com", "/de/x", "example.com/de/", "block"),
        7: ("example.comx", "/de/x", None, "allow"), 8: ("a.org", "/p", None, "block"), 9: ("c.org", "/p", None, "block"),
        10: ("d.org", "/p", None, "allow"),  # its class holds an allowed url
        11: ("e.org", "/fr/1", "org/fr/", "allow"), 12: ("b.net", "/r", "net/", "block"), 13: ("f.org", "/p", None, "allow"),
        14: ("g.org", "/a", None, "allow"), 15: ("n.net", "", None, "allow")}
    assert urls.judge(df, RULES).count() == len(rows)
    assert urls.judge(df.filter("page_id < 0"), RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(df, []).collect()} == {"allow"}


def _labelled(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rude = ["grumpel", "snarfo", "bletcher"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        bad = i % 8 == 0
        for _ in range(rng.randint(1, 5) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(rude) + rng.choice(["", "s", "en"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = _labelled(1200, 2)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, None), (5000, ""), (0, rows[0][1])])
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows if i % 2 == 0 or i % 8 == 1][:700] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.severity(docs, labels).collect()}
    wrong = [i for i, _, b in rows if out[i]["rejected"] != bool(b)]
    assert len(wrong) <= 12, wrong
    assert not out[None]["rejected"] and not out[5000]["rejected"] and 0 <= out[0]["severity"] <= 2
    mean = lambda lo, hi: sum(x) / len(x) if (x := [out[i]["severity"] for i, t, b in rows if b and lo <= sum(w.startswith(("grum", "snar", "blet")) for w in t.split()) <= hi]) else 0
    assert mean(4, 5) > mean(1, 1)  # severity grows with the cues
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in toxicity.severity(docs, labels).collect())


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, texts()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["severity"], r["rejected"]) for r in toxicity.severity(docs, none).collect()} == {(0.0, False)}
    assert toxicity.clean(docs.filter("doc_id < 0"), none).count() == 0


def test_ordinal_thresholds_are_ordered():
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 600)
    grade = np.clip(x - 1, 0, 2)
    w, cut = toxicity.fit_ordinal(np.arange(600), np.zeros(600, int), x, grade, 1)
    assert w[0] > 0 and cut[0] < cut[1]
    p = toxicity.OrdinalModel(np.zeros(1, np.uint32), w, cut).at_least(w[0] * np.arange(4.0))
    assert (np.diff(p.sum(axis=1)) > 0).all()


@pytest.mark.parametrize("rows", [texts(), []])
def test_pipeline_stages(spark, tmp_path, rows):
    import corpus_pipeline as P

    from .fixtures import jaccard_components, kept_bytes, key, substring_cuts, words
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, rows)
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append([(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else docs.collect())
        if name != "packing":
            assert docs.columns == columns
    assert len(seen[0]) == len(rows)
    body = [" ".join((t or "").split(" ")) for _, t in seen[1]]
    assert len(seen[1]) <= len(rows) and len(body) == len({" ".join(words(t)) + str(t) for t in body})
    ids = {d for d, _ in seen[2] if d is not None}
    assert ids == {c for d, _, c in jaccard_components(seen[1], 5, 80) if d is not None and c is not None}
    def left(d, t):
        """What stays of a row's text: all of it, or the kept bytes that are whole characters."""
        (_, _, gone, _, _), = [c for c, row in zip(substring_cuts(seen[2]), seen[2]) if row == (d, t)][:1]
        return t if not gone else kept_bytes(seen[2], d, t).decode("utf-8", "ignore")

    assert sorted(seen[3], key=key) == sorted(((d, left(d, t)) for d, t in seen[2]), key=key)
    assert {r["doc_id"] for r in seen[4]} == {d for d, _ in seen[3]}


@pytest.mark.parametrize("most", [3, 100_000])
def test_contracted_edges_keep_components(spark, monkeypatch, most):
    monkeypatch.setattr(C, "TASK_EDGES", most)
    pairs = [(i, i + 1) for i in range(40, 60)] + [(7, 100 + i) for i in range(30)] + [(5, 3), (3, 5), (9, 9)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in C.stars(C.contracted(edges)).collect()}
    assert got == {**{i: 40 for i in range(41, 61)}, **{100 + i: 7 for i in range(30)}, 5: 3}
    assert C.stars(C.contracted(edges.limit(0))).count() == 0
