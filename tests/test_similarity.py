"""Similarity clusters: recall of near pairs, components, packing by cluster."""

import random

from pyspark.sql import functions as F

from tokenmill.functions import tokens as T
from tokenmill.functions import vocab as V
from tokenmill.operators import packing as K
from tokenmill.operators import similarity as S

PIECES = ["C", "N", "O", "c1ccccc1", "C(=O)", "[C@H]", "Cl", "Br", "=", "S", "F", "(C)", "%12", "[Na+]"]


def families(count, each, seed=4):
    """``each`` variants of ``count`` random molecules: one piece in the beginning, middle or end is another."""
    rng = random.Random(seed)
    out = []
    for f in range(count):
        base = [rng.choice(PIECES) for _ in range(24)]
        for k in range(each):
            own = list(base)
            own[(0, 12, 23)[k % 3]] = rng.choice(PIECES)
            out.append((f, "".join(own)))
    return out


def gram_set(tokens, n=3):
    return frozenset(tuple(tokens[i:i + n]) for i in range(max(1, len(tokens) - n + 1))) if tokens else frozenset()


def clustered(spark, rows):
    df = spark.createDataFrame([(i, s, "x") for i, (_, s) in enumerate(rows)], "mol_id long, smiles string, item string").repartition(4)
    return df, S.similarity_clusters(df, "smiles", T.smiles_tokens("smiles"))


def test_recall_of_near_pairs(spark):
    rows = families(40, 9)
    df, out = clustered(spark, rows)
    got = {r["smiles"]: r["cluster"] for r in out.collect()}
    tokens = {r["smiles"]: r["t"] for r in df.select("smiles", T.smiles_tokens("smiles").alias("t")).collect()}
    sets = {s: gram_set(t) for s, t in tokens.items()}
    items = sorted(sets)
    near = [(a, b) for i, a in enumerate(items) for b in items[:i] if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])]
    met = sum(got[a] == got[b] for a, b in near)
    assert len(near) > 300 and met >= 0.95 * len(near)
    # and clusters don't run together: items of one cluster are linked by similar ones, and there are many clusters
    assert len(set(got.values())) >= 35


def test_only_the_beginning_differs(spark):
    tail = "c1ccccc1C(=O)NCCO[C@H](C)Cl"
    _, out = clustered(spark, [(0, "Br" + tail), (0, "N" + tail), (1, "F%12S=S=S%12FFF"), (2, None), (3, ""), (4, "C"), (4, "C")])
    got = {r["smiles"]: r["cluster"] for r in out.collect()}
    assert out.columns == ["mol_id", "smiles", "item", "cluster"] and out.count() == 7
    assert got["N" + tail] == got["Br" + tail] == "Br" + tail and got[None] is None and got[""] == "" and got["C"] == "C"


def test_packed_together(spark):
    rows = families(3, 6)
    df, out = clustered(spark, rows)
    packed = K.pack_by_cluster(out, T.smiles_ids("smiles"), "cluster", ["mol_id"], 20, V.SMILES_EOS)
    sizes = {r["cluster"]: r["n"] for r in out.select("cluster", (F.size(T.smiles_ids("smiles")) + 1).alias("k"))
             .groupBy("cluster").agg(F.sum("k").alias("n")).collect()}
    blocks = {r["cluster"]: r["n"] for r in packed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    assert blocks == {c: n // 20 for c, n in sizes.items() if n >= 20}


def test_components_of_a_long_chain(spark):
    names = [f"i{k:03d}" for k in range(60)]
    rng = random.Random(1)
    order = names[:]
    rng.shuffle(order)
    items = spark.createDataFrame([(x,) for x in names + ["z"]], "item string")
    links = spark.createDataFrame(list(zip(order, order[1:])), "u string, v string")
    got = {r["item"]: r["cluster"] for r in S.components(links, items).collect()}
    assert got == {**{x: "i000" for x in names}, "z": "z"}
    assert {r["cluster"] for r in S.components(links.limit(0), items).collect()} == set(names + ["z"])
