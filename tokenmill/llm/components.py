"""Connected components of an edge table, by alternating star contractions.

Each round, every node joins its larger neighbours to the least node it sees
(large star), then its smaller neighbours to their least (small star). Only
minima are aggregated, with map-side combining, so a hub with a third of all
edges costs its partial minima and a skew-split join; no neighbour list is
ever built. Rounds are checkpointed and grow with the logarithm of the
largest component. ``contracted`` spares rounds: each task first joins up what
its own edges say.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Edges to a task of ``contracted``, and the nodes at which a task passes on what it has.
TASK_EDGES = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        ends = [(x, r) for x in list(parent) if (r := root(x)) != x]
        a, b = zip(*ends) if ends else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > TASK_EDGES:
            yield stars()
            parent.clear()
    yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, but at most one for each node and task: what a
    task's own edges connect hangs on the least node there. No end may be null."""
    tasks = -(-edges.count() // TASK_EDGES)
    return edges.select("a", "b").coalesce(max(1, tasks)).mapInArrow(_forest, "a long, b long")


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def stars(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for each node that is not the least of its component.
    ``edges``: a, b, neither null."""
    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        # done when no node has two edges, and no root has one
        ends = (e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("held"))
                .unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("held"))))
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("held").alias("held")).filter("up > 1 or up = 1 and held = 1")
        if open_.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = settled(_small(_large(e)))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least node) for every node of the edges (columns a, b).

    Self-loops, repeated edges and both directions are fine; rows with a null end are ignored."""
    e = settled(edges.filter("a is not null and b is not null").select("a", "b"))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    return nodes.join(stars(e), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
