"""Similarity clusters of token sequences (K12): minhash bands, checked links, connected components.

Items are compared by the Jaccard similarity of their sets of ``n`` neighbouring
tokens. Every distinct item gets ``bands`` x ``rows`` minhashes (one md5 a gram,
the others by arithmetic). In each band, items with equal minhashes meet the
least item of their bucket only, never each other, so a bucket of any size costs
one row an item. A pair that meets is compared exactly; similar ones are linked,
and a cluster is a connected component of the links, named by its least item.

Equal items are clustered once and joined back. Two items of similarity s meet in
a band with probability s^rows: with 24 bands of 2 rows, 0.9999 at 0.6.

Edge cases: an item with fewer than ``n`` tokens is one gram; an empty or null
item is a cluster of its own (null: the cluster is null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, settle, unsettle

#: A prime above 2^32, for the minhash arithmetic in 64 bits.
PRIME = 4294967311


def hash_family(count: int) -> list[tuple[int, int]]:
    """(a, b) of the functions (a h + b) mod PRIME; a below 2^30, so that a h stays below 2^62."""
    out, x = [], 1
    for _ in range(count):
        x = x * 1103515245 + 12345 & 0x3FFFFFFF
        a = x | 1
        x = x * 1103515245 + 12345 & 0x3FFFFFFF
        out.append((a, x))
    return out


def grams(tokens: Column, n: int) -> Column:
    """The set of ``n`` neighbouring tokens as strings; the whole sequence if it is shorter; empty if it is empty."""
    size = F.size(tokens)
    at = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    return F.when(size > 0, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), "\u0001")))).otherwise(
        F.array().cast("array<string>"))


def minhashes(gram_col: str, count: int) -> Column:
    hashes = F.transform(F.col(gram_col), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))

    def least(a, b):
        return F.array_min(F.transform(hashes, lambda h: (h * a + b) % PRIME))

    return F.array(*[least(a, b) for a, b in hash_family(count)])


def similar_links(items: DataFrame, n: int, per_cent: int, bands: int, rows: int) -> DataFrame:
    """(u, v): v is the least item of a bucket of u, and they share ``per_cent`` of their grams. ``items``: item, grams."""
    signed = items.where(F.size("grams") > 0).select("item", minhashes("grams", bands * rows).alias("sig"))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(
        b.alias("band"), F.array_join(F.slice("sig", b * rows + 1, rows), "|").alias("bucket")))
    dealt = signed.select("item", F.explode(band).alias("b")).select("item", "b.band", "b.bucket")
    least = dealt.groupBy("band", "bucket").agg(F.min("item").alias("v"))
    met = dealt.join(least, ["band", "bucket"]).where("item <> v").select(F.col("item").alias("u"), "v").distinct()
    own, other = (items.select(F.col("item").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "uv")
    both = met.join(own, "u").join(other, "v")
    same = F.size(F.array_intersect("u_grams", "v_grams"))
    return both.where(100 * same >= per_cent * (F.size("u_grams") + F.size("v_grams") - same)).select("u", "v")


def components(links: DataFrame, items: DataFrame) -> DataFrame:
    """item, cluster: the least item of each connected component. Labels spread over links and then jump to
    the label of their label, until nothing changes."""
    links = settle(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(items.select("item", F.col("item").alias("cluster")))
    while True:
        near = (links.join(labels.select(F.col("item").alias("v"), F.col("cluster").alias("_c")), "v")
                .groupBy("u").agg(F.min("_c").alias("_c")).select(F.col("u").alias("item"), "_c"))
        spread = labels.join(near, "item", "left").select("item", F.col("cluster").alias("_old"), F.least("cluster", "_c").alias("cluster"))
        # the label's own label; read from the round's start, so that one table is enough
        jump = labels.select(F.col("item").alias("cluster"), F.col("cluster").alias("_further"))
        moved = settle(spread.join(jump, "cluster").select(
            "item", F.least("cluster", "_further").alias("cluster"), (F.least("cluster", "_further") < F.col("_old")).alias("_moved")))
        unsettle(labels)
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            unsettle(links)
            return labels


def similarity_clusters(df: DataFrame, item_col: str, tokens: Column, out_col: str = "cluster", n: int = 3, per_cent: int = 50,
                        bands: int = 24, rows: int = 2) -> DataFrame:
    """``df`` with ``out_col``, the least item of the item's cluster. ``tokens`` is a function of ``item_col`` alone."""
    items = cut_lineage(df.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), grams(tokens, n).alias("grams"))
                        .dropDuplicates(["item"]))
    found = components(similar_links(items, n, per_cent, bands, rows), items)
    found = found.select(F.col("item").alias("_item"), F.col("cluster").alias(out_col))
    return df.join(found, df[item_col] == F.col("_item"), "left").drop("_item")
