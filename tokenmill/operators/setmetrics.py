"""Set-level metrics of generated molecule strings (A14-A17, U-1, J3).

Validity comes from a pluggable scorer column; the built-in rule below is a
necessary (not sufficient) well-formedness check written with Spark
built-ins: the string is fully covered by the molecule token pattern,
parentheses nest, every ring label is opened and closed (even count), and
it is not empty. Canonical form defaults to the cleaned string.

Diversity (A16) is re-aimed so that it needs no pair list: it is
1 - mean pairwise cosine (Ochiai) similarity of the items' token-bigram
sets. With unit vectors u_i, sum_{i != j} cos(i, j) = |sum_i u_i|^2 - sum_i |u_i|^2,
and |sum_i u_i|^2 = sum over bigrams g of (sum_i u_ig)^2: one aggregation by
bigram, linear in the data, exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _named(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once, however often ``of`` uses it, also inside its own lambdas."""
    return F.get(F.transform(F.array(value), of), 0)


def well_formed(smiles) -> Column:
    """Built-in validity rule (see module doc)."""
    return _named(F.coalesce(_c(smiles), F.lit("")), lambda s: _named(T.smiles_tokens(s, None), lambda toks: _well_formed(s, toks)))


def _well_formed(s: Column, toks: Column) -> Column:
    covered = F.array_join(toks, "") == s
    depth = F.aggregate(
        toks, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda acc, t: F.struct(
            (acc["d"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("d"),
            (acc["ok"] & ((acc["d"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)) >= 0)).alias("ok")))
    parens = _named(depth, lambda d: d["ok"] & (d["d"] == 0))
    rings_closed = _named(
        F.filter(toks, lambda t: t.rlike("^(%[0-9]{2}|[0-9])$")),
        lambda rings: F.forall(F.array_distinct(rings), lambda r: F.pmod(F.size(F.filter(rings, lambda x: x == r)), F.lit(2)) == 0))
    return (F.length(s) > 0) & covered & parens & rings_closed


def set_metrics(items: DataFrame, item_col: str, valid_col: str, n_target: int | None = None,
                qed_col: str | None = None, sa_col: str | None = None) -> DataFrame:
    """A14, A15, A17 in one pass: validity = valid / n_target (n_target >= 1),
    uniqueness = distinct valid / valid (0 when none), quality = valid with
    qed >= 0.6 and sa <= 4.0 over n_target. Without ``n_target`` the number
    of items is the target, counted in the same aggregate."""
    v = F.col(valid_col)
    aggs = [F.count_if(v).alias("n_valid"),
            F.count_distinct(F.when(v, F.col(item_col))).alias("n_unique"),
            F.count(F.lit(1)).alias("n_items")]
    if qed_col and sa_col:
        aggs.append(F.count_if(v & (F.col(qed_col) >= 0.6) & (F.col(sa_col) <= 4.0)).alias("n_quality"))
    else:
        aggs.append(F.lit(0).cast("long").alias("n_quality"))
    a = items.agg(*aggs)
    nt = F.lit(max(int(n_target), 1)) if n_target is not None else F.greatest(F.col("n_items"), F.lit(1))
    return a.select(
        (F.col("n_valid") / nt).alias("validity"),
        F.when(F.col("n_valid") > 0, F.col("n_unique") / F.col("n_valid")).otherwise(0.0).alias("uniqueness"),
        (F.col("n_quality") / nt).alias("quality"),
        "n_valid", "n_unique", "n_quality")


def distinct_items(items: DataFrame, item_col: str, valid_col: str) -> DataFrame:
    """U-1: distinct valid canonical items."""
    return items.where(F.col(valid_col)).select(item_col).dropDuplicates()


def bigram_set(tokens) -> Column:
    """Distinct token bigrams of an item ('a b' strings)."""
    return _named(_c(tokens), _bigrams)


def _bigrams(t: Column) -> Column:
    n = F.size(t)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def diversity(distinct: DataFrame, item_col: str) -> DataFrame:
    """A16 (re-aimed, see module doc): 1 - mean pairwise cosine similarity of
    bigram sets over the distinct valid items; 0 when fewer than 2 items. The items are read once: beside a row a
    bigram each gives one row without a bigram, by which the items are counted."""
    with_b = distinct.select(bigram_set(T.smiles_tokens(F.col(item_col), None)).alias("_g"))

    def row(g, w, item, nz):
        return F.struct(g.cast("string").alias("g"), w.cast("double").alias("w"), item.cast("int").alias("item"), nz.cast("int").alias("nz"))

    # each item contributes 1/sqrt(k) to each of its k bigrams
    w = F.lit(1.0) / F.sqrt(F.greatest(F.size("_g"), F.lit(1)))
    own = F.array(row(F.lit(None), F.lit(0), F.lit(1), F.size("_g") > 0))
    rows = with_b.select(F.inline(F.concat(own, F.transform("_g", lambda g: row(g, w, F.lit(0), F.lit(0))))))
    per_gram = rows.groupBy("g").agg(F.sum("w").alias("s"), F.sum("item").alias("item"), F.sum("nz").alias("nz"))
    both = per_gram.agg(F.sum("item").alias("n"), F.sum("nz").alias("n_nz"), F.sum(F.col("s") * F.col("s")).alias("sum_sq"))
    nn = F.col("n").cast("double")
    mean_sim = (F.coalesce(F.col("sum_sq"), F.lit(0.0)) - F.col("n_nz")) / (nn * (nn - 1))
    return both.select(F.when(F.col("n") >= 2, F.lit(1.0) - mean_sim).otherwise(F.lit(0.0)).alias("diversity"),
                       F.col("n").alias("n_distinct"))
