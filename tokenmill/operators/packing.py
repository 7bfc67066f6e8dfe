"""Packing and sequence shaping.

The wrapped packer (K1) never explodes to one row per token: rows are put in
order by one range exchange, each task cuts its range at the block boundaries,
and only the pieces of blocks that straddle ranges are shuffled again
(``rangepack``). A document longer than a block fills as many as it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from .offsets import row_index
from .rangepack import pack_ranges


def pack_wrapped(df: DataFrame, ids: Column, order_cols: Sequence[str], block_size: int,
                 bos: int, eos: int, insert_special: bool = True,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """K1/K2: concatenate ``ids`` in ``order_cols`` order (per ``group_cols``),
    cut into chunks of ``block_size-2`` (or ``block_size`` without specials),
    drop the incomplete remainder, wrap ``[BOS] chunk [EOS]``.

    ``ids`` is evaluated once, before the one exchange that carries it (``rangepack``). Rows that share an order
    key, or have none, keep their tokens: they follow each other by the hash of their ids.
    Returns ``(*group_cols, block_id, input_ids, attention_mask)``.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    chunk = block_size - 2 if insert_special else block_size
    rows = df.select(*dict.fromkeys([*group_cols, *order_cols]), ids.cast("array<int>").alias("_t"))
    blocks = pack_ranges(rows, group_cols, order_cols, chunk, text=False)
    return _wrapped(blocks, F.col("_body"), group_cols, block_size, bos, eos, insert_special)


def _wrapped(blocks: DataFrame, body: Column, group_cols: Sequence[str], block_size: int, bos: int, eos: int,
             insert_special: bool) -> DataFrame:
    input_ids = F.concat(F.array(F.lit(bos)), body, F.array(F.lit(eos))) if insert_special else body
    return blocks.select(*group_cols, F.col("block_id").cast("long").alias("block_id"),
                         input_ids.alias("input_ids"), T.ones_mask(block_size).alias("attention_mask"))


def pack_chars(df: DataFrame, text_col: str, order_cols: Sequence[str], block_size: int,
               bos: int, eos: int, insert_special: bool = True, insert_eos: bool = True,
               group_cols: Sequence[str] = (), in_order: bool = False) -> DataFrame:
    """K1/K2 for the character tokenizer, packed as text.

    Character tokens are the code points of the lower-cased text, so the
    corpus can be concatenated and cut as *strings* (EOS is one sentinel code
    point): lengths come from ``char_length`` without tokenising, the one
    exchange carries about a byte per token instead of an int array, and
    each finished block is tokenised once. Same rows as ``pack_wrapped`` with
    ``char_ids`` + EOS. Rows that lie in order (``in_order``, see ``pack_ranges``)
    are not exchanged at all."""
    group_cols, order_cols = list(group_cols), list(order_cols)
    chunk = block_size - 2 if insert_special else block_size

    def prepare(raw: Column) -> Column:
        t = F.replace(F.coalesce(F.lower(raw), F.lit("")), F.lit(T.EOS_CHAR), F.lit(""))
        return F.concat(t, F.lit(T.EOS_CHAR)) if insert_eos else t

    rows = df.select(*dict.fromkeys([*group_cols, *order_cols]), F.col(text_col).alias("_t"))
    blocks = pack_ranges(rows, group_cols, order_cols, chunk, text=True, prepare=prepare, in_order=in_order)
    return _wrapped(blocks, T.char_ids_of_lowered(F.col("_body")), group_cols, block_size, bos, eos, insert_special)


def contiguous_shards(df: DataFrame, idx_col: str, n_rows: int, num_shards: int,
                      batch_rows: int) -> DataFrame:
    """Contiguous shard and in-shard batch of each row (the parallel map layout:
    ``num_shards`` contiguous shards, the first ``n % num_shards`` one row longer,
    batches of ``batch_rows`` rows inside each shard)."""
    div, mod = divmod(n_rows, num_shards)
    idx = F.col(idx_col)
    cut = (div + 1) * mod
    shard = F.when(idx < cut, F.floor(idx / (div + 1))).otherwise(
        F.lit(mod) + F.floor((idx - cut) / F.lit(max(div, 1))))
    sh = F.col("shard")
    start = sh * div + F.least(sh, F.lit(mod))
    return (df.withColumn("shard", shard.cast("long"))
            .withColumn("batch", F.floor((idx - start) / batch_rows).cast("long")))


def pack_wrapped_batched(df: DataFrame, ids: Column, order_cols: Sequence[str], block_size: int,
                         bos: int, eos: int, insert_special: bool = True,
                         num_shards: int = 1, batch_rows: int = 1000) -> DataFrame:
    """K3: K1 with the remainder dropped per (contiguous shard, ``batch_rows`` batch),
    as the batched parallel map of the reference does. Blocks are numbered
    inside each (shard, batch)."""
    order_cols = list(order_cols)
    idx = row_index(df.select(*order_cols), order_cols, out_col="_idx")
    n_rows = idx.count()  # one scalar to size the shards
    sb = contiguous_shards(idx, "_idx", n_rows, num_shards, batch_rows).drop("_idx")
    tagged = df.join(sb, on=order_cols, how="inner")
    return pack_wrapped(tagged, ids, order_cols, block_size, bos, eos, insert_special, group_cols=["shard", "batch"])


# ---------------------------------------------------------------------- K5 --
def build_fixed_rows(df: DataFrame, ids: Column, block_size: int, bos: int, eos: int, pad: int,
                     insert_special: bool = True) -> DataFrame:
    """K5 (+P9): keep rows with ``len <= block_size-2`` (or ``block_size``),
    wrap ``[BOS] ids [EOS]``, right-pad with ``pad``, mask 1 for real tokens."""
    max_len = block_size - 2 if insert_special else block_size
    with_ids = df.withColumn("_ids", ids)
    kept = with_ids.where(F.size("_ids") <= max_len)
    seq = T.add_special_single("_ids", bos, eos) if insert_special else F.col("_ids")
    n_real = F.size("_ids") + (2 if insert_special else 0)
    return (kept.withColumn("input_ids", T.pad_tokens(seq, block_size, pad))
            .withColumn("attention_mask", T.attention_mask("input_ids", n_real=n_real))
            .drop("_ids"))


def build_fixed_rows_observed(df: DataFrame, ids: Column, block_size: int, bos: int, eos: int, pad: int,
                              insert_special: bool = True):
    """K5 + P10 in the same pass: the input and output row counts are
    collected as Spark observations while the rows are produced (no second
    scan). Returns (rows, accounting()); call accounting() after an action
    on the rows: {original, kept, dropped, ratio_pct}."""
    from pyspark.sql import Observation
    seen, kept = Observation("fixed_rows_in"), Observation("fixed_rows_out")
    src = df.observe(seen, F.count(F.lit(1)).alias("n"))
    out = build_fixed_rows(src, ids, block_size, bos, eos, pad, insert_special).observe(
        kept, F.count(F.lit(1)).alias("n"))

    def accounting() -> dict:
        n_in, n_out = seen.get["n"], kept.get["n"]
        dropped = max(n_in - n_out, 0)
        return {"original": n_in, "kept": n_out, "dropped": dropped,
                "ratio_pct": (dropped / n_in * 100.0) if n_in else 0.0}

    return out, accounting


# ---------------------------------------------------------------------- K6 --
def chunk_text(df: DataFrame, text_col: str, size: int, drop_last: bool = False,
               keep: Sequence[str] = ()) -> DataFrame:
    """K6: split a long string into ``size``-character chunks (code points), in
    one linear regex pass (a very long page is not rescanned per chunk)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    chunks = F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % size), 0)
    out = df.select(*keep, F.posexplode(chunks).alias("chunk_idx", "chunk"))
    if drop_last:
        out = out.where(F.char_length("chunk") == size)
    return out


# ---------------------------------------------------------------------- K7 --
def crop_subsequence(df: DataFrame, ids_col: str, mask_col: str, n: int, start: Column,
                     bos: int | None = None, eos: int | None = None) -> DataFrame:
    """K7: rows of 2n tokens -> window [start, start+n) as input, shifted by one as
    target; with ``bos``/``eos`` the first input is forced to BOS and the last
    target to EOS. ``start`` is a per-row Column (one draw per batch)."""
    s = start.cast("int")
    inp = F.slice(F.col(ids_col), s + 1, n)
    tgt = F.slice(F.col(ids_col), s + 2, n)
    if bos is not None:
        inp = F.concat(F.array(F.lit(bos)), F.slice(inp, 2, n - 1))
    if eos is not None:
        tgt = F.concat(F.slice(tgt, 1, F.size(tgt) - 1), F.array(F.lit(eos)))
    others = [c for c in df.columns if c not in (ids_col, mask_col, "input_ids", "target_ids", "attention_mask")]
    return df.select(*others, s.alias("_s"), inp.alias("input_ids"), tgt.alias("target_ids"),
                     F.slice(F.col(mask_col), s + 1, n).alias("attention_mask"))


# ---------------------------------------------------------------------- K8 --
def shift_targets(ids, mask=None) -> dict[str, Column]:
    """K8: next-token pairs: input x[:-1], target x[1:], mask[1:]."""
    a = F.col(ids) if isinstance(ids, str) else ids
    out = {"input_ids": F.slice(a, 1, F.size(a) - 1), "target_ids": F.slice(a, 2, F.size(a) - 1)}
    if mask is not None:
        m = F.col(mask) if isinstance(mask, str) else mask
        out["target_mask"] = F.slice(m, 2, F.size(m) - 1)
    return out


# ---------------------------------------------------------------------- K9 --
def split_into_blocks(df: DataFrame, arr_col: str, block: int, keep: Sequence[str] = (),
                      values_col: str | None = None) -> DataFrame:
    """K9: one row per block of ``block`` positions; with ``values_col`` (an
    array of doubles of the same length) also the per-block mean. The blocks are cut before they become rows: Spark holds
    the rows made of one row together, and none of them may carry the whole array."""
    a = F.col(arr_col)
    nb = F.floor(F.size(a) / block)
    starts = F.when(nb > 0, F.sequence(F.lit(0), (nb - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def cut(i: Column) -> Column:
        cols = [i.alias("block_id"), F.slice(a, i * block + 1, block).alias("block_ids")]
        if values_col:
            vs = F.slice(values_col, i * block + 1, block)
            cols.append((F.aggregate(vs, F.lit(0.0), lambda acc, x: acc + x) / block).alias("block_mean"))
        return F.struct(*cols)

    return df.select(*keep, F.inline(F.transform(starts, cut)))


# --------------------------------------------------------------------- K10 --
def block_context_ranges(blocks: DataFrame, seq_col: str, block_col: str) -> DataFrame:
    """K10/J5, re-aimed: instead of emitting every (query block, context block)
    pair, emit for each query block the contiguous *range* of context blocks it
    sees, per relation:

    * noisy block b -> noisy block b (block diagonal)        kv = [b, b]
    * noisy block b -> clean blocks < b (offset block-causal) kv = [0, b-1]
    * clean block b -> clean blocks <= b (block causal)       kv = [0, b]

    Output rows grow linearly with the blocks, the same information as the
    quadratic pair list (a pair (q, k) is present iff kv_lo <= k <= kv_hi).
    """
    b = F.col(block_col).cast("long")
    rels = F.array(
        F.struct(F.lit("noisy").alias("q_kind"), F.lit("noisy").alias("kv_kind"), b.alias("kv_lo"), b.alias("kv_hi")),
        F.struct(F.lit("noisy").alias("q_kind"), F.lit("clean").alias("kv_kind"), F.lit(0).cast("long").alias("kv_lo"), (b - 1).alias("kv_hi")),
        F.struct(F.lit("clean").alias("q_kind"), F.lit("clean").alias("kv_kind"), F.lit(0).cast("long").alias("kv_lo"), b.alias("kv_hi")),
    )
    out = blocks.select(F.col(seq_col), b.alias("q_block"), F.explode(rels).alias("r"))
    return (out.select(seq_col, "q_block", "r.q_kind", "r.kv_kind", "r.kv_lo", "r.kv_hi")
            .where(F.col("kv_hi") >= F.col("kv_lo"))
            .withColumn("n_kv_blocks", F.col("kv_hi") - F.col("kv_lo") + 1))


# --------------------------------------------------------------------- K11 --
def unpack_by_eos(df: DataFrame, ids_col: str, eos: int, keep: Sequence[str] = ()) -> DataFrame:
    """Cut a sequence at every EOS into items (EOS removed). The piece after
    the last EOS is returned with ``complete = false`` (it continues elsewhere);
    empty pieces are skipped."""
    a = F.col(ids_col)
    eos_pos = F.filter(F.transform(a, lambda x, i: F.when(x == eos, i).otherwise(-1)), lambda p: p >= 0)
    ends = F.concat(eos_pos, F.array(F.size(a)))
    starts = F.concat(F.array(F.lit(0)), F.transform(eos_pos, lambda p: p + 1))
    items = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                        lambda z: F.struct(F.slice(a, z["s"] + 1, z["e"] - z["s"]).alias("item"),
                                           (z["e"] < F.size(a)).alias("complete")))
    out = df.select(*keep, F.posexplode(items).alias("item_idx", "z"))
    return (out.select(*keep, "item_idx", F.col("z.item").alias("item"), F.col("z.complete").alias("complete"))
            .where(F.size("item") > 0))


# --------------------------------------------------------------------- K12 --
def pack_by_cluster(df: DataFrame, ids: Column, cluster_col: str, order_cols: Sequence[str],
                    block_size: int, eos: int) -> DataFrame:
    """Pack items of the same cluster together, EOS between items, no
    BOS/EOS wrapping, remainder per cluster dropped. Offsets are computed per
    cluster with the two-pass prefix sum, so a cluster holding a third of the
    rows is still split over many tasks."""
    return pack_wrapped(df, T.append_eos(ids, eos), order_cols, block_size, bos=0, eos=eos,
                        insert_special=False, group_cols=[cluster_col])
