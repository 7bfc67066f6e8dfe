"""One-call entry points composed from the operators: a prepared corpus by
name (the data-preparation call of a training job) and the rows one replica
reads in one epoch (shuffle, pad, shard, batch, resume)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocab as V
from ..functions.pluggable import pluggable_ids
from ..operators import packing as K
from ..operators import sampling as L
from ..operators.offsets import row_index
from ..sources import corpus as C
from ..sources import sinks as S


def prepare_corpus(spark: SparkSession, name: str, path: str, mode: str = "train", wrap: bool = True,
                   block_size: int = 1024, tokenizer: str = "char", insert_eos: bool = True,
                   insert_special: bool = True, order_cols: Sequence[str] = ("id",),
                   cache_root: str | None = None, encoder: Callable | None = None,
                   special_ids: dict | None = None, vocab_path: str | None = None, holdout: int | None = None,
                   splits: Sequence[tuple] | None = None) -> DataFrame:
    """Read corpus ``name`` at ``path``, detokenise, tokenise and pack/pad it.

    ``tokenizer``: 'char' (27-character vocabulary), 'smiles' (molecule
    regex + the vocabulary file ``vocab_path``, a token a line, its special
    tokens in any place; without one the built-in first lines) or 'custom' (``encoder`` factory for the
    plug-in UDF, ``special_ids`` = {bos, eos, cls, sep, pad}).
    Wrapped: concatenate, EOS after each item (``insert_eos``), cut into
    ``block_size`` rows with [BOS]/[EOS] (``insert_special``); the training
    split of 'text8-crop' doubles the block. Unwrapped: molecules keep rows
    with at most ``block_size - 2`` tokens and pad; text is truncated and
    padded to ``block_size`` with [CLS]/[SEP] ('lambada': no padding).
    ``mode`` names the split (``sources.corpus.scan_corpus``): rows of that ``split`` column where the table has one;
    for 'text8' and 'text8-crop', whose ``path`` is the raw text (a file, or a folder of its parts), the chunks
    between the offsets ``splits`` (default: the published ones), in which ``id`` is the chunk's number;
    'openwebtext-train' and 'openwebtext-valid' are all but the last ``holdout`` rows and these alone
    (``sources.corpus.HOLDOUT_ROWS`` in the published corpus; None: the whole table).
    With ``cache_root`` the result is materialised under a key of every
    parameter that changes the rows and reused when present.
    """
    vocab = None
    if tokenizer == "char":
        ids_of = T.char_ids
        sp = {"bos": V.CHAR_BOS, "eos": V.CHAR_EOS, "cls": V.CHAR_CLS, "sep": V.CHAR_SEP, "pad": V.CHAR_PAD}
    elif tokenizer == "smiles":
        # ids of the special tokens, [UNK] among them, are those of the file
        vocab = C.load_vocab(spark, vocab_path) if vocab_path else V.Vocabulary(V.SMILES_VOCAB)
        sp = vocab.specials()

        def ids_of(col):
            return T.smiles_ids(col, vocab, vocab.unk)
    else:
        if encoder is None or special_ids is None:
            raise ValueError("a custom tokenizer needs an encoder factory and its special ids")

        def ids_of(col):
            return pluggable_ids(F.col(col) if isinstance(col, str) else col, encoder)
        sp = special_ids
    # without specials the blocks carry no [BOS]/[EOS] wrap; EOS after each item
    # still follows ``insert_eos`` (only the cache key changes)
    if name == "text8-crop" and mode == "train":
        block_size *= 2

    def build() -> DataFrame:
        spec = C.corpus_spec(name)
        picked = mode if spec.form in ("column", "offsets") or holdout is not None else None
        # the cropped training text comes in chunks of twice its block
        chunk = block_size * 2 if name == "text8-crop" and mode == "train" else block_size
        df = C.scan_corpus(spark, name, path, mode=picked, order_cols=order_cols, chunk=chunk, holdout=holdout or 0,
                           splits=splits)
        if wrap:
            if tokenizer == "char":
                # the chunks of a raw text are read in the order of their numbers
                return K.pack_chars(df, "text", order_cols, block_size, sp["bos"], sp["eos"], insert_special,
                                    insert_eos, in_order=spec.form == "offsets" and list(order_cols) == ["id"])
            ids = ids_of("text")
            if insert_eos:
                ids = T.append_eos(ids, sp["eos"])
            return K.pack_wrapped(df, ids, order_cols, block_size, sp["bos"], sp["eos"], insert_special)
        if tokenizer == "smiles":
            return K.build_fixed_rows(df, ids_of("text"), block_size, sp["bos"], sp["eos"], sp["pad"],
                                      insert_special).select(*order_cols, "input_ids", "attention_mask")
        ids = ids_of("text")
        if name == "lambada":
            return df.select(*order_cols, T.encode_ragged(ids, block_size, sp["cls"], sp["sep"]).alias("input_ids"))
        return df.select(*order_cols, T.encode_fixed(ids, block_size, sp["cls"], sp["sep"], sp["pad"]).alias("input_ids"),
                         T.encode_fixed_mask(ids, block_size).alias("attention_mask"))

    if cache_root is None:
        return build()
    return S.sink_cache(spark, build, cache_root, name, path=path, mode=mode, wrap=wrap, block_size=block_size,
                        tokenizer=tokenizer, insert_eos=insert_eos, insert_special=insert_special,
                        order_cols=list(order_cols), special_ids=sp, vocab=dict(vocab) if vocab_path else None,
                        holdout=holdout, splits=[list(x) for x in splits] if splits else None,
                        encoder=getattr(encoder, "__qualname__", None) and f"{encoder.__module__}.{encoder.__qualname__}")


def epoch_batches(df: DataFrame, id_col: str, seed: int, epoch: int, replicas: int, rank: int,
                  batch_size: int, counter: int = 0, drop_last: bool = False) -> DataFrame:
    """Rows replica ``rank`` reads in ``epoch``: seeded permutation, padded or
    cut to a multiple of ``replicas``, round-robin shard, resumed after
    ``counter`` consumed rows, with ``batch_id`` and the position in the
    replica's order (``rank_pos``)."""
    order = L.epoch_order(df, seed, epoch, id_col)
    n = order.count()
    padded = L.pad_to_even(order, "epoch_pos", n, replicas, drop_last)
    mine = L.round_robin_shard(padded, "sample_pos", replicas).where(F.col("rank") == rank)
    return L.batch_assign(L.resume_from_counter(mine, "rank_pos", counter), "rank_pos", batch_size)


def valid_batches(df: DataFrame, id_col: str, batch_size: int, valid_seed: int | None = None) -> DataFrame:
    """Validation rows in batches (``epoch_pos``, ``batch_id``): in ``id_col`` order, or, with ``valid_seed``, in the
    permutation of that seed, the same in every epoch. No row is repeated or left out."""
    order = (row_index(df, [id_col], out_col="epoch_pos") if valid_seed is None
             else L.epoch_order(df, valid_seed, 0, id_col))
    return L.batch_assign(order, "epoch_pos", batch_size)
