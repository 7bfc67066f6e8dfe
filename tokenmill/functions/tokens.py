"""Tokenisation as Column expressions.

Every function here returns a ``Column`` built from Spark built-ins
(higher-order ``transform``, ``regexp_extract_all``, map lookups), so it
runs inside whole-stage code generation next to the scan; nothing leaves
the JVM. Large vocabularies that should not live in the plan as a map
literal go through ``operators.joins.join_vocab`` instead (a size-checked
broadcast join).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_int_array() -> Column:
    return F.array().cast("array<int>")


# --------------------------------------------------------------------- T1 --
# Character ids: 'a'..'z' -> 8..33 (code point - 89), ' ' -> 34, EOS_CHAR -> 3,
# anything else -> 7. ``char_symbols`` maps every character into '`'..'{' so
# that the symbol's code point - 89 is its id (used where only token
# identity matters, e.g. counting).
EOS_CHAR = "\ue000"  # stands for EOS inside character streams (see packing.pack_chars)
_CHAR_OFFSET = 89


def _normalised_chars(lowered: Column) -> Column:
    s = F.regexp_replace(lowered, "[^a-z " + EOS_CHAR + "]", "`")
    return F.translate(s, " " + EOS_CHAR, "{" + chr(_CHAR_OFFSET + V.CHAR_EOS))


def char_ids_of_lowered(lowered: Column) -> Column:
    """T1 on text that is already lower-cased (may hold EOS_CHAR): one code
    point per character, then an integer CASE (two light passes measured
    faster than a regex normalisation plus one pass)."""
    codes = F.transform(F.split(lowered, ""), lambda ch: F.ascii(ch))
    ids = F.transform(codes, lambda x: F.when(x == 32, F.lit(V.CHAR_VOCAB[" "]))
                      .when((x >= 97) & (x <= 122), x - _CHAR_OFFSET)
                      .when(x == ord(EOS_CHAR), F.lit(V.CHAR_EOS))
                      .otherwise(F.lit(V.CHAR_UNK)))
    return F.when(F.coalesce(F.length(lowered), F.lit(0)) == 0, empty_int_array()).otherwise(ids)


def char_ids(text) -> Column:
    """Lower-case, split into code points, 'a'..'z' -> 8..33, ' ' -> 34, else UNK 7.

    An empty or NULL text gives an empty array (``split('', '')`` would give
    one empty string).
    """
    t = F.replace(F.lower(_c(text)), F.lit(EOS_CHAR), F.lit("\ue001"))  # keeps the count; maps to UNK
    return char_ids_of_lowered(t)


def char_count(text) -> Column:
    """Number of character tokens of ``text`` (code points after lower-casing),
    without building the id array."""
    return F.coalesce(F.char_length(F.lower(_c(text))), F.lit(0)).cast("long")


def char_tokens(text) -> Column:
    """Characters of the lower-cased text (the token strings of T1)."""
    t = F.lower(_c(text))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(t, ""))


# --------------------------------------------------------------------- T2 --
def smiles_tokens(text, max_tokens: int | None = None) -> Column:
    """Regex tokens of a molecule string; unmatched characters are dropped. Every
    token is kept unless the caller passes ``max_tokens``."""
    toks = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(V.SMILES_PATTERN), 1)
    if max_tokens is None:
        return toks
    return F.slice(toks, 1, max_tokens)


# ----------------------------------------------------------------- T3, T4 --
def _map_literal(d: Mapping) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def tokens_to_ids(tokens, vocab: Mapping[str, int], unk_id: int) -> Column:
    """token -> id through a map literal; tokens not in the vocabulary -> ``unk_id``."""
    m = _map_literal(vocab)
    return F.transform(_c(tokens), lambda x: F.coalesce(F.try_element_at(m, x), F.lit(unk_id)).cast("int"))


def ids_to_tokens(ids, vocab: Mapping[str, int], unk_token: str = "[UNK]") -> Column:
    """id -> token (inverse map; a token listed twice keeps its last id), else ``unk_token``."""
    inv = {}
    for tok, i in vocab.items():
        inv[i] = tok
    m = _map_literal(inv)
    return F.transform(_c(ids), lambda x: F.coalesce(F.try_element_at(m, x), F.lit(unk_token)))


def smiles_ids(text, vocab: Mapping[str, int] = V.SMILES_VOCAB, unk_id: int = V.SMILES_UNK,
               max_tokens: int | None = None) -> Column:
    return tokens_to_ids(smiles_tokens(text, max_tokens), vocab, unk_id)


# --------------------------------------------------------------------- T5 --
def token_count(ids, plus_eos: bool = False) -> Column:
    n = F.size(_c(ids)).cast("long")
    return n + 1 if plus_eos else n


# --------------------------------------------------------------------- T6 --
def decode(ids, vocab: Mapping[str, int], style: str = "word", unk_token: str = "[UNK]") -> Column:
    """ids -> text. 'word': join by space, glue '##' pieces, strip; 'char': plain concat."""
    toks = ids_to_tokens(ids, vocab, unk_token)
    if style == "char":
        return F.array_join(toks, "")
    return F.trim(F.replace(F.array_join(toks, " "), F.lit(" ##"), F.lit("")))


# ------------------------------------------------------------- T7, T8, T10 --
def add_special_single(ids, cls_id: int, sep_id: int) -> Column:
    """[CLS] X [SEP]"""
    return F.concat(F.array(F.lit(cls_id)), _c(ids), F.array(F.lit(sep_id)))


def add_special_pair(ids_a, ids_b, cls_id: int, sep_id: int) -> Column:
    """[CLS] A [SEP] B [SEP]"""
    return F.concat(F.array(F.lit(cls_id)), _c(ids_a), F.array(F.lit(sep_id)), _c(ids_b), F.array(F.lit(sep_id)))


def append_eos(ids, eos_id: int) -> Column:
    return F.concat(_c(ids), F.array(F.lit(eos_id)))


# --------------------------------------------------------------------- T9 --
def pad_tokens(ids, length: int, pad_id: int, side: str = "right") -> Column:
    """Pad to ``length``; longer input is left unchanged (no truncation)."""
    a = _c(ids)
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(a, pad) if side == "right" else F.concat(pad, a)


def attention_mask(ids, pad_id: int | None = None, n_real=None) -> Column:
    """1 for real tokens, 0 for padding; either by a count of real tokens
    (``n_real``) or by comparing with ``pad_id``."""
    a = _c(ids)
    if n_real is not None:
        nr = _c(n_real)
        return F.transform(a, lambda x, i: F.when(i < nr, 1).otherwise(0).cast("tinyint"))
    return F.transform(a, lambda x: F.when(x == F.lit(pad_id), 0).otherwise(1).cast("tinyint"))


# ---------------------------------------------------------------- T11/T12 --
def truncate(ids, max_len: int) -> Column:
    return F.slice(_c(ids), 1, max_len)


def encode_fixed(ids, block_size: int, cls_id: int, sep_id: int, pad_id: int) -> Column:
    """[CLS] + first block-2 ids + [SEP], right-padded to block_size."""
    body = add_special_single(truncate(ids, block_size - 2), cls_id, sep_id)
    return pad_tokens(body, block_size, pad_id)


def encode_fixed_mask(ids, block_size: int) -> Column:
    n_real = F.least(F.size(_c(ids)), F.lit(block_size - 2)) + 2
    return F.transform(F.array_repeat(F.lit(0), block_size),
                       lambda x, i: F.when(i < n_real, 1).otherwise(0).cast("tinyint"))


def encode_ragged(ids, max_len: int, cls_id: int, sep_id: int) -> Column:
    """specials + truncation, no padding."""
    return add_special_single(truncate(ids, max_len - 2), cls_id, sep_id)


def ones_mask(length: int) -> Column:
    return F.array_repeat(F.lit(1).cast("tinyint"), length)


def ids_text(ids, sep: str = " ") -> Column:
    """Render an id array as text (report columns); an array cast, no lambda."""
    return F.array_join(_c(ids).cast("array<string>"), sep)


def char_symbols(text) -> Column:
    """One symbol per character token: the normalised character whose code
    point minus 89 is the token id (see ``symbol_id``). Grouping or counting
    symbols is grouping or counting tokens, without building int arrays."""
    t = F.replace(F.lower(_c(text)), F.lit(EOS_CHAR), F.lit(""))
    n = _normalised_chars(t)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(n, ""))


def symbol_id(sym) -> Column:
    return (F.ascii(_c(sym)) - _CHAR_OFFSET).cast("int")
