"""Vocabularies and token patterns.

FIXED VALUES — these must equal the reference's for equal token ids, so
they are written out plainly, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: character vocabulary (8 specials, then 'a'..'z', then space).
CHAR_SPECIALS = ["[CLS]", "[SEP]", "[BOS]", "[EOS]", "[MASK]", "[PAD]", "[RESERVED]", "[UNK]"]
CHAR_CHARACTERS = "abcdefghijklmnopqrstuvwxyz "
# ---------------------------------------------------------------------------

CHAR_VOCAB = {tok: i for i, tok in enumerate(CHAR_SPECIALS)}
CHAR_VOCAB.update({ch: i + len(CHAR_SPECIALS) for i, ch in enumerate(CHAR_CHARACTERS)})
CHAR_CLS, CHAR_SEP, CHAR_BOS, CHAR_EOS = 0, 1, 2, 3
CHAR_MASK, CHAR_PAD, CHAR_UNK = 4, 5, 7
CHAR_VOCAB_SIZE = len(CHAR_VOCAB)  # 35

# ---------------------------------------------------------------------------
# FIXED VALUES: SMILES token pattern (one capture group; characters that
# match no alternative are dropped), and the cap (512 - 2) for callers that ask for one.
SMILES_PATTERN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>>?|\*|\$|\%[0-9]{2}|[0-9])"
)
SMILES_MAX_TOKENS = 510
# ---------------------------------------------------------------------------

# ---------------------------------------------------------------------------
# FIXED VALUES: head of the molecule vocabulary, line number = id. A full
# vocabulary file is read with ``sources.corpus.scan_vocab``; this head is
# what the small query fixtures use; whole corpora pass ``vocab_path``. '[UNK]' appears on three lines and the
# last one wins (id 13).
SMILES_VOCAB_HEAD = [
    "[PAD]", "[BOS]", "[EOS]", "[ANS]", "[RB]", "[HD]", "[HA]", "[AR]", "[logp]", "[tpsa]",
    "[NUM]", "[UNK]", "[UNK]", "[UNK]", "[*+]", "[*-]", "[CLS]", "[SEP]", "[MASK]", "c",
    "C", "(", ")", "O", "1", "2", "=", "N", ".", "n",
    "3", "F", "Cl", ">>", "~", "-", "4", "[C@H]", "S", "[C@@H]",
    "[O-]", "Br", "#", "/", "[nH]", "[N+]", "s", "5", "o", "P",
    "[Na+]", "[Si]", "I", "[Na]", "[Pd]", "[K+]", "[K]", "[P]", "B", "[C@]",
    "[C@@]", "[Cl-]", "6", "[OH-]", "\\", "[N-]", "[Li]", "[H]", "[2H]", "[NH4+]",
]
# ---------------------------------------------------------------------------


def vocab_from_lines(lines: list[str]) -> dict[str, int]:
    """token -> id with line number as id; a repeated token keeps its last line."""
    out: dict[str, int] = {}
    for i, tok in enumerate(lines):
        out[tok] = i
    return out


SMILES_VOCAB = vocab_from_lines(SMILES_VOCAB_HEAD)
SMILES_PAD, SMILES_BOS, SMILES_EOS = 0, 1, 2
SMILES_UNK = SMILES_VOCAB["[UNK]"]  # 13
SMILES_CLS, SMILES_SEP, SMILES_MASK = 16, 17, 18


class Vocabulary(dict):
    """token -> id of a whole vocabulary, with the ids of its special tokens as the file has them."""

    def special(self, token: str) -> int:
        if token not in self:
            raise ValueError(f"the vocabulary has no {token}")
        return self[token]

    @property
    def unk(self) -> int:
        return self.special("[UNK]")

    def specials(self) -> dict[str, int]:
        return {k: self.special(f"[{k.upper()}]") for k in ("bos", "eos", "cls", "sep", "pad")}
