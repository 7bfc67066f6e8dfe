"""Text normalisation as Column expressions.

The detokenisers are tables of rules applied in order; each rule becomes one
built-in ``replace`` or ``regexp_replace``, so the whole chain runs inside
code generation. The rules are written in Python regex syntax (Unicode
``\\w``/``\\s``, ``$`` = end of text or before one final newline, ``\\1`` in
replacements); ``java_rule`` translates them for Spark (``(?U)``, ``(?d)``,
``$1``) and ``plans.sqltext`` for DuckDB's RE2.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# FIXED VALUES: detokenisation rules, in the order they apply.
# ("lit", a, b): replace every a by b.   ("re", pattern, replacement): regex.
WIKITEXT_RULES = [
    ("lit", "s '", "s'"),
    ("re", r"/' [0-9]/", r"/'[0-9]/"),
    ("lit", " @-@ ", "-"),
    ("lit", " @,@ ", ","),
    ("lit", " @.@ ", "."),
    ("lit", " : ", ": "),
    ("lit", " ; ", "; "),
    ("lit", " . ", ". "),
    ("lit", " ! ", "! "),
    ("lit", " ? ", "? "),
    ("lit", " , ", ", "),
    ("re", r"\(\s*([^\)]*?)\s*\)", r"(\1)"),
    ("re", r"\[\s*([^\]]*?)\s*\]", r"[\1]"),
    ("re", r"{\s*([^}]*?)\s*}", r"{\1}"),
    ("re", r"\"\s*([^\"]*?)\s*\"", r'"\1"'),
    ("re", r"'\s*([^']*?)\s*'", r"'\1'"),
    ("lit", "= = = =", "===="),
    ("lit", "= = =", "==="),
    ("lit", "= =", "=="),
    ("lit", " " + chr(176) + " ", chr(176)),
    ("lit", " \n", "\n"),
    ("lit", "\n ", "\n"),
    ("lit", " N ", " 1 "),
    ("lit", " 's", "'s"),
]

PTB_RULES = [
    ("lit", " 's", "'s"),
    ("lit", "s ' ", "s' "),
    ("lit", " n't", "n't"),
    ("lit", " \n ", "\n"),
    ("lit", "\\/", "/"),
    *[("lit", " N ", " 1 ")] * 10,  # ten passes: overlapping " N N N "
    ("lit", "$ 1", "$1"),
    ("lit", "# 1", "#1"),
    ("lit", "<unk>", "?"),
]

LM1B_RULES = [
    ("lit", "http : / / ", "http://"),
    ("lit", "https : / / ", "https://"),
    ("re", r" \'(\w+)", r"'\1"),
    ("re", r" (\w+) \. ", r" \1. "),
    ("re", r" (\w+) \.$", r" \1."),
    ("lit", " ? ", "? "),
    ("re", r" \?$", "?"),
    ("lit", " ! ", "! "),
    ("re", r" \!$", "!"),
    ("lit", " , ", ", "),
    ("lit", " : ", ": "),
    ("lit", " ; ", "; "),
    ("lit", " / ", "/"),
    ("re", r"\" ([^\"]+) \"", r'"\1"'),
    ("re", r"\' ([^\']+) \'", r"'\1'"),
    ("re", r"\( ([^\(\)]+) \)", r"(\1)"),
    ("re", r"\[ ([^\[\]]+) \]", r"[\1]"),
    ("lit", "$ ", "$"),
    ("lit", "£ ", "£"),
]

LAMBADA_QUOTES = [("lit", "“", '"'), ("lit", "”", '"')]
# ---------------------------------------------------------------------------


def java_rule(pattern: str, repl: str) -> tuple[str, str]:
    """Python-syntax rule -> Java regex with the same meaning."""
    flags = ""
    if "\\w" in pattern or "\\s" in pattern:
        flags += "U"  # Unicode classes, as Python's str patterns
    if pattern.endswith("$"):
        flags += "d"  # only \n ends a line, as Python's $
    if pattern.startswith("{"):
        pattern = "\\" + pattern  # Java needs a literal brace escaped
    java_repl = re.sub(r"\\(\d)", r"$\1", repl.replace("$", "\\$"))
    return (f"(?{flags})" if flags else "") + pattern, java_repl


def apply_rules(text, rules) -> Column:
    s = _c(text)
    for kind, a, b in rules:
        if kind == "lit":
            s = F.replace(s, F.lit(a), F.lit(b))
        else:
            p, r = java_rule(a, b)
            s = F.regexp_replace(s, F.lit(p), F.lit(r))
    return s


def strip(s: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (``trim`` only takes spaces)."""
    return F.regexp_replace(F.regexp_replace(s, F.lit(r"(?U)^\s+"), F.lit("")), F.lit(r"(?U)\s+$"), F.lit(""))


# --------------------------------------------------------------- P1 - P5 --
def detok_wikitext(text) -> Column:
    return apply_rules(text, WIKITEXT_RULES)


def detok_ptb(text) -> Column:
    return apply_rules(text, PTB_RULES)


def detok_lm1b(text) -> Column:
    return apply_rules(text, LM1B_RULES)


def detok_lambada(text) -> Column:
    """Straight quotes, stripped, a newline in front."""
    return F.concat(F.lit("\n"), strip(apply_rules(text, LAMBADA_QUOTES)))


def detok_scientific(text) -> Column:
    return detok_lm1b(detok_wikitext(text))


# --------------------------------------------------------------------- P6 --
DETOKENIZERS = {
    "wikitext": detok_wikitext,     # prefix match: wikitext103, wikitext2
    "ptb": detok_ptb,
    "lm1b": detok_lm1b,
    "lambada": detok_lambada,
    "scientific_papers": detok_scientific,  # prefix match
}


def detokenizer_for(corpus: str):
    """Detokenizer chosen by corpus name (prefix match for wikitext* and
    scientific_papers*); None = identity."""
    if corpus.startswith("wikitext"):
        return detok_wikitext
    if corpus.startswith("scientific_papers"):
        return detok_scientific
    return DETOKENIZERS.get(corpus)


def detok_dispatch(text, corpus_col) -> Column:
    """Per-row choice of detokenizer by a corpus-name column, so several
    corpora are normalised in one job (CASE evaluates only the chosen branch)."""
    t, name = _c(text), _c(corpus_col)
    return (F.when(name.startswith("wikitext"), detok_wikitext(t))
            .when(name.startswith("scientific_papers"), detok_scientific(t))
            .when(name == "ptb", detok_ptb(t))
            .when(name == "lm1b", detok_lm1b(t))
            .when(name == "lambada", detok_lambada(t))
            .otherwise(t))


# -------------------------------------------------------------------- P11 --
# FIXED VALUES: markers removed from generated text.
GENERATION_MARKERS = ("[BOS]", "[EOS]", "[PAD]")


def clean_generated_text(text) -> Column:
    """NULL -> ''; keep only what precedes the first [EOS]; drop the markers;
    remove all whitespace."""
    s = F.substring_index(F.coalesce(_c(text), F.lit("")), "[EOS]", 1)
    for tok in GENERATION_MARKERS:
        s = F.replace(s, F.lit(tok), F.lit(""))
    return F.regexp_replace(s, F.lit(r"(?U)\s+"), F.lit(""))


# -------------------------------------------------------------------- P13 --
def preview_list(arr, max_len: int = 32) -> Column:
    """A list shown as its head ``[a, b, ...] ... (len=n)`` when longer than
    ``max_len``, else the whole list, in Python list notation."""
    a = _c(arr)

    def show(x):
        return F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]"))

    return F.when(F.size(a) <= max_len, show(a)).otherwise(
        F.concat(show(F.slice(a, 1, max_len)), F.lit(" ... (len="), F.size(a).cast("string"), F.lit(")")))
