"""DuckDB spellings of the normalisation rules, for the oracles.

The rule tables are the ones in ``functions.text``; only the translation
differs. RE2 (DuckDB) has ASCII ``\\w``/``\\s`` and an end-only ``$``: word
characters become ``[\\p{L}\\p{N}_]`` and a final ``$`` becomes ``(\\n?)$``
(Python's end-of-text-or-before-a-final-newline), re-emitted in the
replacement.
"""

from __future__ import annotations

import re

from ..functions import text as X


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2_rule(pattern: str, repl: str) -> tuple[str, str]:
    p = pattern.replace("\\w", r"[\p{L}\p{N}_]")
    r = repl
    if p.endswith("$"):
        n_groups = len(re.findall(r"(?<!\\)\((?!\?)", p))
        p = p[:-1] + r"(\n?)$"
        r = r + "\\" + str(n_groups + 1)
    return p, r


def apply_rules(e: str, rules) -> str:
    for kind, a, b in rules:
        if kind == "lit":
            e = f"replace({e}, {_q(a)}, {_q(b)})"
        else:
            p, r = re2_rule(a, b)
            e = f"regexp_replace({e}, {_q(p)}, {_q(r)}, 'g')"
    return e


def wikitext(e: str) -> str:
    return apply_rules(e, X.WIKITEXT_RULES)


def ptb(e: str) -> str:
    return apply_rules(e, X.PTB_RULES)


def lm1b(e: str) -> str:
    return apply_rules(e, X.LM1B_RULES)


def lambada(e: str) -> str:
    e = apply_rules(e, X.LAMBADA_QUOTES)
    e = f"regexp_replace(regexp_replace({e}, '^\\s+', '', 'g'), '\\s+$', '', 'g')"
    return f"concat(chr(10), {e})"


def scientific(e: str) -> str:
    return lm1b(wikitext(e))


def clean_generated(e: str) -> str:
    e = f"split_part(coalesce({e}, ''), '[EOS]', 1)"
    for tok in X.GENERATION_MARKERS:
        e = f"replace({e}, {_q(tok)}, '')"
    return f"regexp_replace({e}, '\\s+', '', 'g')"
