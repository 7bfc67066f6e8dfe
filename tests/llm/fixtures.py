"""Rows that every operator must survive, and plain Python versions of their results."""

import collections
import hashlib
import os
import random
import re

import public_tokenizers

WS = "[^\\x20\\x09-\\x0d]+"
TOK = os.path.join(os.path.dirname(public_tokenizers.__file__), "")
SCHEMA = ("doc_id long, text string, lang string, chunk string, node string, kind string, body string, row string, "
          "_row string, _id string, _was string, _new string")


def texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, repeated ids."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = prose(120), prose(40), prose(12)
    out = [(None, None), (None, "lone text without id"), (1, None), (2, ""), (3, "  \t\n "), (4, "A b"), (5, "a  B"), (6, "a b")]
    out += [(i, base) for i in (10, 12, 11)]
    out += [(20 + i, base.replace(" ", "  ", 1) + " " + prose(i)) for i in range(6)]
    out += [(30 + i, f"{prose(30)} {passage}\n{prose(20)}") for i in range(5)]
    out += [(40 + i, f"{prose(9)}\n{line}\n{prose(9)}") for i in range(5)]
    out += [(50, prose(9000)), (51, "x" * 20000), (52, "Ünïcödé   \x1c\x85 é <|endoftext|> it's  two   three\n\n\nfour"), (7, "same"), (7, "same"), (8, "same id, one"), (8, "same id, two")]
    return out


def frame(spark, rows):
    """A documents table with columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "en", *"cnkbrRIWN") for d, t in rows], SCHEMA)


def words(text):
    return re.findall(WS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_sets(rows, n):
    out = []
    for _, t in rows:
        w = words(t)
        out.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def jaccard_components(rows, n, per_cent):
    sets = shingle_sets(rows, n)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if a and 100 * same >= per_cent * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def substring_cuts(rows, length=50):
    first = {}
    for d, t in rows:
        b, key = (t or "").encode(), (d is None, d or 0)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(first.get(s, key), key)
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), (d is None, d or 0)
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def kept_bytes(rows, doc, text, length=50):
    """The bytes of one row that no string of a smaller id covers."""
    before = {b[i:i + length] for d, t in rows if d is not None and (doc is None or d < doc)
              for b in [(t or "").encode()] for i in range(len(b) - length + 1)}
    b = (text or "").encode()
    gone = {j for i in range(len(b) - length + 1) if b[i:i + length] in before for j in range(i, i + length)}
    return bytes(x for j, x in enumerate(b) if j not in gone)


def key(row):
    return tuple((x is None, x) for x in row)
