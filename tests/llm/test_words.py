"""Spelling variants, collocations and rank-file encoding against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tokenmill.llm import phrases, rankbpe, spelling
from tokenmill.llm.common import forget, settled

from .fixtures import SCHEMA, frame, key, texts

P = pytest.importorskip("public_tokenizers")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# spelling variants

def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def variants(rows, min_length=6, min_count=5, ratio=5):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            word = run[:k] + run[k + 1:] if h % 199 == 0 else run
            if len(word) >= min_length:
                count[word] += 1
    words = {w: n for w, n in count.items() if n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f is not None and words[f] >= ratio * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words), key=key)


def found(df, **kw):
    return sorted((tuple(r) for r in spelling.variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=key)


def spelled():
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abÀ") for _ in range(rng.randint(5, 8))) for _ in range(150))) for i in range(25)]
    long = "Z" * 300 + " " + "z" * 301 + " " + "z" * 299 + "y " + "q" * 3000 + " aaaaaa aaaaaaa aaaaaaaa aaaaaaaaa×b"
    rows += [(100 + i, long) for i in range(6)] + [(7, "chained" + " chainee" * 30 + " chaineeb" * 200)] * 5
    return rows + [(None, " hellothere" * 4 + " HelloThere"), (None, None), (1, ""), (2, "1234 ...")]


def test_variants(spark):
    rows = spelled()
    got = found(frame(spark, rows).repartition(4))
    assert got == variants(rows) and any(f and r != f for _, f, r, *_ in got)


def test_variants_of_other_bounds_and_of_nothing(spark):
    rows = spelled()
    assert found(frame(spark, rows), min_length=3, min_count=1, ratio=2) == variants(rows, 3, 1, 2)
    assert found(frame(spark, texts())) == variants(texts())
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_colliding_nodes_change_nothing(spark, monkeypatch):
    """Hashes of three bits: nearly all nodes meet."""
    rows = spelled()
    monkeypatch.setattr(spelling, "_mixed", lambda x: np.zeros_like(x))
    assert found(frame(spark, [r for r in rows if r[0] not in range(100, 106)])) == variants([r for r in rows if r[0] not in range(100, 106)])


def test_large_tries_are_not_broadcast(spark, monkeypatch):
    """The file of 15,000 words is far below Spark's limit; their tries have ten times as many rows."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(15_000)}
    words = settled(spark.createDataFrame(list(enumerate(sorted(words))), "wid long, word string"))
    plans = []
    monkeypatch.setattr(spelling, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settled(df))
    spelling.neighbours(words)
    tries = [p for p in plans if "MapInArrow" in p]
    assert tries and not any("Broadcast" in p for p in tries)


def test_variants_by_shuffled_joins(spark, monkeypatch):
    rows = spelled()
    monkeypatch.setattr(spelling, "BROADCAST_BYTES", 0)
    assert found(frame(spark, rows).repartition(4)) == variants(rows)


def test_tables_are_forgotten(spark):
    t = settled(spark.range(3))
    forget(t)
    with pytest.raises(Exception):
        t.sparkSession.read.schema(t.schema).parquet(t.inputFiles()[0]).collect()


# collocations

def collocations(rows, min_count=100, per_cent=100, top=2000):
    count = defaultdict(Counter)
    for lang, t in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(t)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                count["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in count.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= min_count}
        gone = {p[i:i + k] for p, v in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * v >= per_cent * cand[p[i:i + k]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def sentences():
    rng = random.Random(3)
    words = ["a", "b", "Cé", "d\x01", "e", "ff", "g\x1cg", "no break"]
    gap = [" ", " ", " ", "  ", "\t", ". ", "\n", ", x ", ";", "\x0b"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randint(0, 60)))) for _ in range(200)]
    return rows + [("en", None), ("en", ""), ("de", "zz " * 9), ("de", "zz " * 9), ("es", "\n.,;"), ("", "x y x y x y")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, *"cnkbrRIWN") for i, (g, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("kw", [{"min_count": 3}, {"min_count": 2, "top": 7}, {"min_count": 3, "per_cent": 50}])
def test_collocations(spark, monkeypatch, kw):
    monkeypatch.setattr(phrases, "BURST", 30)
    monkeypatch.setattr(phrases, "MOST_ENTRIES", 200)
    monkeypatch.setattr(phrases, "PREFIXES", 3)
    rows = sentences()
    own = {("absorb_per_cent" if k == "per_cent" else k): v for k, v in kw.items()}
    out = phrases.collocations(docs_of(spark, rows).repartition(3), chunk_bytes=1500, **own)
    assert sorted(tuple(r) for r in out.collect()) == collocations(rows, **kw)


def test_collocations_whole_chunks_and_nothing(spark):
    rows = sentences()
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), min_count=4).collect()) == collocations(rows, 4)
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(docs_of(spark, [("en", "one two")])).collect() == []


def test_scores_beyond_64_bits(spark):
    """Counts of up to 10^11 in the tables that the scores are made from."""
    big = 10**11
    ids = spark.createDataFrame([([1], big), ([2], big - 7), ([1, 2], big - 9)], "ids array<long>, n long")
    words = spark.createDataFrame([("en", "x", big, 1), ("en", "y", big - 7, 2)], "lang string, word string, n long, id long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, total long")
    real, phrases.phrase_counts = phrases.phrase_counts, lambda *_: (ids, words, totals)
    try:
        row = phrases.collocations(None).first()
    finally:
        phrases.phrase_counts = real
    assert row["score"] == 1000 * (big - 9) * 10**13 // (big * (big - 7)) and row["phrase"] == "x y"


def test_trie_leaves_whole_subtrees_in_order():
    trie = phrases.HatTrie(1, 10, 1000)
    trie.add(np.array([5, 5, 5, 9]), np.full(4, 1), np.array([[3], [2], [3], [1]]))
    assert trie.entries == 3 and not trie.full()
    (_, bucket, heads, rests, counts), = trie.leave(0.5)
    assert bucket == 0 and np.frombuffer(heads, "<i8").tolist() == [5, 2]
    assert np.frombuffer(rests, ">u4").tolist() == [2, 3] and np.frombuffer(counts, "<u4").tolist() == [1, 2]
    assert trie.entries == 1 and [np.frombuffer(r[2], "<i8").tolist() for r in trie.leave()] == [[9, 1]] and trie.entries == 0
    trie.add(np.full(50, 7), np.full(50, 4), np.arange(1, 51)[:, None])  # a prefix that is burst into four buckets
    assert [r[:2] for r in trie.leave()] == [(-8, 0), (-8, 1), (-8, 2), (-8, 3)]


# encoding by ranks

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rankbpe.read_ranks(RANKS), special_tokens={})


def awkward():
    rng = random.Random(1)
    out = ["", " ", "  ", "\x1c\x1d a\x1f", " a 　b\u0085 c\xa0\xa0d", "don't I'LL we'll", "a" * 3000, "ab" * 2000, "x" * 257, "!" * 5000, "é" * 2000,
           "漢字" * 500, "<|endoftext|> a", "१२ ٣", "\U0001F600" * 300, " \n\n\t x  y   z", "a\r\n\r\n b"]
    out += ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in (("abcdeé ", 3000), ("aetoin", 20000), ("abcdefghijklmnopqrstuvwxyz", 250))]
    out += ["".join(rng.choice("aabcdeiosntr'’ \n0123\t.,;é\x1c") for _ in range(rng.randrange(0, 300))) for _ in range(500)]
    return out + [t for _, t in texts() if t]


def test_rank_encoding_equals_the_library(library):
    bpe, all_texts = rankbpe.RankBPE(RANKS, P.PATTERN), awkward()
    ids, n = bpe.encode_batch(all_texts)
    ends = np.cumsum(n)
    for t, s, e in zip(all_texts, ends - n, ends):
        assert ids[s:e].tolist() == library.encode_ordinary(t)
        assert bpe.decode(ids[s:e]) == t.encode()


def test_pair_of_lower_rank_goes_first(tmp_path):
    """A merge may make a pair that ranks below the merged token: no training gives that, a file may."""
    import tiktoken
    tokens = [bytes([b]) for b in range(256)] + [b"bab", b"ab", b"abab", b"baba", b"ba"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    bpe = rankbpe.RankBPE(str(path), P.PATTERN)
    own = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=rankbpe.read_ranks(str(path)), special_tokens={})
    rng = random.Random(2)
    for t in ["".join(rng.choice("ab") for _ in range(k)) for k in (5, 40, 250, 257, 700, 3000)]:
        assert bpe.encode_batch([t])[0].tolist() == own.encode_ordinary(t)


def test_encode_documents(spark, library, monkeypatch):
    monkeypatch.setattr(rankbpe, "BATCH_BYTES", 4000)
    rows = texts()
    out = rankbpe.encode_documents(frame(spark, rows).repartition(3), RANKS, P.PATTERN, with_ids=True)
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: key(r[:4])) == sorted(want, key=lambda r: key(r[:4]))
    assert rankbpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).collect() == []
