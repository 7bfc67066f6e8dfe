"""Operators on documents against plain Python, over the awkward rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import bpe, exact, lm, packing, setjoin, suffix, wavelet

from .fixtures import TOK, frame, jaccard_components, key, substring_cuts, texts, words

ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(5).cache()


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def test_suffix_dedup(docs):
    assert got(suffix.digests(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(substring_cuts(ROWS), key=key)


def test_suffix_dedup_over_many_chunks(spark, monkeypatch):
    import tokenmill.llm.common as common
    monkeypatch.setattr(common.chunked, "__defaults__", (2000,))
    monkeypatch.setattr(suffix, "PART_KEYS", 500)
    rows = [r for r in ROWS if r[0] != 51]
    assert got(suffix.digests(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(substring_cuts(rows), key=key)


def test_cut_documents_keeps_columns_and_clean_rows(docs):
    out = suffix.cut_documents(docs.withColumn("n_chars", F.length("text")))
    assert out.columns == docs.columns + ["n_chars"]
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) and by[10]["text"] == dict(ROWS)[10] and by[1]["text"] is None
    assert by[12]["text"] == "" and by[12]["n_chars"] == 0


@pytest.mark.parametrize("n, per_cent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(docs, n, per_cent):
    assert got(setjoin.jaccard_components(docs, n, per_cent), "doc_id", "n_shingles", "component_id") == \
        sorted(jaccard_components(ROWS, n, per_cent), key=key)


def test_exact_dedup(docs):
    import re
    body = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in ROWS]
    want = []
    for (d, _), b in zip(ROWS, body):
        group = [x for (x, _), y in zip(ROWS, body) if y == b]
        least = min((x for x in group if x is not None), default=None)
        want.append((d, least, len(group), hashlib.sha256(b.encode()).hexdigest()))
    out = exact.dedup(docs)
    assert got(out, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=key)
    kept = [r for r in out.collect() if r["kept"]]
    assert len(kept) == len(set(body)) == len({r["text_sha256"] for r in kept})


def test_exact_dedup_tells_texts_of_one_digest_apart(spark):
    """With a digest of one byte nearly all texts clash; the next digest tells them apart, repeated ids included."""
    rows = [(i % 40, f"text  {i % 30}") for i in range(120)] + [(None, "text 1"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def short(body):
        return F.unhex(F.substring(F.sha2(body, 256), 1, 2))

    def answer(df):
        return sorted((tuple(r)[:5] for r in df.drop("row", "known").collect()), key=str)

    got = exact._flagged(docs, None, None, "doc_id", "text", (short, exact._sha_and_more))
    assert answer(got) == answer(exact.dedup(docs))
    assert got.where("kept").count() == 31 == got.select("text_sha256").distinct().count()
    with pytest.raises(RuntimeError):
        exact._flagged(docs, None, None, "doc_id", "text", (short,))


def test_binary_fuse_has_no_false_negative():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact.BinaryFuse.build(keys)
        assert f.has(keys).all()
        if n == 50_000:
            assert f.has(rng.integers(0, 2**63, n).astype(np.uint64)).mean() < 0.01
            assert len(f.slots) < 1.25 * n


def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOK + "byte_bpe_50k.json")
    want = []
    for d, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got(bpe.encode_documents(docs, TOK + "byte_bpe_50k.json"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=key)


def test_bpe_on_random_strings():
    import random
    from tokenizers import Tokenizer
    tok, own = Tokenizer.from_file(TOK + "byte_bpe_50k.json"), bpe.ByteBPE(TOK + "byte_bpe_50k.json")
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(" \t\n\x1c\x85  aAé'sréllt1٣½.,<|\U0001f600é") for _ in range(rng.randint(0, 40)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert [i for u in bpe.units(t) for i in own.encode(u)] == ids == own.encode(t)
        assert own.decode(ids) == t


def _library_ids(end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOK + "word_bpe_49k.json")
    return [(d, np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for d, t in ROWS]


def test_wavelet_files(spark, docs):
    ids = _library_ids(1)
    out = got(wavelet.round_trip(docs, TOK + "word_bpe_49k.json", 16), "doc_id", "n_tokens", "ids_crc32")
    assert out == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids), key=key)
    starts = [(r["start"], r["n_tokens"], r["doc_id"]) for r in wavelet.round_trip(docs, TOK + "word_bpe_49k.json", 16).collect()]
    at, last = 0, (False, 0)
    for s, n, d in sorted(starts):
        assert s == at and (d is not None, d or 0) >= last
        at, last = s + n, (d is not None, d or 0)


def test_shards_that_hold_the_same_ids(spark, tmp_path):
    """Null and repeated ids fill several small shards: every row comes back once, starts follow the ids."""
    from tokenmill.llm.tokens import encode_texts
    tok = TOK + "word_bpe_49k.json"
    for number, ids in enumerate([[None] * 6, [5, 5, 5, 5, 6], [5] * 6 + [6], [None, 3, None, 3, 1, 2, 2, 1]]):
        rows = [(d, f"one two word {i}") for i, d in enumerate(ids)]
        path = str(tmp_path / str(number))
        wavelet.write(frame(spark, rows).repartition(3), path, tok, 16, shard_tokens=4)
        out = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.documents_of(spark, path).collect()]
        want = []
        for d, t in rows:
            flat, n = encode_texts(tok, [t.encode()])
            want.append((d, int(n[0]) + 1, zlib.crc32(np.r_[flat, 1].astype("<u4").tobytes())))
        assert sorted(((d, n, c) for d, _, n, c in out), key=key) == sorted(want, key=key)
        out.sort(key=lambda r: r[1])
        assert [r[1] for r in out] == [sum(r[2] for r in out[:i]) for i in range(len(out))]
        assert [r[0] for r in out] == sorted(ids, key=lambda d: (d is not None, d))


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(2)
    for n, width in ((0, 5), (1, 1), (511, 7), (512, 16), (3000, 17)):
        x = rng.integers(0, min(1 << width, 40), n)
        m = wavelet.WaveletMatrix.build(x, width)
        assert (m.all() == x).all()
        for i in range(0, n, 97):
            assert m.access(i) == x[i]
        for c in (0, 1, 7, 39):
            where = np.flatnonzero(x == c)
            if c < 1 << width:
                assert m.count(c) == len(where) and m.rank(c, n // 2) == (where < n // 2).sum()
                assert [m.select(c, k) for k in range(min(5, len(where)))] == where[:5].tolist()
                assert m.select(c, len(where)) == -1


def test_parts_have_the_ids_of_whole_pieces(monkeypatch):
    """Each different part goes to the model once, and the ids are those of the library for the whole text, also
    while the table of parts starts anew."""
    import random
    from tokenizers import Tokenizer
    from tokenmill.llm import tokens
    tok, rng = Tokenizer.from_file(TOK + "word_bpe_49k.json"), random.Random(8)
    some = ["word", "Word,", "WORD!!", "'S", "don't", "we'LL've", "'", "''s", "x86_64", "42", "<|endoftext|>", "a<|endoftext|>b", "<|EndOfText|>", "ÉÀÖ", "straße.",
            "e\u0301", "\u00c5", "\u212b", "\u0130", "ΣΑΣ", "\u00d7\u00f7", "\u00aa\u00ba", "½", "\x1c", "\x7f", "\u0085", "\u00a0", "\u3000", "中文", "\U0001f600!", "ﬁ", "\u0345"]
    texts = [" ".join("".join(rng.choice(some + list("aZ9.,'é")) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    for limit in (tokens.PART_BYTES, 1000):
        monkeypatch.setattr(tokens, "PART_BYTES", limit)
        flat, n = tokens._library_table(TOK + "word_bpe_49k.json").rows([t.encode().split() for t in texts])
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want
    asked = []

    class Model:
        def tokenize(self, part):
            asked.append(part)
            return tok.model.tokenize(part)

    parts = tokens._Parts(Model())
    assert [list(parts[x]) for x in ("word", "été", "word", "!")] == [tok.encode(x).ids for x in ("word", "été", "word", "!")]
    assert len(asked) == 3


def test_packing(docs):
    ids = _library_ids(2)
    out = packing.pack(docs, TOK + "word_bpe_49k.json", 2, 256).collect()
    assert sum(r["length"] for r in out) == sum(len(x) for _, x in ids)
    known = {}
    for d, x in ids:
        known.setdefault((d, len(x)), []).append(x)
    by = {}
    for r in out:
        assert any(zlib.crc32(x[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in known[r["doc_id"], r["doc_tokens"]])
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end = o + n
        assert end <= 256
    assert sorted(by) == list(range(len(by)))


def test_cutting_stock_plan_meets_demand():
    rng = np.random.default_rng(4)
    demand = rng.integers(0, 300, 64)
    plan = packing.plan(demand.copy(), 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    bound = (demand * np.arange(1, 65)).sum() / 64
    assert sum(t for _, t in plan) <= bound * 1.02 + 2


def test_lm_score(docs):
    import math
    held = lambda d: d is not None and d % 3 == 0
    tokens = [words(t) + [None] for _, t in ROWS]
    train = [t for (d, _), t in zip(ROWS, tokens) if not held(d)]
    one, two, ctx = {}, {}, {}
    for t in train:
        for u, w in zip(["<begin>", *t[:-1]], t):
            one[w] = one.get(w, 0) + 1
            two[u, w] = two.get((u, w), 0) + 1
            ctx[u] = ctx.get(u, 0) + 1
    n, v = sum(one.values()), len(one)
    want = []
    for (d, _), t in zip(ROWS, tokens):
        base = s = 0.0
        for u, w in zip(["<begin>", *t[:-1]], t):
            p = (one.get(w, 0) + 1) / (n + v + 1)
            base += math.log10(p)
            s += math.log10((two.get((u, w), 0) + lm.MASS * p) / (ctx.get(u, 0) + lm.MASS))
        want.append((d, held(d), len(t), sum(w in one for w in t), n, round(base, 6), round(s, 6)))
    out = lm.score(docs, F.col("doc_id") % 3 == 0).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
    rows = got(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_empty_tables(spark):
    none = frame(spark, [])
    for out in (suffix.digests(none), setjoin.jaccard_components(none), exact.dedup(none), lm.score(none, F.lit(False)),
                bpe.encode_documents(none, TOK + "byte_bpe_50k.json"), packing.pack(none, TOK + "word_bpe_49k.json"),
                wavelet.round_trip(none, TOK + "word_bpe_49k.json", 16)):
        assert out.count() == 0
