"""Rows, links and aliases that earlier versions left out."""

import collections
import random
import re
from urllib.parse import urljoin

import pytest

from pyspark.sql import functions as F

import corpus_pipeline as P
from tokenmill.llm import setjoin, topk, urls
from tokenmill.llm.common import bodies, chunked

from .fixtures import frame, jaccard_components, key, shingle_sets, texts


def _kept(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_drop_copies_keeps_the_rows_that_are_no_copies(spark):
    rows = texts() + [(None, "another without id"), (None, "lone  text without id"), (60, "zz copy"), (61, "a unique text"), (61, "zz copy"),
                      (62, "a copy"), (63, "z unique"), (63, "a copy")]
    want, seen = collections.Counter(), set()
    for _, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        body = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        if body not in seen:
            seen.add(body)
            want[d, t] += 1
    got = _kept(P.drop_copies(spark, frame(spark, rows).coalesce(1), ""))
    assert got == want


def test_drop_near_copies_keeps_one_row_of_each_group(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, near + " x"), (None, near + " y"), (3, near), (3, "quite another text of the same id here"), (4, near + " z"),
            (None, "a lone text that has no id at all"), (None, None), (None, ""), (5, "short"), (5, "brief")]
    got = _kept(P.drop_near_copies(spark, frame(spark, rows), ""))
    assert got == collections.Counter(r for r in rows if r[1] is None or not r[1].startswith(near) or r == (3, near))


def _near_rows():
    """A group of near copies with different texts (and some equal ones), and looser ones."""
    rng, base = random.Random(9), [f"w{i}" for i in range(150)]
    rows = texts()
    for i in range(45):
        w = list(base)
        for _ in range(rng.randint(0, 3) if i % 3 else rng.randint(4, 12)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((100 + i if i % 9 else None, " ".join(w)))
    return rows + [(200, rows[-1][1]), (200, rows[-1][1]), (None, rows[-2][1])]


@pytest.mark.parametrize("n, per_cent", [(4, 85), (5, 80), (1, 50)])
def test_join_returns_every_link(spark, n, per_cent):
    rows = _near_rows()
    sets = shingle_sets(rows, n)
    like = lambda a, b: bool(a) and 100 * len(a & b) >= per_cent * len(a | b)
    want = [(d, sum(like(a, b) for j, b in enumerate(sets) if j != i)) for i, ((d, _), a) in enumerate(zip(rows, sets))]
    docs = frame(spark, rows)
    join = setjoin.jaccard_join(docs, n, per_cent)
    assert sorted((tuple(r) for r in join.select("doc_id", "n_links").collect()), key=key) == sorted(want, key=key)
    same = sorted(map(tuple, setjoin.jaccard_components(docs, n, per_cent).drop("node").collect()), key=key)
    assert sorted(map(tuple, join.drop("node", "n_links").collect()), key=key) == same
    # links() itself: each pair of different sets once
    table = setjoin.sets_of(docs, n, per_cent, "doc_id", "text").filter("prefix is not null").dropDuplicates(["sig"])
    found = [tuple(r) for r in setjoin.links(table, per_cent).select("a", "b").collect()]
    different = list(dict.fromkeys(sets))
    pairs = sum(like(a, b) for i, a in enumerate(different) for b in different[:i])
    assert len(found) == len(set(found)) == pairs


def test_references_are_resolved(spark):
    bases = ["http://a.org", "https://a.org/", "http://a.org/x", "http://a.org/b/c/d;p?q=1/2#f", "http://a.org/b/c/?q"]
    refs = ["g", "./g", "g/", "/g", "//h.net/g", "?y", "g?y=/../z", "g#s/../x", ";x", ".", "./", "..", "../", "../g", "../..", "../../../g", "/./g",
            "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "https://b.net/p", "x:y/z", "#f", "index.html?u=http://z.org/", "/"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "url string, to string")
    out = df.select("url", "to", urls.address(urls.resolved(F.col("to"), F.col("url"))).alias("got")).collect()
    for url, to, got in out:
        if to == "x:y/z":
            assert got is None
            continue
        want = urljoin(url, to).split("#")[0].split("://", 1)[1]
        assert got == want, (url, to)


def test_relative_and_later_targets_are_aliases(spark):
    move = "<meta http-equiv=refresh content='0; url={}'>"
    wait, canon = "<META content='30' http-equiv='refresh'>", '<link rel="canonical" href="{}">'
    rows = [(1, "http://example.com/x", move.format("de/home")), (2, "http://a.org/p", canon.format("http://example.com/x")),
            (3, "http://b.org/p", wait + move.format("http://example.com/de/y")),
            (4, "http://c.org/p", '<link rel="canonical">' + canon.format("http://c.org/q") + canon.format("http://example.com/de/z")),
            (5, "http://example.com/en/f/x", move.format("../../de/a")), (6, "http://example.com/de/../ok", wait),
            (7, "http://d.org/p", move.format("?page=2")), (8, "http://d.org/p?page=2", canon.format("//example.com/de/q")),
            (9, "http://e.org/p", wait + canon.format("mailto:x"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, [("block", "example.com", "/de/")]).collect()}
    assert got == {i: "block" if i != 9 else "allow" for i, _, _ in rows}


def test_topk_with_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 0, 3, 6]) for _ in range(6)]) for i in range(300)]
    rows[100] = (100, [70000.0, *rows[100][1][1:]])
    rows += [(i, [rng.choice([-1, 1]) * (65536.0 + i), 0.5, 2.0 ** 20, -1e5, 0.0, 1.0]) for i in range(300, 310)]
    rows = [(i, [*v[:-1], -abs(v[-1])]) for i, v in rows]
    # scores beyond 64 bits that are never among the best
    rows += [(400, [0.0, 0.0, 0.0, 0.0, 0.0, 2.0 ** 50]), (401, [1.0] * 5 + [2.0 ** 52])] + [(410 + i, [0.0] * 5 + [-i / 64]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, [int(x * 1024 // 1) for x in v]) for i, v in rows]
    want = []
    for i, a in q:
        if i in (0, 100, 200, 300, 303, 411):
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for block_rows in (64, 1000):
        out = topk.search(df, F.col("vec_id").isin(0, 100, 200, 300, 303, 411), block_rows=block_rows)
        assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    for bad in ([2.0 ** 60], [2.0 ** 45]):  # no 64-bit value, no 64-bit score: an error, no lost row
        both = spark.createDataFrame([(0, bad), (1, bad)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.search(both, F.col("vec_id") == 0).collect()


def test_rows_without_an_id_are_dealt_over_all_chunks(spark):
    rows = [(None if i % 3 else 7, f"text {i} " + "x" * 90) for i in range(600)]
    df, n, _ = chunked(bodies(frame(spark, rows)), 6000)
    sizes = [r["count"] for r in df.groupBy("chunk").count().collect()]
    assert n == 10 and len(sizes) == n and sum(sizes) == 600 and max(sizes) < 120


def test_answers_derived_from_a_reference(spark, monkeypatch):
    """A large group of near copies: most links are counted from differences, block against block; none is lost."""
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 30)
    monkeypatch.setattr(setjoin, "SLAB", 64)
    rng, base = random.Random(3), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 8, 9])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(900 + i, rows[i][1]) for i in range(5)]
    sets = shingle_sets(rows, 4)
    like = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {d: sum(like(a, b) for j, b in enumerate(sets) if j != i) for i, ((d, _), a) in enumerate(zip(rows, sets))}
    docs = frame(spark, rows)
    assert {r["doc_id"]: r["n_links"] for r in setjoin.jaccard_join(docs, 4, 85).collect()} == want
    table = setjoin.sets_of(docs, 4, 85, "doc_id", "text").filter("prefix is not null").dropDuplicates(["sig"])
    first, rest, learned, _ = setjoin._compared(table, 85, True)
    all_links = sum(like(a, b) for i, a in enumerate(sets[:120]) for b in sets[:i])
    assert first.count() + rest.count() < all_links / 4  # the others are never paired
    assert learned.filter("far <= 614").groupBy("ref").count().agg(F.max("count")).first()[0] > 60  # several blocks


def test_a_set_is_probed_once_in_each_list(spark, monkeypatch):
    """Lists whose sets are not linked stay open for all rounds, but what a set has met it doesn't meet again."""
    rng, rows = random.Random(8), []
    for i in range(42):
        rows.append((i, " ".join(rng.sample([f"w{j}" for j in range(44)], 30))))
    rows += [(90 + i, rows[i][1] + " more") for i in range(3)]
    met, probed = [], []
    monkeypatch.setattr(setjoin, "LINEAR", 0)
    untested, candidates = setjoin._untested, setjoin._candidates

    def counted(pairs, tested):
        met.append(pairs.count())
        return untested(pairs, tested)

    def noted(lists, by, *more):
        probed.append(by)
        return candidates(lists, by, *more)

    monkeypatch.setattr(setjoin, "_untested", counted)
    monkeypatch.setattr(setjoin, "_candidates", noted)
    for most in (4096, 1):  # rounds until no list is open; a whole one after the first
        monkeypatch.setattr(setjoin, "MOST_PROBES", most)
        met.clear()
        probed.clear()
        docs = frame(spark, rows)
        got = sorted(map(tuple, setjoin.jaccard_components(docs, 1, 70).drop("node").collect()), key=key)
        assert got == sorted(jaccard_components(rows, 1, 70), key=key)
        table = setjoin.sets_of(docs, 1, 70, "doc_id", "text").filter("prefix is not null").dropDuplicates(["sig"])
        lists, entries, _ = setjoin._index(table, 70)
        assert len(met) > 1 and sum(met) <= 2 * candidates(lists, None, 70, False).count()
        each = collections.Counter((r["h"], r["node"]) for by in probed for r in by.select("h", "node").collect())
        assert max(each.values()) == 1 and sum(each.values()) <= entries


@pytest.mark.parametrize("n, per_cent, big, small", [(1, 10, 10_000, 1_000), (1, 50, 4096, 2048), (1, 100, 30, 30)])
def test_links_at_the_exact_ratio_of_sizes(spark, n, per_cent, big, small):
    w = [f"w{i}" for i in range(big)]
    docs = frame(spark, [(1, " ".join(w)), (2, " ".join(w[:small])), (3, "w0 other"), (4, " ".join(reversed(w)))])
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in setjoin.jaccard_join(docs, n, per_cent).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (1, 2)}


def test_rows_of_files_are_numbered_where_they_stand(spark, tmp_path):
    """A table read from files is not written again: the row's file and its place in it are its number in all passes.
    Of other tables, even those made of such files, each row still has a number of its own."""
    import os
    from tokenmill.session import checkpoint_dir
    rng = random.Random(4)
    rows = texts() + [(None, "lone  text without id"), (61, "zz copy"), (60, "zz copy"), (61, "other")]
    rows += [(300 + i % 9, " ".join("%020x" % rng.getrandbits(80) for _ in range(900))) for i in range(40)]
    paths = [str(tmp_path / x) for x in ("a", "b c%20d")]
    for p, half in zip(paths, (rows[::2], rows[1::2])):
        frame(spark, half).repartition(3).write.parquet(p)
    docs = spark.read.parquet(*paths)
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)
    before = held()
    squeezed = lambda r: (r[0], re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""))
    least = {}
    for d, body in map(squeezed, rows):
        least[body] = min(least.get(body, (True, 0)), (d is None, d or 0))
    got = collections.Counter(squeezed((r["doc_id"], r["text"])) for r in P.drop_copies(spark, docs, "").collect())
    assert got == collections.Counter((None if none else d, body) for body, (none, d) in least.items())
    assert held() - before < sum(len(t or "") for _, t in rows) / 4
    for other in (docs, docs.union(docs), docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
                  docs.withColumn("_metadata", F.lit(1)), docs.crossJoin(spark.range(2))):
        numbered = P._numbered(other)
        assert numbered.count() == other.count() == numbered.select("_row").distinct().count()
        assert numbered.select("doc.*").columns == other.columns


def test_texts_are_not_joined_with_their_rows_again(spark, tmp_path):
    """``cut_documents`` gives its rows from the chunks: no join beyond those of the operator, and all columns as they were."""
    from tokenmill.llm import suffix
    from .fixtures import kept_bytes
    rows = texts()
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("day", F.lit(None).cast("timestamp"))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    out = suffix.cut_documents(docs)
    assert joins(out) == joins(suffix.digests(docs))
    assert out.dtypes == docs.dtypes
    want = []
    for d, t in rows:
        kept = kept_bytes(rows, d, t)
        want.append((d, t if t is None or kept == t.encode() else kept.decode("utf-8", "ignore"), "en", "N"))
    got = sorted(((r["doc_id"], r["text"], r["lang"], r["_new"]) for r in out.collect()), key=key)
    assert got == sorted(want, key=key)
    assert {(r["text"] is None, r["n_chars"]) for r in out.collect()} == {(r[1] is None, None if r[1] is None else len(r[1])) for r in want}
