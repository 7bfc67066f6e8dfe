"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, lm, packing, phrases, rankbpe, setjoin, spelling, suffix, topk, toxicity, urls, wavelet
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file (of the installed package, so it is there on every executor too)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_wavelet")
def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts, written as wavelet-matrix shards and read back."""
    return wavelet.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), width=16, end_id=1)


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all texts and the texts decoded from them."""
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query("op8_exact_dedup", r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') body from documents)
select doc_id, min(doc_id) over w keep_id, count(*) over w group_size, doc_id = min(doc_id) over w kept,
       sha256(body) text_sha256, doc_id > (select (min(doc_id) + max(doc_id)) // 2 from documents)
       and min(doc_id) over w <= (select (min(doc_id) + max(doc_id)) // 2 from documents) known
from t window w as (partition by body)""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the lower half of the ids is the snapshot."""
    return exact.dedup(documents(spark, sf_dir))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=2)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that a 50-byte string shared with a smaller id covers."""
    return suffix.digests(documents(spark, sf_dir))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and numbers of links of all documents under Jaccard similarity of 4-word shingles,
    0.85 or more."""
    return setjoin.jaccard_join(documents(spark, sf_dir), n=4, per_cent=85).drop("node")


@query("op1_topk", """
with v as (select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] e from embeddings
           where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select * from v where vec_id % 100 = 0),
s as (select q.vec_id query_id, v.vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.e, v.e)]) as bigint) score
      from q join v on q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) rank, vec_id, score from r where rank <= 10""")
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector against all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the backoff automaton of six sevenths of them."""
    return lm.score(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


#: (verdict, host, path) of the query's rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages: by the longest rule, else by the page's aliases."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, learnt from the labels table."""
    return toxicity.severity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op11_spelling", r"""
with recursive crc as (
  select list(list_reduce(list_concat([i::bigint], range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) t
  from range(256) r(i)),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
counted as (select doc_id, run, count(*) k from runs group by all),
hashed as (
  select run, k, xor(list_reduce(list_concat([4294967295::bigint], flatten([case when u < 128 then [u] else [192 + (u >> 6), 128 + (u & 63)] end
    for u in [unicode(ch)::bigint for ch in string_split(coalesce(doc_id::varchar, '') || ':' || run, '')]])),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) h from counted, crc),
words as (
  select word, sum(k)::bigint n from (
    select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word, k from hashed)
  where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, i, left(word, i::int) || substr(word, i::int + 2) rest from (select word, unnest(range(length(word))) i from words)),
near as (
  select a.word, b.word near from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select c.word, w.word from cut c join words w on c.rest = w.word
  union select w.word, c.word from cut c join words w on c.rest = w.word),
best as (
  select near.word, count(*) n_near, arg_min(near.near, (-w.n, near.near)) near, max(w.n) near_n from near join words w on near.near = w.word group by 1),
forms as (
  select words.word, n, coalesce(n_near, 0) n_near, case when near_n >= 5 * n then near end form, case when near_n >= 5 * n then near_n end form_n
  from words left join best using (word)),
steps as (
  select word, word cur, 0 depth from forms
  union all select s.word, f.form, depth + 1 from steps s join forms f on s.cur = f.word where f.form is not null)
select f.word, form, (select arg_max(s.cur, s.depth) from steps s where s.word = f.word) root, n, n_near, form_n from forms f""")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart, each word's form and the root of its chain of forms."""
    return spelling.variants(documents(spark, sf_dir))


@query("op12_phrases", r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) piece from documents),
tokens as (select lang, regexp_extract_all(piece, '[^ 	]+') w from pieces),
grams as (
  select lang, w[i:i + k - 1] p, count(*) f from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i
    from tokens, (select unnest(range(1, 6)) k) where len(w) >= k) group by all),
totals as (select lang, sum(f)::bigint n from grams where len(p) = 1 group by lang),
candidates as (select lang, p, f a from grams where len(p) > 1 and f >= 100),
inner_parts as (
  select lang, p[s:s + k - 1] p, max(a) longer from (
    select lang, p, a, k, unnest(range(1, len(p) - k + 2)) s from (select lang, p, a, unnest(range(2, len(p))) k from candidates where len(p) > 2))
  group by all),
kept as (select c.* from candidates c left join inner_parts i using (lang, p) where longer is null or longer * 100 < a * 100),
cuts as (
  select c.lang, c.p, a, n, k, x.f l, y.f r, (1000::hugeint * a * n) // (x.f::hugeint * y.f) score
  from (select *, unnest(range(1, len(p))) k from kept) c join totals using (lang)
  join grams x on x.lang = c.lang and x.p = c.p[1:k] join grams y on y.lang = c.lang and y.p = c.p[k + 1:]),
weakest as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) rank,
         array_to_string(p, ' ') phrase, a, l, r, n, score::bigint score from weakest)
select * from ranked where rank <= 2000""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best collocations of two to five words."""
    return phrases.collocations(documents(spark, sf_dir))


@query("op13_rank_bpe")
def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts by a rank file, and the texts decoded from them."""
    import public_tokenizers
    return rankbpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py at the repository top."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
