"""Corpus sources (S2-S9): named corpora, splits, JSON lines, offset splits,
tail hold-outs, vocabulary files, sample logs and capped scans."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as X
from ..functions.vocab import Vocabulary
from ..operators.offsets import row_index


# ------------------------------------------------------------------- S2 --
def scan_split_dataset(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """A saved split dataset (parquet partitioned by ``split``); the split is
    chosen by a partition filter, so other splits are never read."""
    return spark.read.parquet(path).where(F.col(split_col) == split)


# ------------------------------------------------------------------- S3 --
@dataclass(frozen=True)
class CorpusSpec:
    name: str
    text_col: str = "text"
    drop_cols: tuple = ()
    validation_split: str = "validation"
    fmt: str = "parquet"
    options: dict = field(default_factory=dict)
    #: What makes a split: 'column' (rows of that ``split``), 'offsets' of one raw text, or the table without its last
    #: rows ('head') or these alone ('tail').
    form: str = "column"

    def detokenizer(self):
        return X.detokenizer_for(self.name)


# FIXED VALUES: corpus names, their text column, the columns dropped after
# tokenising and the name of their validation split.
CORPORA = {
    "wikitext103": CorpusSpec("wikitext103"),
    "wikitext2": CorpusSpec("wikitext2"),
    "ptb": CorpusSpec("ptb", text_col="sentence"),
    "lambada": CorpusSpec("lambada"),
    "text8": CorpusSpec("text8", validation_split="test", fmt="text", form="offsets"),
    "text8-crop": CorpusSpec("text8-crop", fmt="text", form="offsets"),
    "openwebtext-train": CorpusSpec("openwebtext-train", form="head"),
    "openwebtext-valid": CorpusSpec("openwebtext-valid", form="tail"),
    "scientific_papers_arxiv": CorpusSpec("scientific_papers_arxiv", text_col="article",
                                          drop_cols=("article", "abstract", "section_names")),
    "scientific_papers_pubmed": CorpusSpec("scientific_papers_pubmed", text_col="article",
                                           drop_cols=("article", "abstract", "section_names")),
    "ag_news": CorpusSpec("ag_news", drop_cols=("text", "label"), validation_split="test"),
    "lm1b": CorpusSpec("lm1b", validation_split="test"),
    "smiles": CorpusSpec("smiles", text_col="input"),
}


def corpus_spec(name: str) -> CorpusSpec:
    """Registered spec, or a plain ``text`` corpus under any other name."""
    return CORPORA.get(name, CorpusSpec(name))


def validation_split_name(name: str) -> str:
    return corpus_spec(name).validation_split


HOLDOUT_ROWS = 100_000  # FIXED VALUE: rows of the hold-out of the 'head' and 'tail' corpora


def scan_corpus(spark: SparkSession, name: str, path: str, detokenize: bool = True, mode: str | None = None,
                order_cols=("id",), chunk: int = 1024, holdout: int = HOLDOUT_ROWS, splits=None) -> DataFrame:
    """Read a corpus and expose its text as ``text`` (detokenised by the
    corpus' rule), without the columns that the corpus drops; others are kept
    for the caller to prune.

    With ``mode`` (a split's name) only that split is read, in the form of the corpus: rows whose ``split`` column
    says so (a partition filter, if the table is partitioned by it; a table without that column is one split),
    chunks of ``chunk`` bytes between the fixed offsets of one raw text (``splits``), or, whatever the mode, all but
    the last ``holdout`` rows in ``order_cols`` order or these alone."""
    spec = corpus_spec(name)
    if mode is not None and spec.form == "offsets":
        df = scan_text8(spark, path, mode, chunk, splits=splits or TEXT8_SPLITS)
        return adapt_text(df, spec, detokenize)
    df = spark.read.format(spec.fmt).options(**spec.options).load(path)
    if mode is not None:
        if spec.form in ("head", "tail"):
            df = tail_holdout(df, list(order_cols), holdout)[spec.form == "tail"]
        elif "split" in df.columns:
            df = df.where(F.col("split") == mode)
    return drop_source_columns(adapt_text(df, spec, detokenize), spec)


def drop_source_columns(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Without the corpus' own columns; ``text``, which holds what is tokenised, stays until ``model_columns``."""
    return df.drop(*[c for c in spec.drop_cols if c != "text"])


def adapt_text(df: DataFrame, spec: CorpusSpec, detokenize: bool = True) -> DataFrame:
    col = text_column(df, spec.text_col)
    det = spec.detokenizer() if detokenize else None
    t = F.col(col)
    return df.withColumn("text", det(t) if det else t).withColumn("corpus", F.lit(spec.name))


# ------------------------------------------------------------------- P7 --
def text_column(df: DataFrame, preferred: str = "text") -> str:
    """The corpus' own column if the table has it, else ``input`` (molecules), else ``text``."""
    cols = set(df.columns)
    for c in (preferred, "input", "text"):
        if c in cols:
            return c
    raise ValueError(f"no text column in {df.columns}")


# ------------------------------------------------------------------- P8 --
def model_columns(df: DataFrame, keep=("input_ids", "attention_mask")) -> DataFrame:
    """Everything except the model inputs is dropped (pruned at the scan)."""
    return df.select(*[c for c in keep if c in df.columns])


# ------------------------------------------------------------------- S4 --
def scan_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped by the reader."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# ------------------------------------------------------------------- S5 --
TEXT8_SPLITS = (("train", 0, 90_000_000), ("validation", 90_000_000, 95_000_000), ("test", 95_000_000, None))


def split_by_char_offset(df: DataFrame, text_col: str, splits=TEXT8_SPLITS, keep=()) -> DataFrame:
    """One long text per row -> one row per split (with the columns ``keep``), cut at fixed character offsets. A text
    that is too large for a row is read by ``read_byte_chunks``."""
    arr = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(s).alias("s"),
                             F.lit(e if e is not None else -1).alias("e")) for n, s, e in splits])
    t = F.col(text_col)
    out = df.select(*keep, t.alias("_t"), F.explode(arr).alias("_sp"))
    ln = F.when(F.col("_sp.e") < 0, F.char_length("_t") - F.col("_sp.s")).otherwise(F.col("_sp.e") - F.col("_sp.s"))
    return out.select(*keep, F.col("_sp.split").alias("split"),
                      F.substring(F.col("_t"), F.col("_sp.s") + 1, F.greatest(ln, F.lit(0))).alias("text"))


#: Bytes that a task reads at once, and about what it reads in all.
SPAN_BYTES, TASK_BYTES = 8 << 20, 128 << 20


def read_byte_chunks(spark: SparkSession, path: str, start: int, end: int | None, chunk: int) -> DataFrame:
    """S5 + K6 for one huge UTF-8 text: ``path`` is a file, or a folder whose files are the text in name order (files
    beginning with ``_`` or ``.`` are left out). Bytes ``start`` to ``end`` (None: to the end) in chunks of ``chunk``
    bytes, by positioned reads inside the tasks: the text never becomes one row.

    Every boundary that falls inside a character moves on to the next one, so chunks hold whole characters and none
    is lost; in single-byte text offsets are characters. Bytes that are no UTF-8 become U+FFFD. Returns (chunk_idx,
    text), none for an empty range."""
    from . import fs
    files, size = [], 0  # (file, its first byte in the text)
    for f, n in fs.list_sizes(path):
        if f.rpartition("/")[2][0] not in "_.":
            files.append((f, size))
            size += n
    stop = size if end is None else min(end, size)
    n = max(-(-(stop - start) // chunk), 0)
    rows_a_span = max(1, SPAN_BYTES // chunk)

    def span(a: int, b: int) -> bytes:
        """Bytes a to b of the text, which may go on from file to file."""
        out = []
        at = bisect_right(files, a, key=lambda x: x[1]) - 1
        while a < b and at < len(files):
            until = min(b, files[at + 1][1]) if at + 1 < len(files) else b
            with fs.open_input(files[at][0]) as f:  # positioned reads on shared storage
                f.seek(a - files[at][1])
                out.append(f.read(until - a))
            a, at = until, at + 1
        return b"".join(out)

    def boundary(data: bytes, at: int) -> int:
        """The first character start at or after ``at``; a character has at most three further bytes."""
        for k in range(at, min(at + 3, len(data))):
            if data[k] & 0xC0 != 0x80:
                return k
        return min(at + 3, len(data))

    def read(batches):
        for b in batches:
            ids = b["id"].to_numpy()
            breaks = np.flatnonzero(np.diff(ids) != 1) + 1
            for run in np.split(ids, breaks):
                for k in range(0, len(run), rows_a_span):
                    part = run[k:k + rows_a_span]
                    lo, hi = start + int(part[0]) * chunk, min(start + (int(part[-1]) + 1) * chunk, stop)
                    data = span(lo, min(hi + 3, size))
                    cuts = [boundary(data, min(i * chunk, hi - lo)) for i in range(len(part) + 1)]
                    if lo == 0:
                        cuts[0] = 0
                    yield pd.DataFrame({"chunk_idx": part, "text": [data[x:y].decode("utf-8", "replace")
                                                                    for x, y in zip(cuts, cuts[1:])]})

    tasks = max(1, min(n, -(-n * chunk // TASK_BYTES)), min(n, spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, tasks).mapInPandas(read, "chunk_idx long, text string")


def scan_text8(spark: SparkSession, path: str, split: str, chunk: int, drop_last: bool = True, splits=TEXT8_SPLITS) -> DataFrame:
    """The raw text at ``path``, its split by fixed offsets, in chunks of ``chunk`` bytes as (id, text); a last chunk that
    is short is left out with ``drop_last``, as in the training corpus of that name."""
    from . import fs
    bounds = {name: (s, e) for name, s, e in splits}
    if split not in bounds:
        raise ValueError(f"no split {split!r}: one of {sorted(bounds)}")
    s, e = bounds[split]
    size = sum(n for f, n in fs.list_sizes(path) if f.rpartition("/")[2][0] not in "_.")
    stop = size if e is None else min(e, size)
    if drop_last:
        stop = s + max(stop - s, 0) // chunk * chunk
    return read_byte_chunks(spark, path, s, stop, chunk).withColumnRenamed("chunk_idx", "id")


# ------------------------------------------------------------------- S6 --
def tail_holdout(df: DataFrame, order_cols, holdout: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``train[:-N]`` / ``train[-N:]`` by row order (null keys first). Only the order keys are indexed: the key and the
    place among its equals of the first row held out come back, and rows are told apart by their key as they are
    scanned. Rows that share that key are told apart by the hash of the whole row; equal rows are split by number."""
    order_cols = list(order_cols)
    key, cols = F.struct(*order_cols), df.columns
    narrow = row_index(df.select(key.alias("_key")), ["_key"], out_col="_idx")
    cut = max(narrow.count() - holdout, 0)
    first = narrow.where(F.col("_idx") == cut).first() if cut else None
    if first is None:  # nothing on one of the sides
        return (df, df.limit(0)) if cut else (df.limit(0), df)
    edge = F.struct(*[F.lit(first["_key"][f.name]).cast(f.dataType).alias(f.name)
                      for f in narrow.schema["_key"].dataType.fields])
    equals = narrow.where(F.col("_key") == edge).agg(F.min("_idx").alias("first"), F.count(F.lit(1)).alias("rows")).first()
    if equals["rows"] == 1:
        return df.where(key < edge), df.where(key >= edge)
    tied = row_index(df.where(key == edge).withColumn("_h", F.xxhash64(*cols)), ["_h"], out_col="_at")
    left = F.col("_at") < cut - equals["first"]
    return (df.where(key < edge).unionByName(tied.where(left).select(*cols)),
            df.where(key > edge).unionByName(tied.where(~left).select(*cols)))


# ------------------------------------------------------------------- S7 --
def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line; id = line number; a token on several lines keeps
    its last line. A vocabulary file is small and read as one text value."""
    from . import fs
    if not fs.exists(path):
        raise FileNotFoundError(path)
    whole = spark.read.text(path, wholetext=True)
    # a trailing newline leaves one empty last element that is not a line
    n_lines = F.size(F.split(F.regexp_replace(F.col("value"), "\n$", ""), "\n"))
    lines = whole.select(n_lines.alias("_n"), F.posexplode(F.split(F.col("value"), "\n")).alias("id", "token")) \
        .where(F.col("id") < F.col("_n")).drop("_n")
    return lines.groupBy("token").agg(F.max("id").cast("int").alias("id"))


def load_vocab(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary file at ``path``, whole (a parameter of a job, read by the driver): every line is a token."""
    return Vocabulary((r["token"], r["id"]) for r in scan_vocab(spark, path).collect())


# ------------------------------------------------------------------- S8 --
SAMPLE_LOG_SCHEMA = StructType([
    StructField("gen_ppl_raw", StringType()), StructField("nfes_raw", StringType()),
    StructField("entropy_raw", StringType()), StructField("gen_lengths_raw", StringType()),
    StructField("samples", StringType()), StructField("seed_raw", StringType())])


def sample_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Every header-less CSV of a folder with fixed positional columns; cells
    are cast (never evaluated); the file name is kept."""
    df = spark.read.schema(SAMPLE_LOG_SCHEMA).option("header", "false").csv(path)
    return df.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), "gen_ppl_raw",
        F.expr("try_cast(gen_ppl_raw as double)").alias("gen_ppl"),
        F.expr("try_cast(nfes_raw as double)").alias("nfes"), "nfes_raw",
        F.expr("try_cast(entropy_raw as double)").alias("entropy"),
        F.expr("try_cast(gen_lengths_raw as double)").alias("gen_lengths"),
        "samples", F.expr("try_cast(seed_raw as int)").alias("seed"))


# ------------------------------------------------------------------- S9 --
def scan_limited(df: DataFrame, col: str, max_rows: int) -> DataFrame:
    """Non-null rows of ``col`` up to ``max_rows`` (a cap is the feature here), partition after partition.

    The rows are counted per partition first; each partition then keeps its share of the cap, so no task sees
    more than its own rows. ``df`` must be a scan or another plan that gives the same partitions twice; the
    driver gets one count a partition."""
    rows = df.where(F.col(col).isNotNull()).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    left, shares = max_rows, []
    for p, n in sorted(rows.groupBy(part.alias("p")).count().collect()):
        shares.append((p, min(n, left)))
        left -= shares[-1][1]
    if not left or sum(n for _, n in shares) == max_rows:
        keep = df.sparkSession.createDataFrame(shares, "_part long, _share long")
        return rows.join(F.broadcast(keep), part == F.col("_part")).where(place < F.col("_share")).select(*df.columns)
    return rows.select(*df.columns)


def scan_progress(df: DataFrame, col: str) -> DataFrame:
    """S9's report: rows and null rows of each input file."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(col).isNull()).alias("n_null"))


def union_splits(parts: dict) -> DataFrame:
    """U-3: several split DataFrames as one with a ``split`` column."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out

