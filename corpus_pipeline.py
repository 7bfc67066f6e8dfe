"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept: toxic documents go, exact copies go (the smallest id stays), one
document of each near-duplicate group stays (five-word shingles, Jaccard 0.8
or more), 50-byte strings that a document with a smaller id holds are cut out
of the text, and what is left is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenmill.llm import exact, packing, setjoin, suffix, toxicity  # noqa: E402
from tokenmill.llm.common import settled, table  # noqa: E402
from tokenmill.llm.queries import vocabulary  # noqa: E402
from tokenmill.session import scratch_path  # noqa: E402


def _from_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of Parquet files as it was read, so that a row is known by its file and its place in it."""
    if "_metadata" in docs.columns or docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _numbered(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, doc): a number for each row, the same in all passes (ids may be null or repeat), and the
    row itself as one struct, so any column names of its own are safe. The number is the row's file and its place in
    it; a table that is not read from files, as the stages' own are, is written once."""
    row = F.struct(*docs.columns).alias("doc")
    rows = docs.select(row, "_metadata") if _from_files(docs) else settled(docs.select(row)).select("doc", "_metadata")
    rows = rows.select("doc", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    number = F.row_number().over(Window.orderBy("file")).cast("long")  # one row for each file
    files = settled(rows.select("file").distinct().select("file", number.alias("number")))
    return rows.join(F.broadcast(files), "file").select(
        (F.shiftleft("number", 38) + F.col("place")).alias("_row"), F.col("doc.doc_id"), F.col("doc.text"), "doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    gone = exact.dedup_rows(rows, "_row").filter("not kept").select(F.col("row").alias("_gone"))
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays (null last, then the first row)."""
    rows = _numbered(docs)
    groups = setjoin.jaccard_components(rows, n=5, per_cent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct("none", "id", "_row")).alias("first")
    kept = groups.join(ids, "_row").groupBy("component_id").agg(first).select(F.col("first._row").alias("_kept"))
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing are passed on as they are (null too); bytes of a character that is
    cut in two are dropped with it."""
    return suffix.cut_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("suffix_dedup", cut_repeats), ("packing", pack)]

#: The fitted severity model and the packing have no SQL form; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared checkpoint
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
