"""Spark session defaults and small session-scoped helpers.

Everything in the library takes a ``SparkSession`` (or a DataFrame that
carries one); this module only sets the defaults the operators rely on:
UTC session time zone, AQE with partition coalescing and skew-join
splitting, and a checkpoint directory that is *read* from the session and
only set when the cluster left it unset (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators assume. ANSI mode stays at the Spark 4 default (on):
# the code uses try_* / get() where an out-of-range value is legal.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # reliable checkpoints of intermediate tables are removed once unused
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tokenmill", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given (tests use ``local[N]``); on a
    cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a given input size and cluster: about
    ``partition_bytes`` per shuffle partition (never fewer than 2 per core),
    scans split at the same size, AQE coalescing to it and splitting skewed
    partitions above four times it. The two-pass scans use the shuffle
    partition count as their number of range partitions, so their per-task
    tables stay one row per partition (tens of thousands of rows at 100 TB)."""
    n = max(-(-input_bytes // partition_bytes), 2 * total_cores)
    mb = f"{partition_bytes >> 20}m"
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{(partition_bytes * 4) >> 20}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only when it is unset (local runs, tests) a private temporary folder is
    created and registered, so that ``DataFrame.checkpoint()`` works.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage: a local "
                               "temporary folder does not survive the loss of an executor")
        d = tempfile.mkdtemp(prefix="tokenmill-ckpt-")  # single-machine runs and tests only
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, for data a job
    writes and reads back (caches, logs, shards)."""
    import uuid
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one).

    Used by iterative operators so that a lost executor only recomputes the
    last round, not the whole history.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: cuts lineage like ``cut_lineage``, and the
    planner sees the real size, where a checkpoint keeps the estimate of the plan that made it (which a loop of
    joins multiplies in every round)."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession)}/scratch/settled-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettle(*tables: DataFrame) -> None:
    """Removes tables that ``settle`` wrote, once nothing reads them any more."""
    for t in tables:
        folder = t.inputFiles()[0].rpartition("/")[0]
        if "/scratch/settled-" not in folder:
            raise ValueError(f"not a settled table: {folder}")
        remove_folder(t.sparkSession, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that a job wrote for itself, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
