"""Spark session and shared-storage helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module
only builds one for tests, the bench and the command line, and resolves the
shared folder used to cut lineage (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Broadcast a side only when it is below this many rows (checked, see
# ``operators.ranking.sized_broadcast``); beyond it the join shuffles.
BROADCAST_ROW_LIMIT = 1_000_000


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "riskframe",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local/test session: AQE on, UTC, Arrow on, UI off."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("RISKFRAME_DRIVER_MEMORY", "16g"),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` is set by the operator and points at
    shared storage; we only read it. A folder of our own is set only when the
    setting is absent (local tests).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: Rows that one task of a fit reads: at least, while there are fewer tasks than cores, and at most.
SPREAD_ROWS = (10_000, 1_000_000)


def spread(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """``df`` dealt evenly over tasks (round robin). A file of one row group is read by
    one task, and every pass of a fit over it would run in that task alone; dealt once
    before it is kept, the rows use all cores whatever the files look like."""
    least, most = SPREAD_ROWS
    n = df.count() if n_rows is None else n_rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(-(-n // least), 2 * cores), -(-n // most)))


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage like
    a checkpoint, and takes a fraction of its room (columns, compressed)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
