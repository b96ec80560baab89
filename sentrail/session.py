"""Session helpers: a tuned local session, table access, lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "sentrail", memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the given session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only where none is set (tests) make a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sentrail-checkpoints")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder, so later stages survive executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of up to 200 bytes that a broadcast side may have (40 MB).
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it is counted to have at most BROADCAST_ROWS rows, else as it is.

    For narrow tables that are cheap to count (cut or read columns), or whose rows are known to be at most
    `rows`; beyond the bound Spark shuffles.
    """
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
