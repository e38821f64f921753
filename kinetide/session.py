"""Session set-up and lineage cutting."""
from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "kinetide", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KINETIDE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by the cluster; only a local master gets a folder of its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df on reliable storage so that later passes neither recompute it nor lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver was started from (like --py-files)."""
    context = spark.sparkContext
    if getattr(context, "_kinetide_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    archive = shutil.make_archive(f"{folder}/kinetide", "zip", PACKAGE.parent, PACKAGE.name)
    context.addPyFile(archive)
    context._kinetide_shipped = True
