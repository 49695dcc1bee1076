"""Session-level helpers: checkpointing and row-level guards."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters without any."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="sessionloom-ckpt-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably so that iterations stay short and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Arrow stages also run where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_sessionloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sessionloom-"), "sessionloom_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._sessionloom_shipped = True


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise when ``violations`` has a row; reads one row only."""
    row = violations.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")
