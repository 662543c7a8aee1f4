"""Session factory and the shared folder used for cut points and streams."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "sensorgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC times, adaptive execution and skew-join splitting on.

    `conf` keys use `__` for dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, val in SETTINGS.items():
        builder = builder.config(key, val)
    for key, val in conf.items():
        builder = builder.config(key.replace("__", "."), val)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's shared folder (`spark.checkpoint.dir`).

    Only a local session may name none: its tasks see a folder of this machine. On a
    cluster that is an error, as every executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sensorgrid-")
    return os.path.join(root.rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_sensorgrid_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="sensorgrid-"), "sensorgrid.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    context._sensorgrid_shipped = True
