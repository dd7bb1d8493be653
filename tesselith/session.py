"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "tesselith", master: str | None = None, **extra: str) -> SparkSession:
    """A UTC, adaptive session. On a cluster, leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        settings["spark.driver.memory"] = os.environ.get("TESSELITH_DRIVER_MEMORY", "8g")
    settings.update(extra)
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tesselith-")) / "tesselith.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
