"""Tables written to the shared folder, to cut lineage and to reuse a result.

The folder is ``spark.checkpoint.dir`` of the session, which every executor and
the driver can reach. Only in local mode may it be unset; then a folder under
the warehouse directory takes its place.

Tables go when the driver's JVM ends in good order, and those of a ``scratch``
block at its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open_blocks: list[list[str]] = []


def _hadoop_path(spark: SparkSession, folder: str) -> tuple:
    """The folder as Hadoop's path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new path below the cluster's checkpoint folder; nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    folder = f"{base.rstrip('/')}/tesselith-{uuid.uuid4().hex}"
    path, files = _hadoop_path(spark, folder)
    files.deleteOnExit(path)
    if _open_blocks:
        _open_blocks[-1].append(folder)
    return folder


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The result survives lost executors (it is no cache), has a short plan, and
    gives the planner real sizes, so that later joins are broadcast only where
    they are small and adaptive execution can split their skewed sides.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are deleted at its end: whatever is needed later must be written elsewhere by then."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for folder in _open_blocks.pop():
            path, files = _hadoop_path(spark, folder)
            files.delete(path, True)
