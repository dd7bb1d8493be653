"""Sinks and sources of stacks: Parquet by batch, the revision in force named by an optimistic log of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselith.sources import revisions

TABLE = "stack"


def write_revision(df: DataFrame, root: str, revision: str, partition: str | None = None) -> None:
    """Write a table under ``root`` and put it in force under the name ``revision``.

    Readers go by the log, so they see the old revision until the new one is whole; a writer that another one has
    overtaken gets a ``revisions.Conflict``."""
    spark = df.sparkSession
    at = revisions.head(spark, root)
    revisions.publish(spark, root, at.version if at else None, {TABLE: df}, revision, partition=partition)


def current_revision(spark: SparkSession, root: str) -> str:
    at = revisions.head(spark, root)
    if at is None:
        raise KeyError(root)
    return at.name


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return revisions.read(spark, root, TABLE)
