"""Frames beside the results of their registration, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_flow_metrics(frames: DataFrame, flow: DataFrame, key: str, overlays: dict[str, str]) -> DataFrame:
    """All frames, with the flow's columns and ``in_flow``. ``overlays``: a frame's metric by the flow's that goes before it."""
    joined = frames.join(flow.withColumn("in_flow", F.lit(True)), key, "left").withColumn("in_flow", F.coalesce("in_flow", F.lit(False)))
    return joined.withColumns({metric: F.coalesce(F.col(other), F.col(metric)) for metric, other in overlays.items()})


def _in_force(flow: DataFrame, revision: int, matrix: str) -> DataFrame:
    return flow.where((F.col("revision") == revision) & F.col(matrix).isNotNull())


def usable_transforms(frames: DataFrame, flow: DataFrame, key: str, revision: int, matrix: str) -> DataFrame:
    """The frames that have a transform of this revision with a matrix, and its columns."""
    return frames.join(_in_force(flow, revision, matrix), key)


def without_transform(frames: DataFrame, flow: DataFrame, key: str, revision: int, matrix: str) -> DataFrame:
    """The other frames: no transform, one of another revision, or one without a matrix."""
    return frames.join(_in_force(flow, revision, matrix).select(key), key, "left_anti")


def present_in(frames: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """The frames whose key is in each of the other tables. Merged: keys that are few bytes on disk may be too many for the driver to broadcast."""
    for other in others:
        frames = frames.join(other.select(key).hint("merge"), key, "left_semi")
    return frames


def disconnected(accepted: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """The keys of accepted frames that aren't among the visited ones, each once."""
    return accepted.select(key).distinct().join(visited.select(key), key, "left_anti")


def active_flows(batches: DataFrame, manifest: DataFrame, local_manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(batch, path, origin, found): where each batch's flow is read from.

    The manifest of the night (batch, path) goes before that of the batch (batch, path), and that before the file of
    old in the batch's folder. ``files`` (path): what there is; a path that isn't among them is not ``found``, and no
    other takes its place. A row of a manifest with a null or empty path counts as none, and of several rows the greatest path."""

    def told(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("path <> ''").groupBy("batch").agg(F.max("path").alias(name))

    rows = batches.select("batch").distinct().join(told(manifest, "night"), "batch", "left").join(told(local_manifest, "own"), "batch", "left")
    origin = F.when(F.col("night").isNotNull(), "manifest").when(F.col("own").isNotNull(), "batch_manifest").otherwise("legacy")
    rows = rows.select("batch", F.coalesce("night", "own", F.concat("batch", F.lit("/flow_local.json"))).alias("path"), origin.alias("origin"))
    there = files.select("path").distinct().withColumn("found", F.lit(True))
    return rows.join(there, "path", "left").select("batch", "path", "origin", F.coalesce("found", F.lit(False)).alias("found"))


def all_batches(legacy: DataFrame, manifest: DataFrame) -> DataFrame:
    """(batch, path) of both lists, each batch once; the manifest's rows go first, then the greatest path."""
    both = manifest.select("batch", "path", F.lit(1).alias("first")).unionByName(legacy.select("batch", "path", F.lit(0).alias("first")))
    return both.groupBy("batch").agg(F.max(F.struct("first", "path")).alias("b")).select("batch", "b.path")
