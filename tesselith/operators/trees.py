"""Reduction of a stack by a binary tree over leaves of frames in a row.

Frames in their order make leaves of equal size (the last one may be smaller), and a
leaf's samples are rejected and combined like any stack. Leaves then merge as a
binary counter carries: two neighbours of one level make a node of the next, and what
has no neighbour waits; at the end the waiting nodes join, the largest first, from left
to right. For any number of leaves so many merges lie above a leaf as the number has digits.

A level is one aggregate over all positions, nodes and groups at once. The rows are dealt by
position before the first one, and each further level finds them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.operators import stacking as S

LEAF_FRAMES = 16
#: Levels that a tree may have: with leaves of 16 frames, enough for 16 * 2**32 frames.
MOST_LEVELS = 32
WEIGHTED = "quality_weighted"


def contiguous_leaves(stack: DataFrame, order: list[Column], group: list[str], size: int = LEAF_FRAMES) -> DataFrame:
    """``leaf`` for each row, of so many frames in a row, ``frames`` in that leaf, and ``leaves`` of the group; frames are few beside their samples."""
    w = Window.partitionBy(*group)
    ranked = stack.select(*group, "frame").distinct().withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count(F.lit(1)).over(w))
    leaf = F.floor(F.col("place") / size)
    frames = F.least(F.col("total") - leaf * size, F.lit(size))
    return stack.join(ranked.select(*group, "frame", leaf.alias("leaf"), frames.alias("frames"), F.ceil(F.col("total") / size).alias("leaves")), [*group, "frame"])


def _leaf_nodes(rows: DataFrame, keys: list[str], method: str, rule: S.Rejection | None, weight: Column | None) -> DataFrame:
    """(keys, node, leaves, frames, value, n, weight): a leaf where it has samples at all."""
    own = [*keys, "leaf", "frames", "leaves"]
    if method == WEIGHTED:
        values = S.weighted_mean(rows, own, F.lit(1.0) if weight is None else weight, rule)
    elif rule is None:
        values = S.combine(rows, own, method).select(*own, "value", F.lit(0.0).alias("weight"))
    else:
        values = S.reject_or_combine(rows, own, rule, method).select(*own, "value", F.lit(0.0).alias("weight"))
    counts = rows.groupBy(*own).agg(F.count(S.sample()).alias("n"))
    return counts.join(values, own, "left").select(*keys, F.col("leaf").alias("node"), "leaves", "frames", F.coalesce("value", F.lit(0.0)).alias("value"), "n", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("n") > 0).alias("valid"))


def _merged(children: DataFrame, keys: list[str], method: str, rejected: bool) -> DataFrame:
    """One node of each two children with equal keys; a child alone stays as it is.

    Two values are too few for rejection, so a merge combines what the leaves' rejection has left: means by weights or, where nothing
    was rejected, by counts; other methods by themselves, from children with enough samples."""
    seen = F.when(F.col("valid"), F.col("value"))
    if method == WEIGHTED:
        w = F.when(F.col("valid"), F.col("weight"))
        value, weight = F.coalesce(F.try_divide(F.sum(w * F.col("value")), F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)), F.coalesce(F.sum(w), F.lit(0.0))
    elif method == "mean" and not rejected:
        value, weight = F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("n")), F.nullif(F.sum("n").cast("double"), F.lit(0.0))), F.lit(0.0)), F.lit(0.0)
    else:
        value, weight = S.combined(method, seen), F.lit(0.0)
    alone = F.count(F.lit(1)) == 1
    pick = lambda name, other: F.when(alone, F.first(name)).otherwise(other)
    n, frames = F.sum("n"), F.sum("frames")
    return children.groupBy(*keys).agg(
        pick("value", value).alias("value"), n.alias("n"), pick("weight", weight).alias("weight"), frames.alias("frames"), pick("valid", S.enough(n, frames)).alias("valid"), F.first("leaves").alias("leaves")
    )


def carry_tree(stack: DataFrame, keys: list[str], order: list[Column], group: list[str], method: str, rule: S.Rejection | None = None, weight: Column | None = None, size: int = LEAF_FRAMES) -> DataFrame:
    """(keys, value, n, weight, valid): the tree's root at each position of each group; 0 where too few frames have a sample.

    ``method``: as of ``stacking.combined``, or quality_weighted with each frame's ``weight``. ``keys`` hold ``group``. A position has all its
    group's frames, with ``ok`` false where a sample is missing; frames without a row there count for nothing at all."""
    dealt = contiguous_leaves(stack, order, group, size)
    nodes = _leaf_nodes(dealt, keys, method, rule, weight).repartition(*keys)
    most = dealt.agg(F.max("leaves").alias("m")).first()["m"] or 0
    waiting, span = [], 1
    while span < most and len(waiting) < MOST_LEVELS:
        there = F.floor(F.col("leaves") / span)  # whole nodes of this level
        odd = (there % 2 == 1) & (F.col("node") == there - 1)
        waiting.append(nodes.where(odd))
        pairs = nodes.where(~odd).withColumn("node", F.floor(F.col("node") / 2))
        nodes = _merged(pairs, [*keys, "node"], method, rule is not None)
        span *= 2
    root = nodes.drop("node")
    for level in reversed(waiting):  # the node of more leaves stands to the left
        root = _merged(root.unionByName(level.drop("node")), keys, method, rule is not None)
    valid = S.enough(F.col("n"), F.col("frames"))
    return root.select(*keys, F.when(valid, F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("value"), "n", "weight", valid.alias("valid"))


def merge_weighted(nodes: DataFrame, keys: list[str], rule: S.Rejection | None) -> DataFrame:
    """(keys, value, weight): nodes (keys, value, weight, valid) of weighted means merged by weights, after rejection over the nodes' values.

    Fewer than four nodes are merged as they are. Winsorizing moves values and keeps their weights."""
    rows = nodes.withColumnsRenamed({"value": "v", "valid": "ok"})
    rows = rows.withColumn("kept", S.sample()) if rule is None else S.clipped(rows, keys, rule)
    w = F.when(F.col("kept").isNotNull(), F.col("weight"))
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(w * F.col("kept")), F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)).alias("value"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"))
