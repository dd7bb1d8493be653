"""One result from the stacks of many batches, by what their manifests allow.

A batch's stack comes as a state that merges (sums, counts, weights, extremes), the visible master (16-bit codes), and a
manifest row that says how it was made. Where every batch was made by the method asked for, and nothing was rejected,
states merge to what one stack of all frames would give. Otherwise the masters are reduced, and the result says so.

Manifests are one row a batch, and the choice rests on one aggregated row; states and masters are only ever grouped by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.operators import stacking as S

STATE = ("sum", "count", "weighted_sum", "weight_sum", "highest", "lowest")
#: What a method merges, by the columns of the state that it takes.
ASSOCIATIVE = {"mean": ("sum", "count"), "sum": ("sum", "count"), "quality_weighted": ("weighted_sum", "weight_sum"), "max": ("highest",), "min": ("lowest",)}
WARNING = "the method was applied to one master of each batch; this is no reduction of all frames"


class Incompatible(ValueError):
    """The bundles can't be combined."""


@dataclass(frozen=True)
class MergePlan:
    """``branch``: sums, weights, extremes (all of states), masters_extreme or masters_median. ``hierarchical``: not the same as one stack of all frames."""

    branch: str
    hierarchical: bool
    warning: str | None
    n_batches: int
    n_frames: int


def plan_merge(manifests: DataFrame, method: str, rejection: str = "none") -> MergePlan:
    """``manifests``: (batch, method, rejection, format, height, width, channels, n_frames, state_columns array<string>).

    A rejection that a batch was made with counts like one asked for. Missing methods are mismatches; a null rejection is none."""
    need = ASSOCIATIVE.get(method)
    has = F.lit(False) if need is None else F.forall(F.array(*map(F.lit, need)), lambda c: F.coalesce(F.array_contains("state_columns", c), F.lit(False)))
    m = manifests.agg(
        F.count(F.lit(1)).alias("batches"),
        F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames"),
        F.count_distinct(F.lower(F.trim(F.coalesce("format", F.lit(""))))).alias("formats"),
        F.count_distinct("height", "width", "channels").alias("shapes"),
        F.bool_and(F.coalesce(F.col("method") == method, F.lit(False))).alias("same"),
        F.bool_or(F.coalesce("rejection", F.lit("none")) != "none").alias("rejected"),
        F.bool_and(has).alias("has"),
    ).first()
    if not m["batches"]:
        raise Incompatible("there are no bundles")
    if m["formats"] != 1:
        raise Incompatible("bundles have different formats")
    if m["shapes"] > 1:
        raise Incompatible("bundles have different sizes")
    robust = rejection != "none" or m["rejected"]
    if not robust and m["same"] and m["has"]:
        branch = {"mean": "sums", "sum": "sums", "quality_weighted": "weights"}.get(method, "extremes")
    else:
        branch = "masters_extreme" if method in ("max", "min") and not robust else "masters_median"
    hierarchical = robust or not m["same"] or method == "median" or method not in ASSOCIATIVE
    warned = robust or not m["same"] or method == "median"
    return MergePlan(branch, hierarchical, WARNING if warned else None, m["batches"], m["frames"])


def combine_bundles(manifests: DataFrame, states: DataFrame, keys: list[str], method: str, rejection: str = "none") -> DataFrame:
    """(keys, value, code, valid, saturated, branch) at each position of ``states`` (batch, keys, the columns of STATE, master, valid, saturated).

    A position is valid, or saturated, where any batch is. Only batches of the manifests count. ``code``: the value on 16 bits."""
    plan = plan_merge(manifests, method, rejection)
    rows = states.join(manifests.select("batch").distinct(), "batch", "left_semi")
    zero = F.lit(0.0)
    if plan.branch == "sums":
        total = F.coalesce(F.sum("sum"), zero)
        value = total if method == "sum" else total / F.greatest(F.coalesce(F.sum("count"), F.lit(0)), F.lit(1))
    elif plan.branch == "weights":
        value = F.coalesce(F.sum("weighted_sum"), zero) / F.greatest(F.coalesce(F.sum("weight_sum"), zero), F.lit(1e-12))
    elif plan.branch == "extremes":
        own = F.col("highest" if method == "max" else "lowest")
        best = F.max if method == "max" else F.min
        value = F.coalesce(best(F.when(F.col("valid"), own)), best(own), zero)
    elif plan.branch == "masters_extreme":
        value = (F.max if method == "max" else F.min)("master")
    else:
        value = F.median("master")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    merged = rows.groupBy(*keys).agg(value.cast("double").alias("value"), any_("valid").alias("valid"), any_("saturated").alias("saturated"))
    return merged.select(*keys, "value", S.clip_uint16(F.col("value")).alias("code"), "valid", "saturated", F.lit(plan.branch).alias("branch"))
