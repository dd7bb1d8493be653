"""One stack from metrics and pixels to coded output: trails, exclusion, scores, selection, weights, reduction, mask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.config import SelectionSettings, StackSettings
from tesselith.functions import metrics as M
from tesselith.operators import ranking as R
from tesselith.operators import stacking as S
from tesselith.staging import stage


@dataclass(frozen=True)
class StackPlan:
    """Which frames a stack takes, what each counts, and how they are combined."""

    stack: StackSettings = field(default_factory=lambda: StackSettings(combination="quality_weighted", rejection="sigma"))
    selection: SelectionSettings = field(default_factory=lambda: SelectionSettings(method="multi_metric", percent=80.0, weights=dict(R.BALANCED)))
    trail_policy: str = "exclude_severe"


def annotated(frames: DataFrame, key: str, group: list[str], plan: StackPlan) -> DataFrame:
    """The frames with trail_class, trail_confidence, score and ``excluded``, the reason for which a frame is left out."""
    trails = R.trail_classes(frames, key, group).select(key, "trail_class", F.col("confidence").alias("trail_confidence"))
    scores = R.quality_scores(frames, key, plan.selection.weights or R.BALANCED, group).select(key, "score")
    severe = M.trail_excluded(F.col("trail_class"), F.col("trail_confidence"))
    excluded = F.when(severe, "severe_trailing") if plan.trail_policy == "exclude_severe" else F.lit(None).cast("string")
    # Tables: what follows asks for the frames several times over, and they are few beside their pixels.
    # Joins by frame are merged: tables that are small on disk may have too many frames for the driver to broadcast.
    return stage(frames.join(trails.hint("merge"), key).join(scores.hint("merge"), key).withColumn("excluded", excluded), "annotated")


def selected(frames: DataFrame, key: str, group: list[str], path: str, plan: StackPlan) -> DataFrame:
    """Those of annotated frames that the stack takes, with ``stack_weight``."""
    stay, rule = frames.where("excluded is null"), plan.selection
    if rule.method == "best_percentage":
        stay = R.best_share(stay, group, "quality", rule.percent, path, key)
    elif rule.method == "multi_metric":
        stay = R.ranked_share(stay, key, group, rule.percent, path)
    if plan.stack.combination != "quality_weighted":
        return stay.withColumn("stack_weight", F.lit(1.0))
    # A frame without a score counts like one of the best.
    raw = R.policy_weight(M.score_weight(F.coalesce("score", F.lit(1.0)), F.col("trail_class")), F.col("trail_class"), plan.trail_policy)
    weighed = stay.withColumn("weight", raw)
    return stage(stay.join(R.stack_weights(weighed, key, "weight", group).hint("merge"), key), "selected")


def stacked(pixels: DataFrame, frames: DataFrame, keys: list[str], group: list[str], plan: StackPlan) -> DataFrame:
    """(keys, value, n, n_frames, valid, code, low, high): the reduction of the selected ``frames`` (frame, stack_weight).

    ``valid``: enough of the frames have a sample there; ``code``: the value on 16 bits between the group's least and largest valid ones."""
    rows = pixels.join(frames.select("frame", "stack_weight").hint("merge"), "frame")
    rule = None if plan.stack.rejection == "none" else S.Rejection(plan.stack.rejection, plan.stack.low, plan.stack.high)
    if plan.stack.combination == "quality_weighted":
        values = S.weighted_mean(rows, keys, F.col("stack_weight"), rule).select(*keys, "value")
    elif rule is None:
        values = S.combine(rows, keys, plan.stack.combination).select(*keys, "value")
    else:
        values = S.reject_or_combine(rows, keys, rule, plan.stack.combination).select(*keys, "value")
    sizes = pixels.select(*group, "frame").distinct().join(frames.select("frame").hint("merge"), "frame", "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("n_frames"))
    covered = rows.groupBy(*keys).agg(F.count(S.sample()).alias("n")).join(sizes, group).withColumn("valid", S.enough(F.col("n"), F.col("n_frames")))
    # A table: sums made twice may differ in their last digit, and then the largest value isn't the range's end.
    whole = stage(values.join(covered.hint("merge"), keys), "stacked")
    valid = F.when(F.col("valid"), F.col("value"))
    ranges = whole.groupBy(*group).agg(F.min(valid).alias("low"), F.max(valid).alias("high"))
    coded = F.when(F.col("valid"), S.encode_uint16(F.col("value"), F.col("low"), F.col("high"))).otherwise(0)
    return whole.join(ranges, group).withColumn("code", coded)


def run(pixels: DataFrame, frames: DataFrame, group: list[str], keys: list[str], path: str, plan: StackPlan) -> DataFrame:
    """The plan over ``frames`` (frame, metrics, path and group) and their ``pixels`` (frame, keys, v, ok)."""
    return stacked(pixels, selected(annotated(frames, "frame", group, plan), "frame", group, path, plan), keys, group, plan)


def provenance(frames: DataFrame, group: list[str], plan: StackPlan) -> DataFrame:
    """One row for each group of selected frames: how many there are, the range of their weights, and the settings."""
    return frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("stack_weight").alias("least_weight"), F.max("stack_weight").alias("largest_weight"),
        F.lit(plan.stack.combination).alias("combination"), F.lit(plan.stack.rejection).alias("rejection"), F.lit(plan.selection.method).alias("selection"), F.lit(plan.trail_policy).alias("trail_policy"),
    )
