"""Reducing stacks of frames position by position.

A stack is a long table: ``keys`` name a position (and a batch), one row per
frame there, with a value ``v`` and whether the sample is valid, ``ok``. NaN
never counts as a sample; infinite samples do in plain combinations.
All reductions are partial and final aggregates on the keys, so a stack needs
one shuffle; clipping needs its thresholds per position, which a second
aggregate finds on the same partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spreads up to this count as none, and clip nothing.
NO_SPREAD = 1e-10
#: Fewer samples than this many are combined without rejection.
LEAST_FOR_REJECTION = 4
LEAVES = 4
COVERED = 0.7


def sample(v: str = "v", ok: str = "ok") -> Column:
    """The value of a valid sample, else null; Spark's aggregates skip null but not NaN."""
    return F.when(F.col(ok) & ~F.isnan(v), F.col(v))


def combined(method: str, value: Column) -> Column:
    """The aggregate of a plain combination; a position without samples gives 0."""
    found = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median}[method](value)
    return F.coalesce(found, F.lit(0.0))


def combine(stack: DataFrame, keys: list[str], method: str) -> DataFrame:
    return stack.withColumn("s", sample()).groupBy(*keys).agg(combined(method, F.col("s")).alias("value"), F.count("s").alias("n"))


@dataclass(frozen=True)
class Rejection:
    """How outliers are told: ``sigma`` (deviations from the median in standard deviations of the population),
    ``mad`` (in scaled median absolute deviations) or ``winsor`` (values beyond two percentiles are moved there)."""

    kind: str
    low: float = 3.0
    high: float = 3.0

    def percentiles(self) -> tuple[float, float]:
        return min(49.0, 10 * self.low) / 100, max(51.0, 100 - 10 * self.high) / 100


def _usable(spread: Column) -> Column:
    return spread.isNotNull() & ~F.isnan(spread) & (spread != float("inf")) & (spread > NO_SPREAD)


def clipped(stack: DataFrame, keys: list[str], rule: Rejection) -> DataFrame:
    """The rows with a sample, and ``kept``: the sample after rejection, else null; ``n``: samples at the position.

    Statistics of a position are aggregates joined back on the keys; the join reuses the aggregate's
    partitioning, and unlike a window it holds no position's rows in memory."""
    rows = stack.withColumn("s", sample()).where("s is not null")
    if rule.kind == "winsor":
        low, high = rule.percentiles()
        stats = rows.groupBy(*keys).agg(F.percentile("s", F.array(F.lit(low), F.lit(high))).alias("p"), F.count("s").alias("n"))
        joined = rows.join(stats, keys)
        moved = F.least(F.greatest("s", F.col("p")[0]), F.col("p")[1])
        return joined.withColumn("kept", F.when(F.col("n") < LEAST_FOR_REJECTION, F.col("s")).otherwise(moved)).drop("p")
    centres = rows.groupBy(*keys).agg(F.median("s").alias("centre"), F.stddev_pop("s").alias("spread"), F.count("s").alias("n"))
    joined = rows.join(centres, keys)
    if rule.kind == "mad":
        mads = joined.groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col("s") - F.col("centre")))).alias("spread"))
        joined = joined.drop("spread").join(mads, keys)
    inside = F.col("s").between(F.col("centre") - rule.low * F.col("spread"), F.col("centre") + rule.high * F.col("spread"))
    keep = (F.col("n") < LEAST_FOR_REJECTION) | ~_usable(F.col("spread")) | inside
    return joined.withColumn("kept", F.when(keep, F.col("s"))).drop("centre", "spread")


def reject(stack: DataFrame, keys: list[str], rule: Rejection) -> DataFrame:
    """The median of what rejection leaves. With rejection the combination method has no say."""
    return clipped(stack, keys, rule).groupBy(*keys).agg(F.median("kept").alias("value"), F.count("kept").alias("n"))


def reject_or_combine(stack: DataFrame, keys: list[str], rule: Rejection, method: str) -> DataFrame:
    """Rejection where a position has enough samples, the plain combination where it hasn't."""
    rows = clipped(stack, keys, rule)
    return rows.groupBy(*keys).agg(F.when(F.first("n") < LEAST_FOR_REJECTION, combined(method, F.col("s"))).otherwise(F.median("kept")).alias("value"), F.first("n").alias("n"))


def weighted_mean(stack: DataFrame, keys: list[str], weight: Column, rule: Rejection | None = None) -> DataFrame:
    """The mean by weight, after rejection that doesn't regard weights; 0 where nothing is left."""
    rows = stack.withColumn("w", F.least(F.greatest(weight, F.lit(0.0)), F.lit(2.0)))
    rows = rows.withColumn("kept", sample()) if rule is None else clipped(rows, keys, rule)
    w = F.when(F.col("kept").isNotNull(), F.col("w"))
    return rows.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(w * F.col("kept")), F.nullif(F.sum(w), F.lit(0.0))), F.lit(0.0)).alias("value"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"))


def leaves(stack: DataFrame, keys: list[str], order: list[Column], count: int = LEAVES, frame: str = "frame", group: list[str] | None = None) -> DataFrame:
    """``leaf`` for each row: frames in their order are dealt out in turn. The order is that of the frames
    alone, which are few beside their samples."""
    group = group or []
    frames = stack.select(*group, frame).distinct().withColumn("leaf", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) % count)
    return stack.join(frames, [*group, frame])


def leaf_medians(stack: DataFrame, keys: list[str], order: list[Column], group: list[str]) -> DataFrame:
    dealt = leaves(stack, keys, order, group=group).withColumn("s", sample())
    return dealt.groupBy(*keys, "leaf").agg(F.median("s").alias("value"), F.count("s").alias("n"))


def enough(n: Column, frames: Column) -> Column:
    """Whether so many valid samples are COVERED of so many frames, and one at least."""
    return n >= F.greatest(F.lit(1), F.ceil(frames * COVERED))


def tree_median(stack: DataFrame, keys: list[str], order: list[Column], group: list[str]) -> DataFrame:
    """Medians of the leaves, then of neighbouring pairs, then of the two halves, each level one aggregate: value, n, valid.

    Where a node has samples of too few of its frames, its value is not used further up; its samples count all the same."""
    dealt = leaves(stack, keys, order, group=group).withColumn("s", sample()).withColumnRenamed("leaf", "node")
    sizes = dealt.select(*group, "node", "frame").distinct().groupBy(*group, "node").agg(F.count(F.lit(1)).alias("frames"))
    level = dealt.groupBy(*keys, "node").agg(F.median("s").alias("value"), F.count("s").alias("n"))
    for _ in range(2):
        used = level.join(sizes, [*group, "node"]).withColumn("value", F.when(enough(F.col("n"), F.col("frames")), F.col("value")))
        half = F.floor(F.col("node") / 2).alias("node")
        level = used.select(*keys, half, "value", "n").groupBy(*keys, "node").agg(F.median("value").alias("value"), F.sum("n").alias("n"))
        sizes = sizes.select(*group, half, "frames").groupBy(*group, "node").agg(F.sum("frames").alias("frames"))
    whole = level.join(sizes, [*group, "node"])
    return whole.select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"), "n", enough(F.col("n"), F.col("frames")).alias("valid"))


def coverage(stack: DataFrame, keys: list[str], frames: DataFrame, group: list[str]) -> DataFrame:
    """Valid samples at each position, and whether they are enough of the group's frames. ``frames``: group and n_frames."""
    per = stack.groupBy(*keys).agg(F.count_if(F.col("ok") & ~F.isnan("v")).alias("n"))
    return per.join(frames, group).withColumn("valid", enough(F.col("n"), F.col("n_frames"))).drop("n_frames")


def bundle_state(stack: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """The mergeable state of a batch's stack."""
    s, w = F.col("s"), F.col("w")
    rows = stack.withColumn("s", sample()).withColumn("w", F.when(F.col("s").isNotNull(), weight))
    zero = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(s), zero).alias("sum"), F.count(s).alias("count"), F.coalesce(F.sum(s * w), zero).alias("weighted_sum"), F.coalesce(F.sum(w), zero).alias("weight_sum"), F.max(s).alias("highest"), F.min(s).alias("lowest")
    )


def merge_bundles(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of batches to one result; sums of sums, so the order of merging doesn't matter."""
    return states.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum("sum"), F.sum("count")), F.lit(0.0)).alias("mean"),
        F.sum("sum").alias("sum"),
        F.coalesce(F.try_divide(F.sum("weighted_sum"), F.nullif(F.sum("weight_sum"), F.lit(0.0))), F.lit(0.0)).alias("weighted_mean"),
        F.max("highest").alias("highest"),
        F.min("lowest").alias("lowest"),
        F.sum("count").alias("n"),
    )


def normalisation(stack: DataFrame, frame: str, reference: Column) -> DataFrame:
    """(frame, factor): the reference frame's median over the frame's, 1 where either isn't a positive number."""
    medians = stack.withColumn("s", sample()).groupBy(frame).agg(F.median("s").alias("m"))
    ref = medians.where(reference).agg(F.max("m").alias("ref"))
    usable = (F.col("m") > 0) & (F.col("ref") > 0) & (F.col("m") != float("inf")) & (F.col("ref") != float("inf"))
    return medians.crossJoin(F.broadcast(ref)).select(frame, F.when(usable, F.col("ref") / F.col("m")).otherwise(1.0).alias("factor"))  # ref: one row


def mode(stack: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """The middle of the fullest of ``bins`` equal bins between the 5th and 95th percentile (the first of equals), or the median where these are equal."""
    rows = stack.withColumn("s", sample()).where("s is not null")
    edges = rows.groupBy(*keys).agg(F.percentile("s", F.array(F.lit(0.05), F.lit(0.95))).alias("p"), F.median("s").alias("m"))
    edges = edges.select(*keys, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "m")
    inside = rows.join(edges, keys).where(F.col("s").between(F.col("low"), F.col("high")) & (F.col("high") > F.col("low")))
    bin_ = F.least(F.floor((F.col("s") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    counts = inside.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    fullest = counts.groupBy(*keys).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("bin"))
    middle = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    return edges.join(fullest, keys, "left").select(*keys, F.coalesce(middle, "m").alias("mode"))


def strided(stack: DataFrame, step: int) -> DataFrame:
    return stack.where((F.pmod("y", F.lit(step)) == 0) & (F.pmod("x", F.lit(step)) == 0))


def clipped_stats(stack: DataFrame, keys: list[str], rounds: int = 5, sigma: float = 3.0) -> DataFrame:
    """Mean, median and population deviation of the samples, each round without those far from the last round's median.

    A fixed number of rounds, each an aggregate and a join on the same keys."""
    rows = stack.withColumn("s", sample()).where("s is not null").select(*keys, "s")
    for _ in range(rounds):
        stats = rows.groupBy(*keys).agg(F.median("s").alias("c"), F.stddev_pop("s").alias("d"))
        rows = rows.join(stats, keys).where((F.abs(F.col("s") - F.col("c")) <= sigma * F.col("d")) | ~_usable(F.col("d"))).select(*keys, "s")
    return rows.groupBy(*keys).agg(F.avg("s").alias("mean"), F.median("s").alias("median"), F.stddev_pop("s").alias("deviation"), F.count("s").alias("n"))


def calibrate(light: Column, dark: Column, flat: Column) -> Column:
    """Light less dark, divided by the flat where that is a number over 0.01."""
    usable = flat.isNotNull() & ~F.isnan(flat) & (F.abs(flat) != float("inf")) & (flat > 0.01)
    return F.when(usable, (light - dark) / flat).otherwise(light - dark)


def encode_uint16(value: Column, low: Column, high: Column) -> Column:
    """0 to 65535 between low and high, cut off, not rounded; 0 where there is no range."""
    scaled = F.least(F.greatest((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 65535
    return F.when(high > low, scaled.cast("int")).otherwise(0)


def clip_uint16(value: Column) -> Column:
    """Values on the scale of the codes already: cut off below 0 and above 65535, not rounded; 0 for what is no number."""
    number = F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(65535.0)).cast("int")


def decode_uint16(code: Column, low: Column, high: Column) -> Column:
    return low + code / 65535.0 * (high - low)


def hdr_exposure(exptime: Column, exposure: Column, override: Column | None = None) -> Column:
    """(seconds, problem) of a frame by its two names of the exposure time, which must agree to a millionth of it."""
    conflict = exptime.isNotNull() & exposure.isNotNull() & (F.abs(exptime - exposure) > 1e-6 * F.abs(exposure))
    seconds = F.coalesce(exptime, exposure) if override is None else F.coalesce(override, exptime, exposure)
    conflict = conflict if override is None else conflict & override.isNull()
    bad = seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")) | (seconds <= 0)
    return F.struct(seconds.alias("seconds"), F.when(conflict, "conflicting EXPTIME and EXPOSURE").when(bad, "EXPTIME missing or invalid").alias("problem"))


def hdr_fuse(rows: DataFrame, keys: list[str], noise: float, k: float) -> DataFrame:
    """Radiances of exposures fused by inverse variance, and where they disagree.

    ``rows``: keys, v (as stored), exposure, ok, saturation (null: unknown), is_rate (stored per second already),
    low and high (of the range that v is normalised to, or null). A sample's radiance is its value over the exposure; its noise
    falls with the exposure. Saturation is told from values as they are stored."""
    saturated = F.coalesce(F.col("v") >= F.col("saturation"), F.lit(False))
    value = F.when(F.col("low").isNotNull(), F.col("low") + F.col("v") * (F.col("high") - F.col("low"))).otherwise(F.col("v"))
    divisor = F.when(F.col("is_rate"), 1.0).otherwise(F.col("exposure"))
    radiance = value / divisor
    ok = F.col("ok") & ~saturated & radiance.isNotNull() & ~F.isnan(radiance) & (F.abs(radiance) != float("inf"))
    r = F.when(ok, radiance)
    w = F.when(ok, F.pow(divisor / noise, 2))
    grouped = rows.withColumns({"r": r, "w": w, "divisor": F.when(ok, divisor)}).groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("r")).alias("wr"), F.sum("w").alias("ws"), F.count("r").alias("n"), F.avg("r").alias("m"), F.avg(F.col("r") * F.col("r")).alias("m2"), F.min("divisor").alias("shortest")
    )
    spread = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))
    return grouped.select(
        *keys,
        F.coalesce(F.try_divide("wr", F.nullif(F.col("ws"), F.lit(0.0))), F.lit(0.0)).alias("radiance"),
        (F.coalesce("ws", F.lit(0.0)) > 0).alias("valid"),
        F.coalesce((F.col("n") >= 2) & (spread > k * noise / F.col("shortest")), F.lit(False)).alias("disagree"),
    )


def difference_scores(stack: DataFrame, position: list[str], group: list[str], order: str) -> DataFrame:
    """The population deviation of each frame's change from the one before it in its group. ``order``: a column of consecutive numbers."""
    before = stack.select(*group, *position, (F.col(order) + 1).alias(order), F.col("v").alias("before"))
    both = stack.join(before, [*group, *position, order])
    change = F.col("v") - F.col("before")
    fine = F.when(~F.isnan(change) & (F.abs(change) != float("inf")), change)
    return both.groupBy(*group, order).agg(F.stddev_pop(fine).alias("score"))


def shifted(stack: DataFrame, dy: Column, dx: Column, height: int, width: int) -> DataFrame:
    """Whole-pixel shifts, halves to the even number; what leaves the frame is gone."""
    moved = stack.withColumn("y", (F.col("y") + F.rint(dy)).cast("bigint")).withColumn("x", (F.col("x") + F.rint(dx)).cast("bigint"))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def centre_crop(stack: DataFrame, height: int, width: int, crop_height: int, crop_width: int) -> DataFrame:
    top, left = (height - crop_height) // 2, (width - crop_width) // 2
    inside = stack.where(F.col("y").between(top, top + crop_height - 1) & F.col("x").between(left, left + crop_width - 1))
    return inside.withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)
