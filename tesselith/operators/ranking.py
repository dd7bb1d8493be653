"""Ranks, scores and selections of frames by several metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.functions import metrics as M

#: Whether less is better.
LOWER_IS_BETTER = {"fwhm": True, "rms": True, "elongation": True, "snr": False, "roundness": False, "star_count": False, "coverage": False}
ELIGIBLE = 0.60
#: The usual weights of a frame's metrics.
BALANCED = {"fwhm": 0.25, "roundness": 0.20, "star_count": 0.20, "snr": 0.15, "rms": 0.10, "coverage": 0.10}


def percentile_ranks(frames: DataFrame, key: str, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """(group, key, metric, rank): ranks from 0 to 1, ties sharing the mean of their places; null metrics have none.

    A place among all rows of a group needs no window over them: it follows from the counts of distinct values,
    which are far fewer; they are summed per value in each task first."""
    group = group or []
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    long = frames.select(*group, key, pairs.alias("p")).select(*group, key, "p.metric", "p.value").where("value is not null and not isnan(value)")
    counts = long.groupBy(*group, "metric", "value").agg(F.count(F.lit(1)).alias("ties"))
    of_metric = Window.partitionBy(*group, "metric")
    below = F.coalesce(F.sum("ties").over(of_metric.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*group, "metric", "value", (below + (F.col("ties") - 1) / 2).alias("place"), F.sum("ties").over(of_metric).alias("n"))
    share = F.col("place") / F.greatest(F.col("n") - 1, F.lit(1))
    lower = F.create_map(*(x for m in metrics for x in (F.lit(m), F.lit(LOWER_IS_BETTER.get(m, False)))))
    ranked = places.withColumn("rank", F.when(F.element_at(lower, F.col("metric")), 1 - share).otherwise(share)).drop("place", "n")
    # Merged, as are joins by frame: by the size on disk that Spark goes by, the driver would be given tables to broadcast that don't fit it.
    return long.join(ranked.hint("merge"), [*group, "metric", "value"]).drop("value")


def quality_scores(frames: DataFrame, key: str, weights: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """One row per frame: score (the mean of its ranks by weight; null unless eligible), available (the weight of what it
    has), eligible (enough of the whole weight), components and missing."""
    group = group or []
    ranks = percentile_ranks(frames, key, list(weights), group)
    weight = F.element_at(F.create_map(*(x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w))))), F.col("metric"))
    scored = ranks.withColumn("w", weight).groupBy(key).agg(
        F.try_divide(F.sum(F.col("w") * F.col("rank")), F.sum("w")).alias("score"),
        F.sum("w").alias("available"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "rank")))).alias("components"),
    )
    total = float(sum(weights.values()))
    names = F.array(*(F.lit(m) for m in sorted(weights)))
    empty = F.create_map().cast("map<string,double>")
    joined = frames.select(*group, key).join(scored.hint("merge"), key, "left")
    available = F.coalesce("available", F.lit(0.0))
    eligible = (available > 0) & (available / total >= ELIGIBLE - 1e-9)
    return joined.select(
        *group,
        key,
        F.when(eligible, F.col("score")).alias("score"),
        available.alias("available"),
        eligible.alias("eligible"),
        F.coalesce("components", empty).alias("components"),
        F.array_except(names, F.map_keys(F.coalesce("components", empty))).alias("missing"),
    )


def robust(frames: DataFrame, metrics: list[str], group: list[str]) -> DataFrame:
    """Medians and scaled median absolute deviations: for each metric m, m_median and m_sigma."""
    medians = frames.groupBy(*group).agg(*(F.median(m).alias(f"{m}_median") for m in metrics))
    joined = frames.join(medians, group) if group else frames.crossJoin(F.broadcast(medians))  # without groups: one row
    return joined.groupBy(*group).agg(*(F.first(f"{m}_median").alias(f"{m}_median") for m in metrics), *((1.4826 * F.median(F.abs(F.col(m) - F.col(f"{m}_median")))).alias(f"{m}_sigma") for m in metrics))


def trail_classes(frames: DataFrame, key: str, group: list[str], least_stars: float = 8) -> DataFrame:
    """(key, trail_class, cause, confidence, penalty) by thresholds relative to the group."""
    base = robust(frames, ["roundness", "trail_excess"], group)
    rows = frames.join(base, group, "left")
    c = F.col
    found = M.trail_assessment(
        c("star_count"), c("roundness"), c("elongation"), c("trail_excess"), c("coherence"), c("tangential"),
        {"roundness": c("roundness_median"), "excess": c("trail_excess_median")}, {"roundness": c("roundness_sigma"), "excess": c("trail_excess_sigma")}, least_stars,
    )
    return rows.select(key, found.alias("t")).select(key, "t.*")


def quality_summaries(frames: DataFrame, group: list[str], metrics: dict[str, str], timed: Column, accepted: Column, sigma: float = 3.0) -> DataFrame:
    """Counts and medians of each group, and whether it should be reviewed: its median quality or roundness is more
    than ``sigma`` robust deviations below that of all timed frames; no deviation suggests nothing.

    ``metrics``: the columns whose medians are wanted, quality, roundness and rotation among them, by their names in the result."""
    rows = frames.withColumn("_timed", timed)
    base = robust(rows.where("_timed"), ["quality", "roundness"], [])
    groups = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frame_count"), F.count_if("_timed").alias("timed_frame_count"), F.count_if(accepted).alias("accepted_frame_count"), *(F.median(c).alias(f"median_{n}") for c, n in metrics.items()), F.max(F.abs("rotation")).alias("max_abs_rotation_deg")
    )
    below = lambda name: F.coalesce((F.col(f"{name}_sigma") > 0) & (F.col(f"median_{metrics[name]}") < F.col(f"{name}_median") - sigma * F.col(f"{name}_sigma")), F.lit(False))
    reason = F.when(below("quality"), "quality_below_robust_session_baseline").when(below("roundness"), "roundness_below_robust_session_baseline")
    return groups.crossJoin(F.broadcast(base)).select(  # base: one row
        *groups.columns,
        F.when(F.col("roundness_sigma") > 0, F.col("roundness_median") - sigma * F.col("roundness_sigma")).alias("roundness_threshold"),
        below("roundness").alias("roundness_review_suggested"),
        reason.isNotNull().alias("review_suggested"),
        reason.alias("review_reason"),
    )


def fixed_model(fits: DataFrame, group: list[str], cells: list[str], confidence: str, most_spread: float = 0.35, least_confidence: float = 0.15, least_fits: int = 3) -> DataFrame:
    """(group, cell, centre, mad, n, confidence): the median matrix of each group's fits, where one fixed model will do.

    It won't where any cell's median absolute deviation is over ``most_spread``, the fits' median confidence is too
    low, or there are too few of them."""
    long = fits.select(*group, F.col(confidence).alias("_sure"), F.posexplode(F.array(*cells)).alias("cell", "v"))
    centres = long.groupBy(*group, "cell").agg(F.median("v").alias("centre"), F.count(F.lit(1)).alias("n"), F.median("_sure").alias("confidence"))
    spread = long.join(centres, [*group, "cell"]).groupBy(*group, "cell").agg(F.first("centre").alias("centre"), F.median(F.abs(F.col("v") - F.col("centre"))).alias("mad"), F.first("n").alias("n"), F.first("confidence").alias("confidence"))
    good = spread.groupBy(*group).agg(F.max("mad").alias("most"), F.max("confidence").alias("sure"), F.max("n").alias("fits"))
    good = good.where((F.col("most") <= most_spread) & (F.col("sure") >= least_confidence) & (F.col("fits") >= least_fits))
    return spread.join(good.select(*group), group, "left_semi")


def policy_weight(weight: Column, trail_class: Column, policy: str) -> Column:
    """A severe trail's weight is 0, unless the policy lets it count a little (``weight_only``) or more (``off``, ``report``)."""
    least = {"weight_only": 0.05, "off": 0.25, "report": 0.25}.get(policy)
    return weight if least is None else F.when(trail_class == "severe", F.greatest(weight, F.lit(least))).otherwise(weight)


def stack_weights(frames: DataFrame, key: str, weight: str, group: list[str]) -> DataFrame:
    """Weights over the median of the positive ones of the group, between 0.25 and 2."""
    positive = F.when((F.col(weight) > 0) & (F.col(weight) != float("inf")), F.col(weight))
    middle = frames.groupBy(*group).agg(F.median(positive).alias("middle"))
    ratio = F.coalesce(F.try_divide(positive, F.col("middle")), F.lit(0.25))
    return frames.join(middle, group).select(key, F.least(F.greatest(ratio, F.lit(0.25)), F.lit(2.0)).alias("stack_weight"))


#: Whether a metric's value can be selected by; any other one must be a positive number.
SELECTABLE = {"roundness": lambda v: (v > 0) & (v <= 1)}


def share_of(n: Column, percent: float) -> Column:
    """How many of ``n`` so many percent are: at least three, as far as there are."""
    return F.greatest(F.least(F.lit(3), n), F.floor(n * min(100.0, max(1.0, percent)) / 100.0))


def best_share(frames: DataFrame, group: list[str], metric: str, percent: float, path: str, *ties: str) -> DataFrame:
    """The best so many percent of each group by a metric; ties in order of path, then of further columns.

    Where no frame of a group has a value of use, all are candidates in order of path, but by roundness none is."""
    value = M.finite(F.col(metric))
    usable = F.coalesce(SELECTABLE.get(metric, lambda v: v > 0)(value), F.lit(False))
    rows = frames.withColumn("_value", F.when(usable, value))
    counts = rows.groupBy(*group).agg(F.count("_value").alias("_valid"), F.count(F.lit(1)).alias("_all"))
    rows = rows.join(counts, group)
    if metric == "roundness":
        rows, n = rows.where("_value is not null"), F.col("_valid")
    else:
        rows, n = rows.where("_value is not null or _valid = 0"), F.when(F.col("_valid") > 0, F.col("_valid")).otherwise(F.col("_all"))
    order = F.col("_value").asc() if LOWER_IS_BETTER.get(metric, False) else F.col("_value").desc()
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order, F.lower(path), path, *ties))
    return rows.withColumn("_place", place).where(F.col("_place") <= share_of(n, percent)).drop("_place", "_value", "_valid", "_all")


def ranked_share(frames: DataFrame, key: str, group: list[str], percent: float, path: str) -> DataFrame:
    """The best so many percent of each group by ``score``, with ``place`` and ``fallback``; ties in order of path.

    Only frames with a score are candidates, or all in order of path where a group has none."""
    counts = frames.groupBy(*group).agg(F.count("score").alias("_eligible"), F.count(F.lit(1)).alias("_all"))
    rows = frames.join(counts, group).where("score is not null or _eligible = 0")
    n = F.when(F.col("_eligible") > 0, F.col("_eligible")).otherwise(F.col("_all"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.round("score", 9).desc(), F.lower(path), path, key)).cast("bigint")
    return rows.withColumn("place", place).where(F.col("place") <= share_of(n, percent)).withColumn("fallback", F.col("_eligible") == 0).drop("_eligible", "_all")


def best_scores(frames: DataFrame, key: str, weights: dict[str, float], group: list[str], percent: float, path: str) -> DataFrame:
    """``ranked_share`` of the frames by their scores from these weights."""
    return ranked_share(frames.join(quality_scores(frames, key, weights, group).select(key, "score"), key), key, group, percent, path)


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int = 1, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only those of each task before the shuffle."""
    name = place or "_place"
    kept = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(name) <= n)
    return kept if place else kept.drop(name)


def nearest_in_order(rows: DataFrame, group: list[str], key: str, order: str, k: int) -> DataFrame:
    """(group, key, candidate, place): the ``k`` rows nearest to each in its group's order, the earlier of equals first.

    They are among the ``k`` before it and the ``k`` after it, whatever lies between."""
    of_group = Window.partitionBy(*group).orderBy(order)
    other = F.struct(F.col(order).alias("order"), F.col(key).alias("key"))
    near = rows.select(*group, key, order, F.array_compact(F.array(*(f(other, i).over(of_group) for f in (F.lag, F.lead) for i in range(1, k + 1)))).alias("near"))
    ranked = F.transform("near", lambda o: F.struct(F.abs(o["order"] - F.col(order)).alias("d"), o["order"].alias("order"), o["key"].alias("key")))
    best = near.select(*group, key, F.posexplode(F.slice(F.array_sort(ranked), 1, k)).alias("place", "o"))
    return best.select(*group, key, F.col("o.key").alias("candidate"), (F.col("place") + 1).cast("bigint").alias("place"))


def even_sample(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` rows of each group spread evenly over its order, both ends included."""
    of_group = Window.partitionBy(*group)
    placed = rows.withColumn("place", F.row_number().over(of_group.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(of_group))
    # place is wanted if it is the whole part of i (n - 1) / (k - 1) for some i
    i = F.ceil(F.col("place") * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return placed.where((F.col("n") <= k) | (F.floor(i * (F.col("n") - 1) / (k - 1)) == F.col("place"))).drop("n", "place")
