"""Queries of carry trees and of bundles, over the embeddings as a stack of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.operators import bundles, trees
from tesselith.operators import stacking as S
from tesselith.plans.inputs import pixels, with_views
from tesselith.plans.registry import query

KEYS = ["batch", "pos"]
LEAF = 8
#: Levels that the SQL spells out: 2**10 leaves of eight frames in a batch.
_LEVELS = 10
_WEIGHT = "least(greatest((frame % 9) / 4e0, 0), 2)"
_ENOUGH = "sum(n) >= greatest(1, ceil(0.7e0 * sum(frames)))"

_LEAVES = f"""s AS (SELECT batch, pos, frame, CASE WHEN ok AND NOT isnan(v) THEN v END AS s FROM pixels),
    f AS (SELECT batch, frame, (row_number() OVER w - 1) // {LEAF} AS node, count(*) OVER (PARTITION BY batch) AS total FROM (SELECT DISTINCT batch, frame FROM s) WINDOW w AS (PARTITION BY batch ORDER BY frame)),
    d AS (SELECT s.*, node, least(total - node * {LEAF}, {LEAF}) AS frames, CAST(ceil(total / {LEAF}) AS BIGINT) AS leaves FROM s JOIN f USING (batch, frame)),
    c AS (SELECT batch, pos, node, median(s) AS centre, stddev_pop(s) AS spread, count(s) AS k FROM d GROUP BY ALL),
    x AS (SELECT d.*, k, CASE WHEN k < 4 OR NOT coalesce(spread > 1e-10, false) OR s BETWEEN centre - 2 * spread AND centre + 2 * spread THEN s END AS kept FROM d JOIN c USING (batch, pos, node))"""

#: By method: a leaf's value and weight, and those of two children.
_SQL = {
    "mean": ("coalesce(avg(s), 0)", "0", "coalesce(sum(value * n) / nullif(sum(n), 0), 0)", "0"),
    "median": ("coalesce(CASE WHEN any_value(k) < 4 THEN median(s) ELSE median(kept) END, 0)", "0", "coalesce(median(value) FILTER (valid), 0)", "0"),
    trees.WEIGHTED: (
        f"coalesce(sum({_WEIGHT} * kept) / nullif(sum({_WEIGHT}) FILTER (kept IS NOT NULL), 0), 0)", f"coalesce(sum({_WEIGHT}) FILTER (kept IS NOT NULL), 0)",
        "coalesce(sum(weight * value) FILTER (valid) / nullif(sum(weight) FILTER (valid), 0), 0)", "coalesce(sum(weight) FILTER (valid), 0)",
    ),
}


def _tree_sql(method: str) -> str:
    leaf, leaf_weight, value, weight = _SQL[method]
    merged = f"""CASE WHEN count(*) = 1 THEN any_value(value) ELSE {value} END AS value, CASE WHEN count(*) = 1 THEN any_value(weight) ELSE {weight} END AS weight, sum(n) AS n, sum(frames) AS frames,
        CASE WHEN count(*) = 1 THEN any_value(valid) ELSE {_ENOUGH} END AS valid, any_value(leaves) AS leaves"""
    steps = [f"l0 AS (SELECT batch, pos, node, any_value(frames) AS frames, any_value(leaves) AS leaves, {leaf} AS value, {leaf_weight} AS weight, count(s) AS n, count(s) > 0 AS valid FROM x GROUP BY batch, pos, node)"]
    for k in range(_LEVELS):
        odd = f"(leaves // {2**k} % 2 = 1 AND node = leaves // {2**k} - 1)"
        steps.append(f"a{k} AS (SELECT batch, pos, value, weight, n, frames, valid, leaves FROM l{k} WHERE {odd})")
        steps.append(f"l{k + 1} AS (SELECT batch, pos, node // 2 AS node, {merged} FROM l{k} WHERE NOT {odd} GROUP BY batch, pos, node // 2)")
    steps.append(f"r{_LEVELS} AS (SELECT batch, pos, value, weight, n, frames, valid, leaves FROM l{_LEVELS})")
    for k in reversed(range(_LEVELS)):
        steps.append(f"r{k} AS (SELECT batch, pos, {merged} FROM (FROM r{k + 1} UNION ALL FROM a{k}) GROUP BY batch, pos)")
    end = "n >= greatest(1, ceil(0.7e0 * frames))"
    return with_views(f"WITH {_LEAVES}, {', '.join(steps)} SELECT batch, pos, round(CASE WHEN {end} THEN value ELSE 0 END, 6) AS value, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight, {end} AS valid FROM r0", "pixels")


for _method, _rule in {"mean": None, "median": S.Rejection("sigma", 2.0, 2.0), trees.WEIGHTED: S.Rejection("sigma", 2.0, 2.0)}.items():

    def _tree(spark, sf_dir, method=_method, rule=_rule):
        root = trees.carry_tree(pixels(spark, sf_dir), KEYS, [F.col("frame")], ["batch"], method, rule, (F.col("frame") % 9) / 4.0, LEAF)
        return root.withColumns({"value": F.round("value", 6), "weight": F.round(F.col("weight").cast("double"), 6)})

    query(f"carry_{_method}", _tree_sql(_method))(_tree)


@query(
    "merge_rejected",
    with_views(
        f"""WITH s AS (SELECT frame, batch, pos, CASE WHEN ok THEN v END AS s FROM pixels),
        p AS (SELECT batch, pos, coalesce(sum({_WEIGHT} * s) / nullif(sum(CASE WHEN s IS NOT NULL THEN {_WEIGHT} END), 0), 0) AS v, coalesce(sum(CASE WHEN s IS NOT NULL THEN {_WEIGHT} END), 0) AS w FROM s GROUP BY ALL),
        c AS (SELECT pos, median(v) AS centre, stddev_pop(v) AS spread, count(*) AS n FROM p WHERE w > 0 GROUP BY pos)
        SELECT pos, round(coalesce(sum(w * v) / nullif(sum(w), 0), 0), 6) AS value, round(sum(w), 6) AS weight FROM p JOIN c USING (pos)
        WHERE w > 0 AND (n < 4 OR NOT coalesce(spread > 1e-10, false) OR v BETWEEN centre - 1.2 * spread AND centre + 1.2 * spread) GROUP BY pos""",
        "pixels",
    ),
)
def merge_rejected(spark, sf_dir):
    """Weighted means of batches, merged after rejection of batches that are far off at a position."""
    parts = S.weighted_mean(pixels(spark, sf_dir), KEYS, (F.col("frame") % 9) / 4.0).withColumn("valid", F.col("weight") > 0)
    merged = trees.merge_weighted(parts, ["pos"], S.Rejection("sigma", 1.2, 1.2))
    return merged.withColumns({"value": F.round("value", 6), "weight": F.round("weight", 6)})


def _bundles(spark, sf_dir):
    """Each batch's state with its master, whose codes are a thousand times its mean, and a manifest row by method asked for."""
    stack = pixels(spark, sf_dir)
    weight = 1.0 + F.col("frame") % 3
    state = S.bundle_state(stack, KEYS, weight)
    masks = stack.groupBy(*KEYS).agg(S.enough(F.count(S.sample()), F.count(F.lit(1))).alias("valid"), F.coalesce(F.max(S.sample()) > 0.3, F.lit(False)).alias("saturated"))
    mean = F.coalesce(F.try_divide("sum", "count"), F.lit(0.0))
    return state.withColumn("master", S.clip_uint16(20000 + 1000 * mean)).join(masks, KEYS)


#: Each case: the method asked for, how the batches were made (SQL), and the branch that this leads to.
_CASES = {
    "mean": ("'mean'", "sums", "coalesce(sum(sum), 0) / greatest(sum(count), 1)"),
    "quality_weighted": ("'quality_weighted'", "weights", "coalesce(sum(weighted_sum), 0) / greatest(sum(weight_sum), 1e-12)"),
    "max": ("'max'", "extremes", "coalesce(max(highest) FILTER (valid), max(highest), 0)"),
    "min": ("CASE WHEN batch = 2 THEN 'mean' ELSE 'min' END", "masters_extreme", "min(master)"),
    "median": ("'median'", "masters_median", "median(master)"),
}
_STATES = """s AS (SELECT frame, batch, pos, v, CASE WHEN ok THEN v END AS s FROM pixels),
    st AS (SELECT batch, pos, coalesce(sum(s), 0) AS sum, count(s) AS count, coalesce(sum(s * (1 + frame % 3)), 0) AS weighted_sum, coalesce(sum(CASE WHEN s IS NOT NULL THEN 1e0 + frame % 3 END), 0) AS weight_sum,
        max(s) AS highest, count(s) >= greatest(1, ceil(0.7e0 * count(*))) AS valid, coalesce(max(s) > 0.3, false) AS saturated,
        CAST(trunc(least(greatest(20000 + 1000 * coalesce(avg(s), 0), 0), 65535)) AS INTEGER) AS master FROM s GROUP BY ALL)"""


@query(
    "bundle_choice",
    with_views(
        f"""WITH {_STATES} """
        + " UNION ALL ".join(
            f"SELECT '{method}' AS method, pos, round(CAST({value} AS DOUBLE), 5) AS value, CAST(trunc(least(greatest({value}, 0), 65535)) AS INTEGER) AS code, bool_or(valid) AS valid, bool_or(saturated) AS saturated, '{branch}' AS branch FROM st GROUP BY pos"
            for method, (_, branch, value) in _CASES.items()
        ),
        "pixels",
    ),
)
def bundle_choice(spark, sf_dir):
    """The batches merged for five methods, each by what their manifests allow."""
    states = _bundles(spark, sf_dir)
    sizes = pixels(spark, sf_dir).groupBy("batch").agg(F.count_distinct("frame").alias("n_frames"))
    columns = F.array(*map(F.lit, bundles.STATE))
    out = None
    for method, (made, _, _) in _CASES.items():
        manifests = sizes.select("batch", F.expr(made).alias("method"), F.lit("none").alias("rejection"), F.lit("fits").alias("format"), *(F.lit(n).alias(c) for c, n in (("height", 8), ("width", 8), ("channels", 1))), "n_frames", columns.alias("state_columns"))
        merged = bundles.combine_bundles(manifests, states, ["pos"], method).select(F.lit(method).alias("method"), "pos", F.round("value", 5).alias("value"), "code", "valid", "saturated", "branch")
        out = merged if out is None else out.unionByName(merged)
    return out
