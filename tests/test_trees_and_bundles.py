"""Carry trees against a plain tree of nodes, and the choice between states and masters."""

from __future__ import annotations

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.operators import bundles, stacking, trees

SIZE = 5
FRAMES = [1, 3, 5, 6, 10, 11, 15, 20, 23, 31, 35, 50, 64, 77, 155, 250, 496, 500]


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(4)
    rows = []
    for g, count in enumerate(FRAMES):
        for pos in range(2):
            for k in range(count):
                v = float(r.normal(10 + pos, 1)) + (50.0 if r.random() < 0.05 else 0.0)
                rows.append((g, pos, k, math.nan if r.random() < 0.02 else v, bool(r.random() < 0.8 - 0.15 * pos)))
    return spark.createDataFrame(rows, "g int, pos int, frame int, v double, ok boolean").repartition(4), rows


def rejected(values, rule):
    if rule is None or len(values) < 4:
        return values
    centre, spread = statistics.median(values), float(np.std(values))
    return values if not spread > 1e-10 else [v for v in values if centre - rule.low * spread <= v <= centre + rule.high * spread]


def plain(samples, method, rule):
    """The root (value, n, valid) of one position's frames (v or None), by a counter of nodes."""
    combine = {"mean": lambda v: sum(v) / len(v), "sum": sum, "max": max, "min": min, "median": statistics.median}

    def leaf(part, at):
        own = [(v, (at + k) % 9 / 4) for k, v in enumerate(part) if v is not None]
        values = [v for v, _ in own]
        kept = rejected(values, rule)
        if method == trees.WEIGHTED:
            w = sum(min(x, 2.0) for v, x in own if v in kept)
            return (sum(v * min(x, 2.0) for v, x in own if v in kept) / w if w else 0.0, len(values), w, len(part), bool(values))
        if rule and len(values) >= 4:
            value = statistics.median(kept)
        else:
            value = combine[method](values) if values else 0.0
        return value, len(values), 0.0, len(part), bool(values)

    def merge(a, b):
        n, frames = a[1] + b[1], a[3] + b[3]
        seen, w = [x[0] for x in (a, b) if x[4]], 0.0
        if method == trees.WEIGHTED:
            w = sum(x[2] for x in (a, b) if x[4])
            value = sum(x[0] * x[2] for x in (a, b) if x[4]) / w if w else 0.0
        elif method == "mean" and rule is None:
            value = (a[0] * a[1] + b[0] * b[1]) / n if n else 0.0
        else:
            value = combine[method](seen) if seen else 0.0
        return value, n, w, frames, n >= max(1, math.ceil(0.7 * frames))

    levels = []
    for at in range(0, len(samples), SIZE):
        carry, level = leaf(samples[at : at + SIZE], at), 0
        while level < len(levels) and levels[level] is not None:
            carry, levels[level], level = merge(levels[level], carry), None, level + 1
        levels[level : level + 1] = [carry]
    root = None
    for node in reversed(levels):
        root = node if root is None else merge(root, node) if node else root
    valid = root[1] >= max(1, math.ceil(0.7 * root[3]))
    return (root[0] if valid else 0.0, root[1], valid)


@pytest.mark.parametrize("rule", [None, stacking.Rejection("sigma", 1.5, 1.5)])
@pytest.mark.parametrize("method", ["mean", "median", "max", "sum", trees.WEIGHTED])
def test_carry_trees_equal_a_plain_tree_for_any_number_of_leaves(made, method, rule):
    stack, rows = made
    weight = (F.col("frame") % 9) / 4
    got = {(r.g, r.pos): (r.value, r.n, r.valid) for r in trees.carry_tree(stack, ["g", "pos"], [F.col("frame")], ["g"], method, rule, weight, SIZE).collect()}
    for g in range(len(FRAMES)):
        for pos in range(2):
            samples = [v if ok and not math.isnan(v) else None for gg, p, _, v, ok in rows if (gg, p) == (g, pos)]
            value, n, valid = plain(samples, method, rule)
            assert got[g, pos][1:] == (n, valid)
            assert got[g, pos][0] == pytest.approx(value, abs=1e-9)


def test_no_frames(spark):
    empty = spark.createDataFrame([], "g int, pos int, frame int, v double, ok boolean")
    assert trees.carry_tree(empty, ["g", "pos"], [F.col("frame")], ["g"], "mean").collect() == []


def test_an_odd_node_is_rejected_in_a_weighted_merge(spark):
    nodes = spark.createDataFrame([(0, 10.0 + k, 2.0, True) for k in range(6)] + [(0, 500.0, 9.0, True), (0, 1.0, 9.0, False), (1, 4.0, 1.0, True), (1, 90.0, 1.0, True)], "pos int, value double, weight double, valid boolean")
    got = {r.pos: (r.value, r.weight) for r in trees.merge_weighted(nodes, ["pos"], stacking.Rejection("sigma", 2.0, 2.0)).collect()}
    assert got == {0: (12.5, 12.0), 1: (47.0, 2.0)}
    assert {r.pos: r.weight for r in trees.merge_weighted(nodes, ["pos"], None).collect()} == {0: 21.0, 1: 2.0}


MANIFEST = "batch int, method string, rejection string, format string, height int, width int, channels int, n_frames bigint, state_columns array<string>"


def manifests(spark, *methods, rejection=None, columns=bundles.STATE, **other):
    row = {"format": "FITS", "height": 2, "width": 2, "channels": 1} | other
    return spark.createDataFrame([(i, m, rejection, row["format"], row["height"], row["width"], row["channels"], 10 + i, list(columns)) for i, m in enumerate(methods)], MANIFEST)


def states(spark):
    return spark.createDataFrame(
        [(0, 0, 30.0, 3, 60.0, 6.0, 15.0, 5.0, 10, True, False), (1, 0, 80.0, 2, 20.0, 0.5, 70.0, 1.0, 40, False, True), (2, 0, 5.0, 1, 5.0, 1.0, 5.0, 5.0, 5, True, False), (0, 1, 0.0, 0, 0.0, 0.0, None, None, 0, False, False), (9, 0, 1e6, 1, 1e6, 1.0, 1e6, 1e6, 1, True, True)],
        "batch int, pos int, sum double, count bigint, weighted_sum double, weight_sum double, highest double, lowest double, master int, valid boolean, saturated boolean",
    )


@pytest.mark.parametrize(
    ("method", "methods", "rejection", "branch", "value", "hierarchical", "warned"),
    [
        ("mean", ["mean"] * 3, "none", "sums", 115 / 6, False, False),
        ("sum", ["sum"] * 3, "none", "sums", 115.0, False, False),
        ("quality_weighted", ["quality_weighted"] * 3, "none", "weights", 85 / 7.5, False, False),
        ("max", ["max"] * 3, "none", "extremes", 15.0, False, False),
        ("min", ["min"] * 3, "none", "extremes", 5.0, False, False),
        ("max", ["max", "mean", "max"], "none", "masters_extreme", 40.0, True, True),
        ("min", ["mean"] * 3, "none", "masters_extreme", 5.0, True, True),
        ("median", ["median"] * 3, "none", "masters_median", 10.0, True, True),
        ("mean", ["mean"] * 3, "sigma", "masters_median", 10.0, True, True),
        ("mean", ["mean", None, "mean"], "none", "masters_median", 10.0, True, True),
    ],
)
def test_branches(spark, method, methods, rejection, branch, value, hierarchical, warned):
    plan = bundles.plan_merge(manifests(spark, *methods), method, rejection)
    assert (plan.branch, plan.hierarchical, plan.warning is not None, plan.n_batches, plan.n_frames) == (branch, hierarchical, warned, 3, 33)
    got = {r.pos: r for r in bundles.combine_bundles(manifests(spark, *methods), states(spark), ["pos"], method, rejection).collect()}
    assert got[0].value == pytest.approx(value) and got[0].valid and got[0].saturated and got[0].code == int(value)
    assert not got[1].valid and got[1].value == 0.0 and {r.branch for r in got.values()} == {branch}


def test_a_batch_made_with_rejection_or_without_its_state_goes_by_masters(spark):
    assert bundles.plan_merge(manifests(spark, "mean", "mean", rejection="mad"), "mean").branch == "masters_median"
    assert bundles.plan_merge(manifests(spark, "mean", "mean", columns=["sum"]), "mean").branch == "masters_median"


def test_bundles_that_do_not_fit(spark):
    both = manifests(spark, "mean").unionByName(manifests(spark, "mean", format="tiff"))
    sizes = manifests(spark, "mean").unionByName(manifests(spark, "mean", width=3))
    for rows in (both, sizes, manifests(spark, "mean").where("false")):
        with pytest.raises(bundles.Incompatible):
            bundles.plan_merge(rows, "mean")
