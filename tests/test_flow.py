"""Registration of frames: edges and batches against the true motions, changed references, thresholds, odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.functions import geometry, text
from tesselith.functions.geometry import GLOBAL_LIMITS
from tesselith.operators import edges, flow, kernels
from tesselith.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.01"


def motion(frame):
    """Where the view ``sky`` puts a star in a frame, as a 3 x 3 matrix."""
    turn = (frame % 9) / 1000
    return np.array([[math.cos(turn), -math.sin(turn), frame % 12 * 15.0], [math.sin(turn), math.cos(turn), frame % 5 * -20.0], [0, 0, 1]])


def matrix(row):
    return np.array([[row.a, row.b, row.tx], [row.c, row.d, row.ty], [0, 0, 1]])


def test_edges_find_the_motion(spark):
    found = QUERIES["edge_attempts"](spark, SF).collect()
    frames = spark.read.parquet(f"{SF}/part.parquet").select(F.floor(F.col("p_partkey") / 100)).distinct().count()
    assert sorted(r.edge for r in found) == sorted({2 * f + g - 1 for g in (1, 2) for f in range(g, frames)})
    taken = [r for r in found if r.status == "accepted"]
    assert len(taken) > 0.8 * len(found)
    for r in taken:
        target, gap = r.edge // 2, r.edge % 2 + 1
        assert np.allclose(matrix(r), motion(target - gap) @ np.linalg.inv(motion(target)), atol=1e-6)
        assert r.attempt in (("normal", "relaxed_radius") if gap == 1 else ("anchor" if target == 2 else "neighbor",))
    assert all(r.a is None and r.tx is None for r in found if r.status != "accepted")


def test_batches_find_the_master(spark):
    found = QUERIES["global_pairs"](spark, SF).collect()
    assert len(found) == 19 and sum(r.status == "accepted" for r in found) > 15
    for r in found:
        if r.status == "accepted":
            assert np.allclose(matrix(r), motion(0) @ np.linalg.inv(motion(r.frame)), atol=1e-6)


EDGE = "edge int, dx double, dy double, primary boolean, from_anchor boolean, gap int, past_tx double, past_ty double, past_rotation double"
STAR = "edge int, star int, x double, y double"


def test_attempts_and_their_reasons(spark):
    places = [(float(x * 37 % 101) * 9, float(x * 53 % 97) * 9) for x in range(12)]
    stars = lambda shift: [(e, k, x + shift(e), y) for e in (1, 2, 3, 4, 6) for k, (x, y) in enumerate(places)]
    reference = spark.createDataFrame([*stars(lambda e: 0.0), (5, 0, 1.0, 1.0)], STAR)
    # 1 is where it should be, 2 needs the wider radius, 3 is out of reach, 4 moved too far from what came before, 5 has few stars, 6 is no primary edge, 7 no edge with stars
    target = spark.createDataFrame([*stars(lambda e: {1: 1.0, 2: 7.0, 3: 400.0, 4: 1.0, 6: 7.0}[e]), (5, 0, 1.0, 1.0), (5, 1, None, 2.0)], STAR)
    rows = [(e, 0.0, 0.0, e != 6, e == 6, 1, 200.0 if e == 4 else None, 0.0 if e == 4 else None, 0.0 if e == 4 else None) for e in range(1, 8)]
    of = spark.createDataFrame([*rows, rows[0]], EDGE)
    found = {r.edge: r for r in edges.attempt_edges(reference, target, of, "edge", 5.0, 1e6).collect()}
    assert {e: (r.status, r.attempt) for e, r in found.items() if r.status == "accepted"} == {1: ("accepted", "normal"), 2: ("accepted", "relaxed_radius"), 6: ("accepted", "anchor")}
    assert found[4].status == "temporal_validation_failed" and found[4].a is None and found[4].inliers == 12
    assert {found[e].status for e in (5, 7)} == {"phase_correlation_failed"} and found[3].status != "accepted"
    assert abs(found[2].tx + 7) < 1e-9 and 0 < found[2].spatial < 1
    nothing = edges.attempt_edges(reference.limit(0), target.limit(0), of.limit(0), "edge", 5.0, 1e6)
    assert nothing.count() == 0


def test_few_stars_are_missing_data(spark):
    cloud = [(k, float(k * k * 911 % 2003), float(k * k * k * 577 % 1999), float(k)) for k in range(40)]
    master = spark.createDataFrame(cloud, "star int, x double, y double, flux double")
    targets = spark.createDataFrame([("near", k, x + 3, y - 4, f) for k, x, y, f in cloud] + [("few", *s) for s in cloud[:3]], "batch string, star int, x double, y double, flux double")
    found = {r.batch: r for r in edges.global_pairs(master, targets, "batch").collect()}
    assert found["few"].status == "missing_data" and found["near"].status == "accepted" and abs(found["near"].tx + 3) < 1e-6
    assert edges.global_pairs(master, targets.limit(0), "batch").count() == 0
    assert (GLOBAL_LIMITS.inliers, GLOBAL_LIMITS.ratio, GLOBAL_LIMITS.rotation, GLOBAL_LIMITS.scale_low, GLOBAL_LIMITS.scale_high) == (4, 0.1, 20.0, 0.96, 1.04)


def test_changed_references_keep_the_geometry(spark):
    draw = np.random.default_rng(3)
    full = lambda: np.vstack([np.eye(2, 3) + draw.normal(0, 0.1, (2, 3)), [0, 0, 1]])
    cells = lambda m: [float(m[i, j]) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (1, 2))]
    kind = ", ".join(f"{c} double" for c in edges.CELLS)
    one, change, other = full(), full(), full()
    table = spark.createDataFrame([("a", "b", *cells(one), "direct"), ("b", "c", *cells(one), "direct"), ("c", "d", *cells(one), "direct"), ("b", "b", *cells(one), "direct"), ("a", "b", *[None] * 6, "direct")], f"source string, target string, {kind}, method string")
    singular = [1.0, 2.0, 2.0, 4.0, 0.0, 0.0]
    changes = spark.createDataFrame([("b", *cells(change)), ("d", *singular), ("e", *cells(other))], "batch string, " + ", ".join(f"r_{c} double" for c in edges.CELLS))
    found = {(r.source, r.target, r.a is None): r for r in edges.change_references(table, changes).collect()}
    assert np.allclose(matrix(found["a", "b", False]), one @ change) and np.allclose(matrix(found["b", "c", False]), np.linalg.inv(change) @ one)
    assert np.allclose(matrix(found["c", "d", False]), one) and np.allclose(matrix(found["b", "b", False]), np.linalg.inv(change) @ one @ change)
    assert {k: r.method for k, r in found.items()} == {("a", "b", False): "reference_rebased", ("b", "c", False): "reference_rebased", ("b", "b", False): "reference_rebased", ("c", "d", False): "direct", ("a", "b", True): "direct"}


def test_threshold_goes_down_until_enough(spark):
    draw = np.random.default_rng(5)
    images = draw.normal(0, 1, (6, 12, 12))
    images[0, 3, 3] = images[0, 8, 8] = 30
    images[1, 2, 9] = 4.5
    df = spark.createDataFrame([(i, m.reshape(-1).tolist()) for i, m in enumerate(images)], "frame bigint, data array<double>")
    found = kernels.detect_adaptive(df, 12, 12, 2).collect()
    for i, image in enumerate(images):
        tried = [s for s in (5.0, 4.5, 4.0, 3.5, 3.0) if len(kernels.detect(image, s)) >= 2]
        sigma = tried[0] if tried else 3.0
        assert [(r.x, r.y, r.sigma) for r in sorted((r for r in found if r.frame == i), key=lambda r: r.star)] == [(x, y, sigma) for x, y, *_ in kernels.detect(image, sigma)]
    assert {r.sigma for r in found if r.frame == 0} == {5.0}


def test_background_is_level_where_the_frame_is(spark):
    rows = [("f", y, x, 7.0 + (50.0 if (y, x) == (2, 2) else 0), True) for y in range(12) for x in range(12)] + [("dark", y, x, 1.0, False) for y in range(12) for x in range(12)]
    flat = kernels.flatten(spark.createDataFrame(rows, "frame string, y bigint, x bigint, v double, ok boolean"), ["frame"], 12, 12, 4)
    found = {(r.frame, r.y, r.x): r for r in flat.collect()}
    assert len(found) == 288 and found["f", 2, 2].v == pytest.approx(50) and all(found["f", y, y].background == pytest.approx(7) for y in range(12))
    assert found["dark", 5, 5].v == 1.0 and found["dark", 5, 5].background is None


def test_flows_and_texts(spark):
    batches = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b1",)], "batch string")
    night = spark.createDataFrame([("b1", "r/1"), ("b2", ""), ("b3", None)], "batch string, path string")
    own = spark.createDataFrame([("b1", "b1/own"), ("b2", "b2/own")], "batch string, path string")
    files = spark.createDataFrame([("b1/own",), ("b2/own",), ("b3/flow_local.json",)], "path string")
    got = {r.batch: (r.path, r.origin, r.found) for r in flow.active_flows(batches, night, own, files).collect()}
    assert got == {"b1": ("r/1", "manifest", False), "b2": ("b2/own", "batch_manifest", True), "b3": ("b3/flow_local.json", "legacy", True)}
    cards = spark.createDataFrame([(" 'rggb' ", None), ("MONO", "gbrg"), (None, None), ("", "x")], "p string, q string")
    assert [r[0] for r in cards.select(text.mosaic(F.col("p"), F.col("q"))).collect()] == ["RGGB", "GBRG", None, None]
    value = spark.createDataFrame([(float("nan"), float("inf"), 1.5, None)], "a double, b double, c double, d double")
    assert value.select(text.json_safe({n: F.col(n) for n in "abcd"})).first()[0] == '{"a":null,"b":null,"c":1.5,"d":null}'
    reason = value.select(geometry.confidence_reason(F.col("d"), F.lit(0.0625), F.col("d"), F.lit(0.5))).first()[0]
    assert reason == "phase_response=0.0000; inlier_coverage=0.062; rms=999.000; spatial_coverage=0.5000; motion=plausible"
