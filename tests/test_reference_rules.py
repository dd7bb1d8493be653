"""Rules of frames, transforms and stacks on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from tesselith.functions import geometry, metrics, text
from tesselith.functions.geometry import Affine
from tesselith.operators import ranking, stacking

NAN, INF = float("nan"), float("inf")


def one(spark, column, **values):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    df = spark.range(1).select(*((F.lit(v) if v is not None else F.lit(None).cast("double")).cast(kinds.get(type(v), "double")).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def trail(spark, **own):
    c = F.col
    base = {"count": 20.0, "roundness": 0.4, "elongation": 2.0, "excess": 3.0, "direction": 0.9, "tangential": None, "rm": 0.9, "rs": 0.05, "em": 0.2, "es": 0.1} | own
    column = metrics.trail_assessment(c("count"), c("roundness"), c("elongation"), c("excess"), c("direction"), c("tangential"), {"roundness": c("rm"), "excess": c("em")}, {"roundness": c("rs"), "excess": c("es")})
    return one(spark, column, **base)


def test_trail_classes(spark):
    r = trail(spark)
    assert (r.trail_class, r.cause, r.penalty) == ("severe", "tracking", 0.0) and abs(r.confidence - 0.865) < 1e-9
    assert trail(spark, elongation=1.4).trail_class == "moderate" and trail(spark, elongation=1.2).trail_class == "none"
    assert trail(spark, direction=None, tangential=0.8).cause == "field_rotation" and trail(spark, direction=0.5, tangential=0.47).cause == "tracking"
    assert trail(spark, direction=None).trail_class == "none" and trail(spark, direction=None).cause == "optical_or_mixed"
    assert trail(spark, count=7.0).trail_class == "unreliable" and trail(spark, elongation=None).trail_class == "unreliable" and trail(spark, roundness=None).confidence == 0.0
    # at a threshold counts; a spread of 0 counts as the floor
    assert trail(spark, roundness=0.65, rm=0.8, rs=0.05, direction=0.65).trail_class == "severe" and trail(spark, rs=0.0, es=0.0).trail_class == "severe"
    assert trail(spark, roundness=0.66, rm=0.8, rs=0.05).trail_class == "moderate"


def test_transforms_are_validated(spark):
    c = F.col

    def reason(**own):
        base = {"matches": 20, "inliers": 10, "rms": 1.0, "a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "tx": 3.0, "ty": 4.0} | own
        return one(spark, geometry.validation(c("matches"), c("inliers"), c("rms"), Affine.of()), **base)

    assert reason() == "accepted" and reason(a=None, matches=0) == "phase_correlation_failed" and reason(a=None) == "insufficient_matches"
    assert reason(inliers=3) == "insufficient_inliers" and reason(matches=100, inliers=14) == "low_inlier_ratio"
    assert reason(rms=None) == "high_rms" and reason(tx=1500.0) == "high_translation" and reason(c=0.2) == "high_rotation" and reason(a=1.06) == "invalid_scale"
    good = geometry.confidence(c("ratio"), c("rms"), c("response"), c("spatial"))
    assert one(spark, good, ratio=0.5, rms=2.0, response=0.15, spatial=0.01) == "accepted"
    assert one(spark, good, ratio=0.5, rms=None, response=0.15, spatial=0.01) == "low_confidence"
    decided = geometry.alignment_decision(c("checked"), c("sure"), c("rms"), c("coverage"), c("x"), c("y"))
    base = {"checked": True, "sure": 0.2, "rms": 1.0, "coverage": 0.5, "x": 0.9, "y": 1.2}
    assert one(spark, decided, **base) == "verified" and one(spark, decided, **(base | {"x": 1.0})) == "failed_quality"
    assert one(spark, decided, **(base | {"coverage": 0.1})) == "insufficient_overlap" and one(spark, decided, **(base | {"checked": False})) == "unverified" and one(spark, decided, **(base | {"sure": 0.1})) == "failed_quality"


def test_ascii_headers_keep_few_accents(spark):
    assert one(spark, text.ascii_fold(F.col("t")), t="José Çelik Ñandú Ántares – x") == "Jose Celik Nandu ntares  x"


def frames(spark, rows):
    return spark.createDataFrame([(f"f{i:02d}", "n", *r) for i, r in enumerate(rows)], "key string, night string, fwhm double, roundness double, star_count double, snr double")


def test_selection_by_share(spark):
    table = frames(spark, [(2.0, 0.9, 9.0, 1.0), (1.0, 1.2, 8.0, 2.0), (0.0, -1.0, 7.0, 3.0), (NAN, 0.5, None, 4.0), (3.0, 0.7, 0.0, -1.0), (4.0, 0.6, 5.0, INF)])
    pick = lambda metric, percent: [r.key for r in ranking.best_share(table, ["night"], metric, percent, "key").orderBy("key").collect()]
    assert pick("fwhm", 1) == ["f00", "f01", "f04"] and pick("roundness", 50) == ["f00", "f04", "f05"] and pick("star_count", 100) == ["f00", "f01", "f02", "f05"] and pick("snr", 1) == ["f01", "f02", "f03"]
    none = frames(spark, [(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), (None, 2.0, 1.0, 1.0), (0.0, None, 1.0, 1.0)])
    assert [r.key for r in ranking.best_share(none, ["night"], "fwhm", 50, "key").orderBy("key").collect()] == ["f00", "f01", "f02"]
    assert ranking.best_share(none, ["night"], "roundness", 50, "key").count() == 0


def test_scores_are_null_unless_eligible_and_selection_falls_back(spark):
    weights = {"fwhm": 0.5, "roundness": 0.3, "snr": 0.2}
    table = frames(spark, [(2.0, 0.9, 1.0, None), (None, 0.8, 1.0, 5.0), (1.0, 0.7, 1.0, 6.0)])
    scores = {r.key: r for r in ranking.quality_scores(table, "key", weights, ["night"]).collect()}
    assert scores["f01"].score is None and not scores["f01"].eligible and scores["f01"].missing == ["fwhm"] and scores["f00"].score is not None
    assert {r.key for r in ranking.best_scores(table, "key", weights, ["night"], 100, "key").collect()} == {"f00", "f02"}
    bare = frames(spark, [(None, None, 1.0, 5.0)] * 4)
    got = ranking.best_scores(bare, "key", weights, ["night"], 1, "key").collect()
    assert sorted(r.key for r in got) == ["f00", "f01", "f02"] and all(r.fallback for r in got)


@pytest.mark.parametrize(("policy", "least"), [("exclude_severe", 0.0), ("weight_only", 0.05), ("off", 0.25), ("report", 0.25)])
def test_policies_bound_a_severe_trail(spark, policy, least):
    assert one(spark, ranking.policy_weight(F.col("w"), F.col("t"), policy), w=0.0, t="severe") == least
    assert one(spark, ranking.policy_weight(F.col("w"), F.col("t"), policy), w=0.01, t="none") == 0.01


def test_tree_masks_nodes_with_few_samples(spark):
    """Eight frames on four leaves: one leaf has a sample of one of two frames, so its value goes no further."""
    rows = [("n", f, 0, float(f if f != 7 else 99), f != 3) for f in range(8)]
    got = stacking.tree_median(spark.createDataFrame(rows, "batch string, frame int, pos int, v double, ok boolean"), ["batch", "pos"], [F.col("frame")], ["batch"]).first()
    # leaves 0: 0 and 4, 1: 1 and 5, 2: 2 and 6, 3: 99 alone of 3 and 7
    assert got.value == (2.5 + 4.0) / 2 and got.n == 7 and got.valid


def test_codes_and_exposures(spark):
    clip = stacking.clip_uint16(F.col("v"))
    assert [one(spark, clip, v=v) for v in (-3.0, 1.9, 65535.4, 1e9, NAN)] == [0, 1, 65535, 65535, 0]
    seconds = stacking.hdr_exposure(F.col("a"), F.col("b"))
    assert one(spark, seconds, a=30.0, b=30.00001).problem is None and one(spark, seconds, a=30.0, b=31.0).problem.startswith("conflicting")
    assert one(spark, seconds, a=None, b=None).problem.startswith("EXPTIME") and one(spark, seconds, a=None, b=12.0).seconds == 12.0
    assert one(spark, stacking.hdr_exposure(F.col("a"), F.col("b"), F.lit(5.0)), a=30.0, b=31.0).problem is None


def test_hdr_leaves_out_saturated_samples_and_keeps_rates(spark):
    rows = [(0, 0.9, 1.0, True, None, False, None, None), (0, 9.0, 10.0, True, 5.0, False, None, None), (0, 1.1, 10.0, True, None, True, None, None), (0, 0.5, 2.0, True, 0.6, False, 0.0, 4.0)]
    got = stacking.hdr_fuse(spark.createDataFrame(rows, "pos int, v double, exposure double, ok boolean, saturation double, is_rate boolean, low double, high double"), ["pos"], 1.0, 5.0).first()
    assert math.isclose(got.radiance, (0.9 + 1.1 + 4 * 1.0) / 6) and got.valid
