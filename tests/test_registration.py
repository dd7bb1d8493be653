"""Chains and trees of registered frames: against plain sequential loops, and against the true motions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.functions.geometry import NO_RMS, Limits
from tesselith.operators import registration as R
from tesselith.operators.kernels import sub_pixel_shift

FLOW = R.Flow(height=800, width=1000, radius=12.0, threshold=3.0, limits=Limits(inliers=12))


def sky(seed: int, n: int = 70) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.column_stack([r.uniform(50, 950, n), r.uniform(50, 750, n), r.uniform(10, 900, n)])


def sequence(batch: int, places: int, anchor: int, lost=(), few=(), jump=None) -> tuple[list[tuple], dict[int, np.ndarray]]:
    """Frames of one sky that turns and drifts, and the true 2 x 3 matrices from each to the anchor."""
    stars, r = sky(batch), np.random.default_rng(100 + batch)
    rows, motion = [], {}
    for place in range(places):
        angle, shift = 0.002 * place, np.array([3.3 * place, -2.1 * place])
        if jump and place >= jump:
            shift = shift + [180.0, 0.0]
        m = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        motion[place] = np.vstack([np.column_stack([m, shift]), [0, 0, 1]])
        seen = np.column_stack([stars[:, :2] @ m.T + shift + r.normal(0, 0.05, (len(stars), 2)), stars[:, 2]])
        if place in lost:
            seen[:, :2] = r.uniform(0, 1000, (len(stars), 2))
        if place in few:
            seen = seen[:2]
        rows.append((batch, place, [tuple(map(float, s)) for s in seen], place == anchor))
    return rows, {p: (motion[anchor] @ np.linalg.inv(m))[:2] for p, m in motion.items()}


SCHEMA = "batch bigint, place int, stars array<struct<x:double,y:double,flux:double>>, anchor boolean"
CASES = {
    1: dict(places=16, anchor=0),
    2: dict(places=18, anchor=7, lost=(4, 10, 11), few=(13,)),
    3: dict(places=20, anchor=3, lost=(8, 9, 12, 16), jump=11),
    4: dict(places=6, anchor=2, lost=(1,)),
    5: dict(places=3, anchor=1, few=(1,)),
}


@pytest.fixture(scope="module")
def made(spark):
    rows, truth = [], {}
    for batch, settings in CASES.items():
        own, truth[batch] = sequence(batch, **settings)
        rows += own
    rows += [rows[0], (None, 1, [], False), (1, None, None, None), (6, 0, None, False), (6, 1, [], None)]
    frames = spark.createDataFrame(rows, SCHEMA).withColumns({"tried": F.lit("clash"), "reference": F.lit(1)})
    plain = {b: {r[1]: {"stars": [dict(zip("x y flux".split(), s, strict=True)) for s in r[2]]} for r in rows if r[0] == b and r[1] is not None and r[2]} for b in CASES}
    return frames, plain, truth


def checked(result: dict) -> str:
    """The status of a result, as the rules say."""
    limits, m = FLOW.limits, result
    if m["a"] is None:
        return "phase_correlation_failed" if m["matches"] == 0 else "insufficient_matches"
    scale = math.hypot(m["a"], m["c"])
    for bad, why in ((m["inliers"] < limits.inliers, "insufficient_inliers"), (m["ratio"] < limits.ratio, "low_inlier_ratio"), (m["rms"] > limits.rms, "high_rms"), (math.hypot(m["tx"], m["ty"]) > limits.translation, "high_translation"), (abs(R.rotation(m)) > limits.rotation, "high_rotation"), (not limits.scale_low <= scale <= limits.scale_high, "invalid_scale")):
        if bad:
            return why
    return "accepted"


class Pairs:
    """Results by pair, each made when it is asked for."""

    def __init__(self, frames):
        self.frames, self.made = frames, {}

    def of(self, reference, target, wide):
        if (reference, target) not in self.made:
            self.made[reference, target] = [r | {"status": checked(r)} for r in R.pair(self.frames[reference], self.frames[target], FLOW)]
        return self.made[reference, target][wide]


def plain_chain(frames, anchor):
    """What each frame comes to, one after the other: (state, parent, method or reason)."""
    out, pairs, previous, recent = {anchor: ("accepted", None, "reference")}, Pairs(frames), anchor, []
    for place in sorted(frames):
        if place == anchor:
            continue
        if len(frames[place]["stars"]) < FLOW.fewest:
            out[place] = ("rejected", None, "insufficient_stars_or_error")
            continue
        best = ("phase_correlation_failed", 0, NO_RMS)
        for method, reference, wide in [("normal", previous, False), ("relaxed_radius", previous, True)] + [("anchor", anchor, True)] * (previous != anchor):
            m = pairs.of(reference, place, wide)
            good, why = m["status"] == "accepted", m["status"]
            if good and method != "anchor" and len(recent) >= 4:
                usual = np.median(np.array(recent[-8:]), axis=0)
                if abs(m["tx"] - usual[0]) > 120 or abs(m["ty"] - usual[1]) > 120 or abs(R.rotation(m) - usual[2]) > 2:
                    good, why = False, "temporal_validation_failed"
            if good:
                out[place] = ("accepted", reference, method)
                if method != "anchor":
                    recent.append((m["tx"], m["ty"], R.rotation(m)))
                previous = place
                break
            if m["inliers"] > best[1] or (m["inliers"] == best[1] and m["rms"] < best[2]):
                best = (why, m["inliers"], m["rms"])
        else:
            out[place] = ("rejected", None, best[0])
    return out


def plain_tree(frames, anchor):
    """The tree, grown one frame at a time."""
    pairs, accepted, cache, failures = Pairs(frames), {anchor: (0, 0.0)}, {}, {}
    out, history = {anchor: ("accepted", None, "reference")}, {-1: [], 1: []}
    remaining = {p for p in frames if p != anchor}

    def attempt(parent, place, primary):
        recent, best = history[1 if place > parent else -1][-8:], ("phase_correlation_failed", 0, NO_RMS)
        for method, wide in [("normal", False), ("relaxed_radius", True)] if primary else [("anchor" if parent == anchor else "neighbor", True)]:
            m = pairs.of(parent, place, wide)
            good, why, gap = m["status"] == "accepted", m["status"], abs(place - parent)
            if good and len(recent) >= 4:
                usual = np.median(np.array(recent), axis=0)
                if abs(m["tx"] - usual[0]) > 120 * gap or abs(m["ty"] - usual[1]) > 120 * gap or abs(R.rotation(m) - usual[2]) > 2 * gap:
                    good, why = False, "temporal_validation_failed"
            if good:
                return m, method
            if m["inliers"] > best[1] or (m["inliers"] == best[1] and m["rms"] < best[2]):
                best = (why, m["inliers"], m["rms"])
        return None, best[0]

    while remaining:
        progress = False
        for place in sorted(remaining, key=lambda p: (abs(p - anchor), p)):
            if len(frames[place]["stars"]) < FLOW.fewest:
                out[place], progress = ("rejected", None, "insufficient_stars_or_error"), True
                remaining.remove(place)
                continue
            near = sorted((p for p in accepted if p == anchor or abs(p - place) <= FLOW.window), key=lambda p: (abs(p - place) != 1, accepted[p][0], abs(p - place), p))
            chosen = near[:3]
            if anchor not in chosen:
                chosen[-1] = anchor
            works = []
            for i, parent in enumerate(chosen):
                if (parent, place, i == 0) not in cache:
                    cache[parent, place, i == 0] = attempt(parent, place, i == 0)
                m, method = cache[parent, place, i == 0]
                if m is None:
                    failures[place] = method
                else:
                    works.append((accepted[parent][0] + 1, math.hypot(accepted[parent][1], m["rms"]), abs(place - parent), parent, method, m))
            if works:
                hops, rms, _, parent, method, m = min(works, key=lambda w: w[:4])
                out[place], accepted[place], progress = ("accepted", parent, method), (hops, rms), True
                remaining.remove(place)
                if method != "anchor":
                    history[1 if place > parent else -1].append((m["tx"], m["ty"], R.rotation(m)))
        if not progress:
            break
    for place in remaining:
        out[place] = ("rejected", None, failures.get(place, "disconnected_from_reference"))
    return out


@pytest.mark.parametrize(("walk", "plain"), [(R.chain, plain_chain), (R.tree, plain_tree)])
def test_decisions_equal_a_plain_loop_and_the_true_motions(made, walk, plain):
    frames, by_batch, truth = made
    got = {}
    for r in walk(frames, FLOW).collect():
        assert (r.batch, r.place) not in got
        got[r.batch, r.place] = r
    for batch, settings in CASES.items():
        if batch == 5:
            continue
        want = plain(by_batch[batch], settings["anchor"])
        assert {p: (r.state, r.parent, r.method or r.reason) for (b, p), r in got.items() if b == batch} == want
        for place, (state, _, _) in want.items():
            if state == "accepted":
                r = got[batch, place]
                assert np.abs(np.array([[r.m_a, r.m_b, r.m_tx], [r.m_c, r.m_d, r.m_ty]]) - truth[batch][place]).max() < 1.5
    assert {b for b, _ in got} == {1, 2, 3, 4}
    lost = {(2, 4), (2, 10), (2, 11), (2, 13), (3, 8), (3, 9), (3, 12), (3, 16), (4, 1)}
    assert {k for k, r in got.items() if r.state == "rejected"} >= lost
    if walk is R.tree:
        assert {k for k, r in got.items() if r.state == "rejected" and k[0] != 3} == {k for k in lost if k[0] != 3}
        assert got[4, 0].state == got[4, 5].state == "accepted"  # both ends, past the bad frame
        assert {r.consistent for r in got.values() if r.state == "accepted"} == {True}


def test_no_frames(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.chain(empty, FLOW).collect() == R.tree(empty, FLOW).collect() == []


def test_images_take_the_place_of_star_maps(spark):
    stars = sky(3, 30)
    flow = R.Flow(height=64, width=64, radius=2.0, threshold=0.5)
    points = stars * [0.06, 0.08, 1.0]
    rows = [(1, k, [(float(x + 1.5 * k), float(y - k), float(f)) for x, y, f in points], k == 0, field(points, 1.5 * k, -k)) for k in range(3)]
    got = {r.place: r for r in R.chain(spark.createDataFrame(rows, SCHEMA + ", image array<double>"), flow).collect()}
    assert [got[k].method for k in range(3)] == ["reference", "normal", "normal"]
    assert abs(got[2].m_tx + 3) < 0.01 and abs(got[2].m_ty - 2) < 0.01


def field(stars, dx, dy, size=64):
    y, x = np.mgrid[:size, :size]
    return sum(f * np.exp(-((x - sx - dx) ** 2 + (y - sy - dy) ** 2) / 4) for sx, sy, f in stars).ravel().tolist()


@pytest.mark.parametrize("noise", [0.0, 2.0])
def test_shifts_to_a_tenth_of_a_pixel(noise):
    r = np.random.default_rng(2)
    y, x = np.mgrid[:96, :128]
    places = [(*p, f) for *p, f in np.column_stack([r.uniform(0, 96, 40), r.uniform(0, 128, 40), r.uniform(50, 500, 40)])]
    image = lambda dy, dx: sum(f * np.exp(-((y - a - dy) ** 2 + (x - b - dx) ** 2) / 4.5) for a, b, f in places) + r.normal(0, noise, y.shape)
    for _ in range(10):
        dy, dx = r.uniform(-12, 12, 2)
        got = sub_pixel_shift(image(0, 0), image(dy, dx))
        assert abs(got[0] - dy) < 0.1 and abs(got[1] - dx) < 0.1 and got[2] > 0.2
    assert sub_pixel_shift(np.zeros((8, 8)), np.zeros((8, 8)))[:2] == (0, 0)
