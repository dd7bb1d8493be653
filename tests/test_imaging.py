"""Stars of made fields, colours from mosaics, and colours brought onto each other."""

from __future__ import annotations

import numpy as np
import pytest

from tesselith.operators import demosaic as D
from tesselith.operators import detection as S
from tesselith.operators import tiles as T


def field(stars, height, width, sigma=1.7, dx=0.0, dy=0.0, scale=1.0):
    y, x = np.mgrid[:height, :width].astype(float)
    cy, cx = (height - 1) / 2, (width - 1) / 2
    return sum(f * np.exp(-((x - (cx + (sx - cx) * scale + dx)) ** 2 + (y - (cy + (sy - cy) * scale + dy)) ** 2) / (2 * sigma**2)) for sx, sy, f in stars)


def spread_out(seed, n, height, width, apart=14):
    r, out = np.random.default_rng(seed), []
    while len(out) < n:
        x, y = r.uniform(12, width - 12), r.uniform(12, height - 12)
        if all(np.hypot(x - a, y - b) > apart for a, b, _ in out):
            out.append((x, y, r.uniform(80, 900)))
    return out


def test_stars_of_a_made_field(spark):
    height, width, r = 220, 260, np.random.default_rng(8)
    stars = spread_out(5, 70, height, width)
    image = 1000 + field(stars, height, width) + r.normal(0, 5, (height, width)) + 0.05 * np.arange(width)
    hot = [(20, 25), (100, 200), (180, 60)]
    for y, x in hot:
        image[y, x] += 2000
    image[150, 10:90] += 120  # a trail
    image[0:3, 0:3] = np.nan
    frames = spark.createDataFrame([(1, image.ravel().tolist()), (2, [7.0] * image.size), (3, None), (4, [float("nan")] * image.size)], "frame bigint, data array<double>")
    found = S.find_stars(frames, height, width, S.Finder(fwhm=4.0), enough=30).collect()
    assert {f.frame for f in found} == {1} and {f.sigma for f in found} == {5.0}
    got = np.array([(f.x, f.y) for f in found])
    ways = np.hypot(got[:, None, 0] - np.array(stars)[None, :, 0], got[:, None, 1] - np.array(stars)[None, :, 1])
    near_trail = np.array([abs(s[1] - 150) < 8 and s[0] < 100 for s in stars])
    assert (ways.min(axis=0) < 0.5)[~near_trail].mean() >= 0.97 and np.median(ways.min(axis=0)) < 0.06
    assert (ways.min(axis=1) >= 2).sum() <= 2
    assert all(np.hypot(got[:, 0] - x, got[:, 1] - y).min() > 2 or ways.min(axis=0).min() < 2 for y, x in hot)
    assert not any(np.hypot(got[:, 0] - x, got[:, 1] - y).min() < 1 and min(np.hypot(s[0] - x, s[1] - y) for s in stars) > 4 for y, x in hot)
    assert np.all(np.diff([f.flux for f in found]) <= 0) and 0 < found[0].width < 8


def test_thresholds_fall_until_there_are_enough_stars():
    r = np.random.default_rng(2)
    faint = [(x, y, 12.0) for x, y, _ in spread_out(6, 20, 160, 160)]
    image = field(faint, 160, 160) + r.normal(0, 3, (160, 160))
    finder = S.Finder(fwhm=4.0)
    first, few = S.find(image, finder, 12.0, 12.0, 1.0, 5)
    sigma, more = S.find(image, finder, 12.0, 3.0, 1.0, 12)
    assert (first, sigma < 12.0) == (12.0, True) and len(few) < 12 <= len(more)
    every, _ = S.candidates(image, finder, 3.0)
    assert len(S.thinned(every[every[:, 6] >= sigma], 6.0, 250)) == len(more)
    assert len(S.thinned(every, 6.0, 3)) == 3


COLOUR_CASES = {"shifted": dict(dx=0.7, dy=-0.4), "scaled": dict(scale=1.004, dx=0.2), "far": dict(dx=7.0)}


def test_colours_are_brought_onto_green(spark):
    height = width = 200
    stars, r = spread_out(3, 40, height, width), np.random.default_rng(1)
    noisy = lambda **k: (field(stars, height, width, **k) + r.normal(0, 1, (height, width))).ravel().tolist()
    green = noisy()
    rows = [(k, noisy(**case), green, noisy()) for k, case in enumerate(COLOUR_CASES.values())] + [(8, None, green, noisy()), (9, green, None, green)]
    frames = spark.createDataFrame(rows, "frame bigint, red array<double>, green array<double>, blue array<double>")
    got = {(c.frame, c.colour): c for c in S.register_colours(frames, height, width).collect()}
    assert set(got) == {(k, c) for k in range(3) for c in ("red", "blue")} | {(8, "blue")}
    middle = (width - 1) / 2
    for k, case in enumerate(COLOUR_CASES.values()):
        c = got[k, "red"]
        if case.get("dx", 0) > 2:
            assert c.method == "none" and (c.a, c.d, c.tx, c.ty) == (1, 1, 0, 0)
            continue
        scale = case.get("scale", 1.0)
        for x, y in ((20, 30), (middle, middle), (170, 150)):  # where a star is seen in red goes back to its place in green
            sx, sy = middle + (x - middle) * scale + case.get("dx", 0), middle + (y - middle) * scale + case.get("dy", 0)
            assert c.method == "similarity" and c.confidence > 0.8
            assert np.hypot(c.a * sx + c.b * sy + c.tx - x, c.c * sx + c.d * sy + c.ty - y) < 0.1
        assert np.hypot(got[k, "blue"].tx, got[k, "blue"].ty) < 0.1
    by_model = S.register_colours(frames, height, width, models={"red": [1, 0, 0, 1, 0.5, 0.5], "blue": [1, 0, 0, 1, 9, 9]}).where("frame = 0").collect()
    assert {(c.colour, c.method) for c in by_model} == {("red", "session"), ("blue", "similarity")}


def test_a_few_stars_give_a_shift_alone():
    stars = spread_out(4, 4, 64, 64)
    method, m, response = S.colour_transform(field(stars, 64, 64), field(stars, 64, 64, dx=1.2, dy=0.6))
    assert method == "shift" and response >= 0.15 and abs(m[0, 2] + 1.2) < 0.1 and abs(m[1, 2] + 0.6) < 0.1


def by_pixel(mosaic, pattern):
    """The published linear filters, pixel by pixel."""
    h, w = mosaic.shape
    fold = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i
    colour = lambda y, x: pattern[2 * (y % 2) + x % 2]
    apply = lambda k, y, x: sum(k[i][j] * mosaic[fold(y + i - 2, h), fold(x + j - 2, w)] for i in range(5) for j in range(5))
    out = np.zeros((3, h, w))
    for y in range(h):
        for x in range(w):
            own = colour(y, x)
            for c, name in enumerate("RGB"):
                if name == own:
                    out[c, y, x] = mosaic[y, x]
                elif name == "G":
                    out[c, y, x] = apply(D.GREEN, y, x)
                elif own == "G":
                    out[c, y, x] = apply(D.ALONG if name in (colour(y, x + 1), colour(y, x - 1)) else D.ALONG.T, y, x)
                else:
                    out[c, y, x] = apply(D.ACROSS, y, x)
    return out


@pytest.mark.parametrize("pattern", D.PATTERNS)
def test_linear_filters_equal_those_pixel_by_pixel(pattern):
    mosaic = np.random.default_rng(3).random((11, 14))
    np.testing.assert_allclose(D.malvar(mosaic, pattern), by_pixel(mosaic, pattern), atol=1e-12)


@pytest.mark.parametrize("method", list(D.METHODS))
def test_tiles_give_what_whole_frames_do(spark, method):
    height, width, size, pattern = 75, 58, 32, "GRBG"
    r = np.random.default_rng(5)
    images = [r.uniform(0, 65535, (height, width)) for _ in range(2)]
    frames = spark.createDataFrame([(k, i.ravel().tolist()) for k, i in enumerate(images)], "frame int, data array<double>")
    tiles = T.cut(frames, ["frame"], height, width, size)
    assert tiles.count() == 2 * 3 * 2
    out = np.zeros((2, 3, height, width))
    for t in D.demosaic(tiles, ["frame"], size, pattern, method).collect():
        for c, name in enumerate(("red", "green", "blue")):
            out[t.frame, c, t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.reshape(t[name], (t.h, t.w))
    for k, image in enumerate(images):
        np.testing.assert_allclose(out[k], np.clip(D.METHODS[method](image / 65535, pattern), 0, 1) * 65535, atol=1e-6)


def test_directions_follow_edges_better_than_means():
    y, x = np.mgrid[:96, :96]
    truth = np.stack([0.5 + 0.4 * np.sign(np.sin((x + k) / 5)) for k in (0.3, 0.0, -0.3)]) * 0.9 + 0.05
    level = np.full((8, 8), 0.25)
    for pattern in D.PATTERNS:
        at = D.places((96, 96), pattern)
        mosaic = sum(np.where(at[c], truth[i], 0.0) for i, c in enumerate("RGB"))
        error = {m: float(((np.array(made(mosaic, pattern)) - truth)[:, 8:-8, 8:-8] ** 2).mean()) for m, made in D.METHODS.items()}
        assert error["menon"] < error["malvar"] < error["bilinear"]
        for made in D.METHODS.values():
            np.testing.assert_allclose(np.array(made(level, pattern)), 0.25, atol=1e-9)


def test_what_cannot_be_demosaiced(spark):
    tiles = spark.createDataFrame([], "frame int, y0 int, x0 int, h int, w int, data array<double>")
    assert D.demosaic(tiles, ["frame"], 32, "RGGB").collect() == []
    for pattern, method in (("RGBG", "malvar"), ("RGGB", "other")):
        with pytest.raises(ValueError):
            D.demosaic(tiles, ["frame"], 32, pattern, method)
    with pytest.raises(ValueError):
        T.stencil(tiles, ["frame"], 8, 9, lambda i, y, x: [i], ["v"])


def test_regions_of_any_shape():
    from tesselith.operators.kernels import detect, regions

    spiral = np.zeros((41, 41), bool)
    y, x, dy, dx = 20, 20, 0, 1
    for step in range(1, 20):
        for _ in range(2):
            for _ in range(2 * step):
                if 0 <= y < 41 and 0 <= x < 41:
                    spiral[y, x] = True
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
    pixels, region = regions(spiral)
    assert len(pixels) == spiral.sum() and set(region) == {0}
    dots = np.zeros((9, 9), bool)
    dots[::2, ::2] = True
    assert len(set(regions(dots)[1])) == 25
    dots[1::2, 1::2] = True
    assert len(set(regions(dots)[1])) == 1 and len(regions(np.zeros((3, 3), bool))[0]) == 0
    r = np.random.default_rng(1)
    image = r.normal(0, 1, (60, 70))
    got = detect(image, 1.0)
    middle = float(np.median(image))
    over = image > middle + 1.4826 * float(np.median(np.abs(image - middle)))
    left, want = set(zip(*np.nonzero(over), strict=True)), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        w = np.array([image[p] - middle for p in own])
        want.append((float((w * [p[1] for p in own]).sum() / w.sum()), float((w * [p[0] for p in own]).sum() / w.sum()), float(w.sum()), len(own)))
    np.testing.assert_allclose(got, sorted(want, key=lambda s: -s[2]), rtol=1e-9)
