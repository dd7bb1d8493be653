"""Image kernels: those that gather neighbouring pixels as joins and aggregates, the others in NumPy per frame.

A kernel over neighbours is written from the source's side: each pixel is sent
to the few outputs it has a part in, and these are summed by output pixel. So
there is one shuffle on the output's keys, and no frame is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.functions.geometry import Affine
from tesselith.session import ship_package


def offsets(reach: int) -> Column:
    """The steps to a pixel's neighbours, itself included, as an array of (dy, dx)."""
    steps = range(-reach, reach + 1)
    return F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in steps for j in steps))


def warp(stack: DataFrame, keys: list[str], inverse: Affine, height: int, width: int, order: int = 1) -> DataFrame:
    """Frames moved by an affine transform; ``inverse`` takes output places to source places, and is made of constants and key columns. ``order`` 0 takes the
    nearest pixel, 1 weighs four. Output pixels that need one from outside are left out; ``ok`` is true if all were valid."""
    grid = stack.select(*keys).distinct()
    places = grid.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    sx, sy = inverse.apply(F.col("x").cast("double"), F.col("y").cast("double"))
    placed = places.select(*keys, "y", "x", F.round(sx, 9).alias("sx"), F.round(sy, 9).alias("sy"))
    if order == 0:
        parts = placed.select(*keys, "y", "x", F.rint("sy").cast("bigint").alias("py"), F.rint("sx").cast("bigint").alias("px"), F.lit(1.0).alias("part"))
    else:
        fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
        four = F.explode(F.array(*(F.struct((F.floor("sy") + i).alias("py"), (F.floor("sx") + j).alias("px"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("part")) for i in (0, 1) for j in (0, 1)))).alias("n")
        parts = placed.select(*keys, "y", "x", four).select(*keys, "y", "x", "n.*").where("part > 0")
    source = stack.select(*keys, F.col("y").cast("bigint").alias("py"), F.col("x").cast("bigint").alias("px"), "v", "ok")
    # Merged: pixels that are few bytes on disk are too many for the driver to broadcast.
    total = parts.join(source.hint("merge"), [*keys, "py", "px"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("part") * F.col("v")).alias("v"), F.bool_and("ok").alias("ok"), F.sum("part").alias("whole"))
    return total.where("whole > 1 - 1e-9").drop("whole")


def debayer(stack: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Red, green and blue at each pixel of an RGGB mosaic: the weighted mean of the 3 by 3 neighbours that have the colour."""
    colour = F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), "r").when((F.col("y") % 2 == 1) & (F.col("x") % 2 == 1), "b").otherwise("g")
    sent = stack.select(*keys, "y", "x", "v", colour.alias("colour"), F.explode(offsets(1)).alias("o"))
    weight = 1.0 / F.pow(F.lit(2.0), F.abs(F.col("o.dy")) + F.abs(F.col("o.dx")))
    sent = sent.select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "colour", "v", weight.alias("w"))
    inside = sent.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    pick = lambda c: F.sum(F.when(F.col("colour") == c, F.col("w") * F.col("v"))) / F.sum(F.when(F.col("colour") == c, F.col("w")))
    own = lambda c: F.max(F.when((F.col("colour") == c) & (F.col("w") == 1), F.col("v")))
    return inside.groupBy(*keys, "y", "x").agg(*(F.coalesce(own(c), pick(c)).alias(c) for c in "rgb"))


def morphology(stack: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """``eroded``: valid with all 3 by 3 neighbours inside the frame; ``dilated``: valid with any."""
    sent = stack.select(*keys, "y", "x", "ok", F.explode(offsets(1)).alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "ok")
    inside = sent.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return inside.groupBy(*keys, "y", "x").agg(F.bool_and("ok").alias("eroded"), F.bool_or("ok").alias("dilated"))


def background(stack: DataFrame, keys: list[str], box: int, sigma: float = 3.0) -> DataFrame:
    """The clipped median of each box of a frame."""
    from tesselith.operators.stacking import clipped_stats

    boxed = stack.withColumn("by", F.floor(F.col("y") / box)).withColumn("bx", F.floor(F.col("x") / box))
    return clipped_stats(boxed, [*keys, "by", "bx"], 3, sigma).select(*keys, "by", "bx", F.col("median").alias("background"))


def flatten(stack: DataFrame, keys: list[str], height: int, width: int, box: int = 50, sigma: float = 3.0) -> DataFrame:
    """(keys, y, x, v, background): pixels less the background of their frame.

    A box counts if at least half of its pixels are valid. Each box takes the median of the 3 by 3 boxes around it that
    count, and the background between the middles of boxes is bilinear, level beyond the outermost ones. Where no
    box near a pixel counts, its value stays as it is and the background is null."""
    down, across = -(-height // box), -(-width // box)
    place = [F.floor(F.col("y") / box).alias("by"), F.floor(F.col("x") / box).alias("bx")]
    valid = stack.groupBy(*keys, *place).agg((F.count_if("ok") * 2 >= F.count(F.lit(1))).alias("counts")).where("counts").drop("counts")
    mesh = background(stack.where("ok"), keys, box, sigma).join(valid, [*keys, "by", "bx"])
    sent = mesh.select(*keys, "by", "bx", "background", F.explode(offsets(1)).alias("o")).select(*keys, (F.col("by") + F.col("o.dy")).alias("by"), (F.col("bx") + F.col("o.dx")).alias("bx"), "background")
    smooth = sent.where(F.col("by").between(0, down - 1) & F.col("bx").between(0, across - 1)).groupBy(*keys, "by", "bx").agg(F.median("background").alias("level"))

    def along(c: str, most: int) -> Column:
        at = F.least(F.greatest((F.col(c) + 0.5) / box - 0.5, F.lit(0.0)), F.lit(float(most - 1)))
        return F.array(*(F.struct((F.floor(at) + i).alias("b"), (at - F.floor(at) if i else 1 - at + F.floor(at)).alias("w")) for i in (0, 1)))

    rows = stack.select(*keys, "y", "x", "v", F.explode(along("y", down)).alias("p"), along("x", across).alias("q")).select("*", F.explode("q").alias("r"))
    rows = rows.select(*keys, "y", "x", "v", F.col("p.b").alias("by"), F.col("r.b").alias("bx"), (F.col("p.w") * F.col("r.w")).alias("w")).where("w > 0")
    level = F.try_divide(F.sum(F.when(F.col("level").isNotNull(), F.col("w") * F.col("level"))), F.sum(F.when(F.col("level").isNotNull(), F.col("w"))))
    total = rows.join(smooth, [*keys, "by", "bx"], "left").groupBy(*keys, "y", "x").agg(F.max("v").alias("v"), level.alias("background"))
    return total.select(*keys, "y", "x", (F.col("v") - F.coalesce("background", F.lit(0.0))).alias("v"), "background")


# --- NumPy, one frame or pair of frames at a time


def phase_shift(one: np.ndarray, other: np.ndarray) -> tuple[int, int, float]:
    """The whole-pixel shift (dy, dx) that takes ``one`` to ``other``, and the height of the correlation's peak."""
    a, b = np.fft.fft2(one - one.mean()), np.fft.fft2(other - other.mean())
    cross = b * a.conj()
    surface = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)).real
    dy, dx = np.unravel_index(int(surface.argmax()), surface.shape)
    h, w = surface.shape
    return int(dy - h if dy > h // 2 else dy), int(dx - w if dx > w // 2 else dx), float(surface.max())


def _whitened(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The cross spectrum of two windowed images, all its parts of one size."""
    h, w = one.shape
    window = np.outer(np.hanning(h + 2)[1:-1], np.hanning(w + 2)[1:-1])
    a, b = (np.fft.fft2((x - x.mean()) * window) for x in (one, other))
    cross = b * a.conj()
    size = np.abs(cross)
    return cross / np.maximum(size, max(1e-12, 1e-9 * float(size.max(initial=0.0))))


def sub_pixel_shift(one: np.ndarray, other: np.ndarray, finest: float = 1 / 64) -> tuple[float, float, float]:
    """The shift (dy, dx) that takes ``one`` to ``other`` in parts of a pixel, and the share of the correlation at its peak.

    Both are windowed, so that their edges don't correlate. The highest place of the correlation is the whole shift; the parts come
    from what both frames see of the sky, whose spectrum is summed at places ever closer to the best one."""
    h, w = one.shape
    surface = np.fft.ifft2(_whitened(one, other)).real
    dy, dx = (int(i) for i in np.unravel_index(int(surface.argmax()), surface.shape))
    near = np.ix_(*(sorted({(p + i) % n for i in range(-2, 3)}) for p, n in ((dy, h), (dx, w))))
    response = float(np.clip(surface[near].sum(), 0.0, 1.0))
    dy, dx = dy - h if dy > h // 2 else dy, dx - w if dx > w // 2 else dx
    y = x = 0.0
    if min(h - abs(dy), w - abs(dx)) >= 8:
        seen = lambda of, sy, sx: of[max(0, sy) : h + min(0, sy), max(0, sx) : w + min(0, sx)]
        cross = _whitened(seen(one, -dy, -dx), seen(other, dy, dx))
        fy, fx = np.fft.fftfreq(cross.shape[0]), np.fft.fftfreq(cross.shape[1])
        cross = cross * np.exp(-18 * (fy[:, None] ** 2 + fx[None, :] ** 2))  # fine detail is mostly noise
        step = 0.5
        while step >= finest:
            ys, xs = y + step * np.arange(-2, 3), x + step * np.arange(-2, 3)
            at = (np.exp(2j * np.pi * np.outer(ys, fy)) @ cross @ np.exp(2j * np.pi * np.outer(fx, xs))).real
            i, j = np.unravel_index(int(at.argmax()), at.shape)
            if at[i, j] > at[2, 2]:
                y, x = float(ys[i]), float(xs[j])
            step /= 2
    return dy + y, dx + x, response


def similarity_from(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of turn, scale and shift that takes points p nearest to q."""
    pm, qm = p.mean(axis=0), q.mean(axis=0)
    a, b = p - pm, q - qm
    norm = max(float((a * a).sum()), 1e-12)
    c, s = float((a * b).sum()) / norm, float((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()) / norm
    m = np.array([[c, -s], [s, c]])
    return np.column_stack([m, qm - m @ pm])


def ransac(p: np.ndarray, q: np.ndarray, threshold: float, rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray] | None:
    """A similarity and which pairs it fits, from pairs of which some are wrong; the same seed gives the same result."""
    if len(p) < 2:
        return None
    draw, best = np.random.default_rng(seed), None
    error = lambda m: np.hypot(*(p @ m[:, :2].T + m[:, 2] - q).T)
    for _ in range(rounds):
        pick = draw.choice(len(p), 2, replace=False)
        fits = error(similarity_from(p[pick], q[pick])) <= threshold
        if best is None or fits.sum() > best.sum():
            best = fits
    if best.sum() < 2:
        return None
    m = similarity_from(p[best], q[best])
    return m, error(m) <= threshold


def hull_area(points: np.ndarray) -> float:
    """The area of the convex hull."""
    ordered = sorted(set(map(tuple, points.tolist())))
    if len(ordered) < 3:
        return 0.0

    def chain(path: list) -> list:
        out: list = []
        for x, y in path:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    x, y = np.array(chain(ordered) + chain(ordered[::-1])).T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def regions(over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the set pixels (row by row), and for each the region it is in, from 0; pixels that touch at a corner are in one.

    Each two neighbours point to the lesser of their roots, and all pointers are followed at once until none changes: a few
    rounds, whatever a region's shape and size."""
    pixels = np.flatnonzero(over)
    place = np.full(over.size, -1)
    place[pixels] = np.arange(len(pixels))
    place = place.reshape(over.shape)
    pairs = [(place[:, :-1], place[:, 1:]), (place[:-1], place[1:]), (place[:-1, :-1], place[1:, 1:]), (place[:-1, 1:], place[1:, :-1])]
    one, other = (np.concatenate([p[side].ravel() for p in pairs]) for side in (0, 1))
    both = (one >= 0) & (other >= 0)
    one, other = one[both], other[both]
    root = np.arange(len(pixels))
    while True:
        a, b = root[one], root[other]
        apart = a != b
        if not apart.any():
            return pixels, np.unique(root, return_inverse=True)[1]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (next_ := root[root]).tobytes() != root.tobytes():
            root = next_


def detect(image: np.ndarray, sigma: float) -> list[tuple[float, float, float, int]]:
    """(x, y, flux, pixels) of the connected regions over median and deviation, brightest first."""
    middle = float(np.median(image))
    spread = 1.4826 * float(np.median(np.abs(image - middle)))
    pixels, region = regions(image > middle + sigma * spread)
    if not len(pixels):
        return []
    y, x = np.divmod(pixels, image.shape[1])
    w = image.ravel()[pixels] - middle
    flux = np.bincount(region, w)
    rows = zip((np.bincount(region, w * x) / flux).tolist(), (np.bincount(region, w * y) / flux).tolist(), flux.tolist(), np.bincount(region).tolist(), strict=True)
    return sorted(rows, key=lambda s: (-s[2], s[0], s[1]))


def detect_until(image: np.ndarray, target: int, first: float, last: float, step: float) -> tuple[float, list[tuple[float, float, float, int]]]:
    """The threshold that gives at least ``target`` regions, taking it down from ``first`` by steps; else the last one tried."""
    sigma = first
    while True:
        found = detect(image, sigma)
        if len(found) >= target or round(sigma - step, 9) < last:
            return sigma, found
        sigma = round(sigma - step, 9)


def detect_adaptive(frames: DataFrame, height: int, width: int, target: int, first: float = 5.0, last: float = 3.0, step: float = 0.5) -> DataFrame:
    """(frame, star, x, y, flux, pixels, sigma) of ``frames`` (frame, data), by the highest threshold that gives enough stars."""
    ship_package(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for f, d in zip(part["frame"], part["data"], strict=True):
                sigma, found = detect_until(np.asarray(d, float).reshape(height, width), target, first, last, step)
                rows += [(f, k, *s, sigma) for k, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=["frame", "star", "x", "y", "flux", "pixels", "sigma"])

    return frames.mapInPandas(run, "frame bigint, star int, x double, y double, flux double, pixels int, sigma double")


def detect_stars(frames: DataFrame, height: int, width: int, sigma: float) -> DataFrame:
    """(frame, star, x, y, flux, pixels) of ``frames`` (frame, data): a row is a frame, so no shuffle is needed."""
    ship_package(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, k, *s) for f, d in zip(part["frame"], part["data"], strict=True) for k, s in enumerate(detect(np.asarray(d, float).reshape(height, width), sigma))]
            yield pd.DataFrame(rows, columns=["frame", "star", "x", "y", "flux", "pixels"])

    return frames.mapInPandas(run, "frame bigint, star int, x double, y double, flux double, pixels int")


def phase_shifts(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, dy, dx, response) of ``pairs`` (frame, one, other)."""
    ship_package(pairs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, *phase_shift(np.asarray(a, float).reshape(height, width), np.asarray(b, float).reshape(height, width))) for f, a, b in zip(part["frame"], part["one"], part["other"], strict=True)]
            yield pd.DataFrame(rows, columns=["frame", "dy", "dx", "response"])

    return pairs.mapInPandas(run, "frame bigint, dy int, dx int, response double")


def register(matches: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, matches, inliers, rms, a .. ty, area): a similarity for each group of matched points (px, py, qx, qy).

    A group is the matches of one pair of frames, which the detector's limit on stars bounds."""
    ship_package(matches.sparkSession)
    kind = matches.schema[group].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        p, q = part[["px", "py"]].to_numpy(float), part[["qx", "qy"]].to_numpy(float)
        found = ransac(p, q, threshold)
        if found is None:
            return pd.DataFrame({group: [part[group].iloc[0]], "matches": [len(p)], "inliers": [0]}).reindex(columns=columns)
        m, fits = found
        error = np.hypot(*(p[fits] @ m[:, :2].T + m[:, 2] - q[fits]).T)
        return pd.DataFrame([(part[group].iloc[0], len(p), int(fits.sum()), float(np.sqrt((error**2).mean())), m[0, 0], m[0, 1], m[1, 0], m[1, 1], m[0, 2], m[1, 2], hull_area(p[fits]))], columns=columns)

    columns = [group, "matches", "inliers", "rms", "a", "b", "c", "d", "tx", "ty", "area"]
    return matches.groupBy(group).applyInPandas(run, f"{group} {kind}, matches int, inliers int, rms double, a double, b double, c double, d double, tx double, ty double, area double")
