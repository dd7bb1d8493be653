"""Stars by a matched filter, and what colours' stars say about each other.

The filter is a Gaussian of the expected width less its mean, so that a level background gives nothing (Stetson 1987). Its local maxima over a
threshold are candidates; their sharpness tells stars from hot pixels and extended things, two measures of roundness from trails and
columns. Places come from fits of the filter's profile to the sums along rows and columns. The filter's response doesn't depend on the
threshold, so thresholds that are lowered until there are enough stars choose from one list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesselith.operators.kernels import ransac, sub_pixel_shift
from tesselith.session import ship_package

#: Standard deviations in a full width at half maximum, the other way round.
SIGMAS = 1 / 2.3548200450309493
STARS = "frame bigint, star int, x double, y double, flux double, sharpness double, roundness double, symmetry double, sigma double, width double"


@dataclass(frozen=True)
class Finder:
    """What counts as a star. ``apart``: of two stars nearer than this many widths the fainter one goes."""

    fwhm: float = 4.0
    sharpness: tuple[float, float] = (0.2, 1.0)
    roundness: tuple[float, float] = (-1.0, 1.0)
    reach: float = 1.5
    apart: float = 1.5
    most: int = 250


def background(image: np.ndarray, sigma: float = 3.0, rounds: int = 5) -> tuple[float, float]:
    """Median and deviation of the numbers, without those far from the median."""
    values = image[np.isfinite(image)]
    for _ in range(rounds):
        if not len(values):
            break
        middle, spread = np.median(values), values.std()
        kept = values[np.abs(values - middle) <= sigma * spread]
        if len(kept) == len(values):
            break
        values = kept
    return (float(np.median(values)), float(values.std())) if len(values) else (float("nan"), float("nan"))


class Filter:
    def __init__(self, finder: Finder) -> None:
        sigma = finder.fwhm * SIGMAS
        self.radius = max(2, int(finder.reach * sigma))
        step = np.arange(-self.radius, self.radius + 1)
        square = step[:, None] ** 2 + step[None, :] ** 2
        self.inside = (square <= (finder.reach * sigma) ** 2) | (square <= 4)
        shape = np.exp(-square / (2 * sigma**2))
        part, n = shape[self.inside], int(self.inside.sum())
        spread = (part**2).sum() - part.sum() ** 2 / n
        self.kernel = np.where(self.inside, (shape - part.sum() / n) / spread, 0.0)
        #: The deviation of the response to noise of deviation 1.
        self.error = 1 / np.sqrt(spread)
        # A profile, its slope and a level are fitted to sums along an axis, the middle counting most.
        line = np.exp(-(step**2) / (2 * sigma**2))
        weight = (self.radius + 1 - np.abs(step)).astype(float)
        across = (weight * line).sum()
        model = np.stack([line * across, line * step / sigma**2 * across, np.full(len(step), weight.sum())], axis=1)
        root = np.sqrt(weight)
        self.fit, self.weight = np.linalg.pinv(model * root[:, None]) * root, weight

    def response(self, image: np.ndarray) -> np.ndarray:
        """The filter at each pixel; there is nothing beyond the edge."""
        shape = [n + 2 * self.radius for n in image.shape]
        product = np.fft.rfft2(np.pad(image, self.radius), shape) * np.fft.rfft2(self.kernel, shape).conj()
        return np.fft.irfft2(product, shape)[: image.shape[0], : image.shape[1]]


def candidates(image: np.ndarray, finder: Finder, lowest: float) -> tuple[np.ndarray, float]:
    """(x, y, flux, sharpness, roundness, symmetry, peak in deviations of the response to noise) of all maxima from ``lowest`` sigmas on that pass the limits; the background's deviation."""
    level, noise = background(image)
    if not np.isfinite(noise) or noise <= 0:
        return np.zeros((0, 7)), 0.0
    found = Filter(finder)
    r = found.radius
    data = np.where(np.isfinite(image), image - level, 0.0)
    surface = found.response(data)
    padded = np.pad(surface, r, constant_values=-np.inf)
    highest = np.full(surface.shape, -np.inf)
    for i, j in np.argwhere(found.inside):
        np.maximum(highest, padded[i : i + surface.shape[0], j : j + surface.shape[1]], out=highest)
    ys, xs = np.nonzero((surface == highest) & (surface >= lowest * noise * found.error))
    whole = (ys >= r) & (xs >= r) & (ys < image.shape[0] - r) & (xs < image.shape[1] - r)
    ys, xs = ys[whole], xs[whole]
    if not len(ys):
        return np.zeros((0, 7)), noise
    step = np.arange(-r, r + 1)
    box = (ys[:, None, None] + step[None, :, None], xs[:, None, None] + step[None, None, :])
    stamps, responses = data[box], surface[box]
    peak, response = stamps[:, r, r], responses[:, r, r]
    others = found.inside.copy()
    others[r, r] = False
    sharpness = (peak - stamps[:, others].mean(axis=1)) / response
    # Four quadrants of the response, each with one of the half axes.
    quarter = np.zeros((2 * r + 1, 2 * r + 1))
    quarter[: r + 1, r + 1 :] = -1
    quarter[:r, : r + 1] = 1
    quarter[r:, :r] = -1
    quarter[r + 1 :, r:] = 1
    quarter[r, r] = 0
    two, four = (responses * quarter).sum(axis=(1, 2)), np.abs(np.where(quarter == 0, 0.0, responses)).sum(axis=(1, 2))
    symmetry = np.divide(2 * two, four, out=np.zeros_like(two), where=four > 0)
    fits = [np.einsum("nij,j->ni", stamps if axis == 0 else stamps.transpose(0, 2, 1), found.weight) @ found.fit.T for axis in (0, 1)]
    heights = [f[:, 0] for f in fits]
    shifts = [np.divide(f[:, 1], f[:, 0], out=np.full(len(f), np.inf), where=f[:, 0] > 0) for f in fits]
    roundness = np.divide(2 * (heights[1] - heights[0]), heights[0] + heights[1], out=np.full(len(ys), np.inf), where=(heights[0] > 0) & (heights[1] > 0))
    flux = stamps[:, found.inside].sum(axis=1)
    good = (sharpness >= finder.sharpness[0]) & (sharpness <= finder.sharpness[1]) & (np.abs(shifts[0]) <= r) & (np.abs(shifts[1]) <= r)
    for measure in (roundness, symmetry):
        good &= (measure >= finder.roundness[0]) & (measure <= finder.roundness[1])
    rows = np.column_stack([xs + shifts[1], ys + shifts[0], flux, sharpness, roundness, symmetry, response / (noise * found.error)])
    return rows[good], noise


def thinned(stars: np.ndarray, apart: float, most: int) -> np.ndarray:
    """Brightest first, no two nearer than ``apart``, ``most`` at most."""
    stars = stars[np.lexsort((stars[:, 1], stars[:, 0], -stars[:, 2]))]
    cells: dict[tuple[int, int], list[np.ndarray]] = {}
    out = []
    for star in stars:
        cy, cx = int(star[1] // apart), int(star[0] // apart)
        near = (s for i in (-1, 0, 1) for j in (-1, 0, 1) for s in cells.get((cy + i, cx + j), ()))
        if all(np.hypot(*(s[:2] - star[:2])) >= apart for s in near):
            cells.setdefault((cy, cx), []).append(star)
            out.append(star)
            if len(out) == most:
                break
    return np.array(out).reshape(-1, stars.shape[1])


def find(image: np.ndarray, finder: Finder, first: float = 5.0, last: float = 3.0, step: float = 0.5, enough: int = 20) -> tuple[float, np.ndarray]:
    """The highest threshold, from ``first`` down to ``last``, that gives enough stars (else the last one), and the stars."""
    every, _ = candidates(image, finder, min(first, last))
    sigma = first
    while True:
        stars = thinned(every[every[:, 6] >= sigma], finder.apart * finder.fwhm, finder.most)
        if len(stars) >= enough or round(sigma - step, 9) < last:
            return sigma, stars
        sigma = round(sigma - step, 9)


def find_stars(frames: DataFrame, height: int, width: int, finder: Finder, first: float = 5.0, last: float = 3.0, step: float = 0.5, enough: int = 20) -> DataFrame:
    """STARS of ``frames`` (frame, data): a row is a frame, so no shuffle is needed. ``width``: the stars' width, by the median sharpness of the frame.

    A frame without numbers, or a level one, has no stars; null data is no frame."""
    ship_package(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for frame, data in zip(part["frame"], part["data"], strict=True):
                if data is not None:
                    sigma, stars = find(np.asarray(data, float).reshape(height, width), finder, first, last, step, enough)
                    broad = float(np.median(stars[:, 3])) * finder.fwhm if len(stars) else 0.0
                    rows += [(frame, k, *map(float, s[:6]), sigma, broad) for k, s in enumerate(stars)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in STARS.split(", ")])

    return frames.select("frame", "data").mapInPandas(run, STARS)


# --- Colours


def centroid(image: np.ndarray, x: int, y: int, radius: int = 4) -> tuple[float, float] | None:
    """The centre of light over the level of the frame's edge, or none at the image's edge, on hot pixels and where nothing stands out."""
    if min(x, y) < radius or x + radius >= image.shape[1] or y + radius >= image.shape[0]:
        return None
    box = image[y - radius : y + radius + 1, x - radius : x + radius + 1]
    number = np.isfinite(box)
    edge = np.concatenate([box[0], box[-1], box[:, 0], box[:, -1]])
    edge = edge[np.isfinite(edge)]
    if number.sum() < max(9, box.size // 2) or len(edge) < 4:
        return None
    light = np.maximum(np.where(number, box - np.median(edge), 0.0), 0.0)
    total = float(light.sum())
    if total <= 0 or float(light.max()) / total > 0.88:
        return None
    step = np.arange(-radius, radius + 1)
    return x + float((light * step).sum() / total), y + float((light * step[:, None]).sum() / total)


def footprint(m: np.ndarray, height: int, width: int) -> float:
    """How far a transform moves the corners at most."""
    corners = np.array([[0, 0], [width - 1, 0], [0, height - 1], [width - 1, height - 1]], float)
    return float(np.hypot(*(corners @ m[:, :2].T + m[:, 2] - corners).T).max())


def colour_similarity(reference: np.ndarray, colour: np.ndarray, max_shift: float = 2.0, points: int = 96) -> tuple[np.ndarray, float] | None:
    """The small similarity that takes a colour's stars to the reference's, and the share of stars that agree; none where they don't, or it isn't small."""
    if np.count_nonzero(np.isfinite(reference) & np.isfinite(colour)) < 64:
        return None
    _, stars = find(np.where(np.isfinite(reference), reference, 0.0), Finder(fwhm=3.0, sharpness=(0.1, 1.2), apart=6.0, most=points), 8.0, 4.0, 2.0, points)
    pairs = []
    for x, y in np.rint(stars[:, :2]).astype(int):
        r, c = centroid(reference, x, y), centroid(colour, x, y)
        if r and c and np.hypot(c[0] - r[0], c[1] - r[1]) <= max(4.0, 3 * max_shift):
            pairs.append((*c, *r))
    if len(pairs) < 6:
        return None
    p, q = np.array(pairs)[:, :2], np.array(pairs)[:, 2:]
    found = ransac(p, q, 1.5)
    if found is None or found[1].sum() < 5:
        return None
    m, fits = found
    error = np.hypot(*(p @ m[:, :2].T + m[:, 2] - q).T)
    middle = (np.array(reference.shape[::-1]) - 1) / 2
    if np.median(error[fits]) > 1.25 or np.hypot(*(m[:, :2] @ middle + m[:, 2] - middle)) > max(0.5, max_shift) or footprint(m, *reference.shape) > max_shift:
        return None
    return m, float(fits.mean())


def colour_transform(reference: np.ndarray, colour: np.ndarray, max_shift: float = 2.0, model: np.ndarray | None = None) -> tuple[str, np.ndarray, float]:
    """How a colour is brought onto the reference: by the session's model where it is small on this frame, by its own stars, by a shift alone, or not at all."""
    if model is not None and np.isfinite(model).all() and footprint(model, *reference.shape) <= max_shift:
        return "session", model, 1.0
    found = colour_similarity(reference, colour, max_shift)
    if found:
        return "similarity", *found
    dy, dx, response = sub_pixel_shift(*(np.where(np.isfinite(i), i, 0.0) for i in (colour, reference)))
    if response >= 0.15 and np.hypot(dx, dy) <= max_shift:
        return "shift", np.array([[1, 0, dx], [0, 1, dy]], float), response
    return "none", np.array([[1, 0, 0], [0, 1, 0]], float), response


COLOURS = "frame bigint, colour string, method string, a double, b double, c double, d double, tx double, ty double, confidence double"


def register_colours(frames: DataFrame, height: int, width: int, max_shift: float = 2.0, models: dict[str, list[float]] | None = None) -> DataFrame:
    """COLOURS of ``frames`` (frame, red, green, blue): red and blue onto green. ``models``: a .. ty by colour, of the session. A frame that lacks a colour has no row for it."""
    ship_package(frames.sparkSession)
    known = {c: np.array([[m[0], m[1], m[4]], [m[2], m[3], m[5]]]) for c, m in (models or {}).items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples():
                for colour in ("red", "blue"):
                    if row.green is not None and getattr(row, colour) is not None:
                        green, other = (np.asarray(i, float).reshape(height, width) for i in (row.green, getattr(row, colour)))
                        method, m, confidence = colour_transform(green, other, max_shift, known.get(colour))
                        rows.append((row.frame, colour, method, m[0, 0], m[0, 1], m[1, 0], m[1, 1], m[0, 2], m[1, 2], confidence))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in COLOURS.split(", ")])

    return frames.select("frame", "red", "green", "blue").mapInPandas(run, COLOURS)
