"""Colours from a mosaic of red, green and blue pixels: linear filters corrected by gradients, and directional ones.

``malvar`` is the method of Malvar, He and Cutler (2004): each missing colour is a 5 x 5 filter over all colours. ``menon`` is that of Menon, Andriani and
Calvagno (2007): green is interpolated along rows and along columns, the direction in which colour differences change less is taken, and red and blue
follow the differences in that direction, in two passes. ``bilinear`` takes the mean of the nearest pixels of a colour.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tesselith.operators.tiles import stencil

PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
#: How far a method looks, which is the margin that tiles need.
REACH = {"bilinear": 2, "malvar": 2, "menon": 14}

# The filters of the published method, in eighths.
GREEN = np.array([[0, 0, -1, 0, 0], [0, 0, 2, 0, 0], [-1, 2, 4, 2, -1], [0, 0, 2, 0, 0], [0, 0, -1, 0, 0]]) / 8
ALONG = np.array([[0, 0, 0.5, 0, 0], [0, -1, 0, -1, 0], [-1, 4, 5, 4, -1], [0, -1, 0, -1, 0], [0, 0, 0.5, 0, 0]]) / 8
ACROSS = np.array([[0, 0, -1.5, 0, 0], [0, 2, 0, 2, 0], [-1.5, 0, 6, 0, -1.5], [0, 2, 0, 2, 0], [0, 0, -1.5, 0, 0]]) / 8


def filtered(image: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """The sum over the kernel's place, for symmetric kernels; ``mode`` as of ``numpy.pad``."""
    kernel = np.atleast_2d(kernel)
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(image, ((ry, ry), (rx, rx)), mode)
    out = np.zeros(image.shape)
    for i, j in np.argwhere(kernel):
        out += kernel[i, j] * padded[i : i + image.shape[0], j : j + image.shape[1]]
    return out


def places(shape: tuple[int, int], pattern: str, y: int = 0, x: int = 0) -> dict[str, np.ndarray]:
    """Where each colour's pixels are, in an image whose first pixel is (y, x) of the mosaic."""
    if pattern not in PATTERNS:
        raise ValueError(f"{pattern} is no mosaic")
    at = (np.add.outer(2 * ((np.arange(shape[0]) + y) % 2), (np.arange(shape[1]) + x) % 2)).astype(int)
    return {c: np.isin(at, [i for i, p in enumerate(pattern) if p == c]) for c in "RGB"}


def bilinear(mosaic: np.ndarray, pattern: str, y: int = 0, x: int = 0) -> list[np.ndarray]:
    around = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) / 4
    cross = np.array([[0, 1, 0], [1, 4, 1], [0, 1, 0]]) / 4
    out = []
    for c, own in places(mosaic.shape, pattern, y, x).items():
        kernel = cross if c == "G" else around
        out.append(filtered(np.where(own, mosaic, 0.0), kernel, "symmetric") / filtered(own.astype(float), kernel, "symmetric"))
    return out


def malvar(mosaic: np.ndarray, pattern: str, y: int = 0, x: int = 0) -> list[np.ndarray]:
    at = places(mosaic.shape, pattern, y, x)
    green, along, down, across = (filtered(mosaic, k, "symmetric") for k in (GREEN, ALONG, ALONG.T, ACROSS))
    rows = {c: at[c].any(axis=1)[:, None] for c in "RB"}  # rows that hold a colour
    out = {"G": np.where(at["G"], mosaic, green)}
    for c, other in (("R", "B"), ("B", "R")):
        out[c] = np.where(at[c], mosaic, np.where(at[other], across, np.where(rows[c], along, down)))
    return [out[c] for c in "RGB"]


def menon(mosaic: np.ndarray, pattern: str, y: int = 0, x: int = 0) -> list[np.ndarray]:
    at = places(mosaic.shape, pattern, y, x)
    row = {c: at[c].any(axis=1)[:, None] for c in "RB"}
    column = {c: at[c].any(axis=0)[None, :] for c in "RB"}
    level = lambda image, k: filtered(image, np.array([k]), "reflect")
    upright = lambda image, k: filtered(image, np.array([k]).T, "reflect")
    near, mean3 = (0.5, 0, 0.5), (1 / 3, 1 / 3, 1 / 3)
    fine = (-0.25, 0.5, 0.5, 0.5, -0.25)

    # Green both ways, and the change of colour differences around each pixel.
    ways = [np.where(at["G"], mosaic, f(mosaic, fine)) for f in (level, upright)]
    differences = [np.where(at["G"], 0.0, mosaic - g) for g in ways]
    change = [
        np.abs(differences[0] - np.pad(differences[0], ((0, 0), (0, 2)), "reflect")[:, 2:]),
        np.abs(differences[1] - np.pad(differences[1], ((0, 2), (0, 0)), "reflect")[2:, :]),
    ]
    weigh = np.array([[1, 0, 1, 0, 0], [0, 1, 0, 0, 0], [3, 0, 3, 0, 0], [0, 1, 0, 0, 0], [1, 0, 1, 0, 0]])
    total = [_sum(change[0], weigh), _sum(change[1], weigh.T)]
    flat = total[1] >= total[0]  # along the row
    turned = lambda image, k: np.where(flat, level(image, k), upright(image, k))

    out = {"G": np.where(flat, *ways)} | {c: np.where(at[c], mosaic, 0.0) for c in "RB"}
    for c in "RB":  # beside green ones first
        out[c] = np.where(at["G"] & row[c], out["G"] + level(out[c], near) - level(out["G"], near), out[c])
        out[c] = np.where(at["G"] & ~row[c], out["G"] + upright(out[c], near) - upright(out["G"], near), out[c])
    for c, other in (("R", "B"), ("B", "R")):  # then at those of the other colour
        out[c] = np.where(at[other], mosaic + turned(out[c], near) - turned(out[other], near), out[c])

    # Again, with differences smoothed in the direction taken.
    smooth = {c: turned(out[c] - out["G"], mean3) for c in "RB"}
    for c in "RB":
        out["G"] = np.where(at[c], out[c] - smooth[c], out["G"])
    for c in "RB":
        d = out[c] - out["G"]
        beside = np.where(column[c], upright(d, near), level(d, near))
        out[c] = np.where(at["G"], out["G"] + beside, out[c])
    smooth = turned(out["R"] - out["B"], mean3)
    red, blue = np.where(at["B"], out["B"] + smooth, out["R"]), np.where(at["R"], out["R"] - smooth, out["B"])
    return [red, out["G"], blue]


def _sum(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The weighted sum over the kernel's place; nothing beyond the edge."""
    padded = np.pad(image, 2)
    return sum(kernel[i, j] * padded[i : i + image.shape[0], j : j + image.shape[1]] for i, j in np.argwhere(kernel))


METHODS = {"bilinear": bilinear, "malvar": malvar, "menon": menon}


def demosaic(tiles: DataFrame, keys: list[str], size: int, pattern: str, method: str = "malvar") -> DataFrame:
    """(keys, y0, x0, h, w, red, green, blue) of tiles of a mosaic of codes from 0 to 65535, in the same range.

    Codes beyond are cut off, before and after, and what is no number counts as 0. An unknown pattern or method is an error."""
    if pattern not in PATTERNS or method not in METHODS:
        raise ValueError(f"{method} of {pattern}")
    made = METHODS[method]

    def kernel(whole: np.ndarray, top: int, left: int) -> list[np.ndarray]:
        scaled = np.clip(np.nan_to_num(whole, nan=0.0), 0, 65535) / 65535
        return [np.clip(c, 0.0, 1.0) * 65535 for c in made(scaled, pattern, top, left)]

    return stencil(tiles, keys, size, REACH[method], kernel, ["red", "green", "blue"])
