"""Kernels over neighbouring pixels, on frames cut into tiles that lend each other their margins.

A tile is a row: keys of its frame, y0, x0, h, w and ``data`` (its pixels in a row). Tiles stand on a grid of one size, those at the
right and lower edge of a frame may be smaller. Each sends a strip of its edge to each of its eight neighbours; strips meet with the tile's
own row by its place, once, and the kernel then runs on the tile and its margins in one task. So pixels move as arrays, about once, and a frame
is never held whole, however large it is. At the frame's own edges there is no margin, and the kernel goes on there as it does at an image's edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.session import ship_package

#: The kernel: pixels with margins and the place (y, x) of the first one in the frame, to as many images of the same size.
Kernel = Callable[[np.ndarray, int, int], list[np.ndarray]]


def _strips(keys: list[str], size: int, margin: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                y0, x0, h, w = (batch.column(c)[r].as_py() for c in ("y0", "x0", "h", "w"))
                image = np.asarray(batch.column("data")[r].values, float).reshape(h, w)
                out = []
                for down in (-1, 0, 1):
                    for right in (-1, 0, 1):
                        ty, tx = y0 + down * size, x0 + right * size
                        if ty < 0 or tx < 0:
                            continue
                        top, left = max(y0, ty - margin), max(x0, tx - margin)
                        bottom, end = min(y0 + h, ty + size + margin), min(x0 + w, tx + size + margin)
                        if bottom > top and end > left:
                            out.append((ty, tx, top, left, bottom - top, end - left, image[top - y0 : bottom - y0, left - x0 : end - x0].ravel()))
                own = [batch.column(k).slice(r, 1).take(pa.array([0] * len(out))) for k in keys]
                ints = [pa.array([o[i] for o in out], pa.int32()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*own, *ints, pa.array([o[6] for o in out], pa.list_(pa.float64()))], names=[*keys, "ty", "tx", "top", "left", "height", "width", "part"])

    return run


def _apply(keys: list[str], kernel: Kernel, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                parts = batch.column("parts")[r].as_py()
                ty, tx = batch.column("ty")[r].as_py(), batch.column("tx")[r].as_py()
                own = next((p for p in parts if p["own"]), None)
                if own is None:  # only strips of neighbours fall here: the frame has no such tile
                    continue
                top, left = min(p["top"] for p in parts), min(p["left"] for p in parts)
                bottom, end = max(p["top"] + p["height"] for p in parts), max(p["left"] + p["width"] for p in parts)
                whole = np.full((bottom - top, end - left), np.nan)
                for p in parts:
                    whole[p["top"] - top : p["top"] - top + p["height"], p["left"] - left : p["left"] - left + p["width"]] = np.reshape(p["part"], (p["height"], p["width"]))
                h, w = own["height"], own["width"]
                made = [image[ty - top : ty - top + h, tx - left : tx - left + w].ravel() for image in kernel(whole, top, left)]
                ints = [pa.array([v], pa.int32()) for v in (ty, tx, h, w)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(r, 1) for k in keys), *ints, *(pa.array([m], pa.list_(pa.float64())) for m in made)], names=[*keys, "y0", "x0", "h", "w", *names])

    return run


def stencil(tiles: DataFrame, keys: list[str], size: int, margin: int, kernel: Kernel, names: list[str]) -> DataFrame:
    """(keys, y0, x0, h, w, names): the kernel's images for each tile, with ``margin`` pixels around it known where the frame has them.

    ``size``: of the grid of tiles, at least the margin. A frame with a tile missing has no numbers there (NaN)."""
    if margin > size:
        raise ValueError("a margin reaches the next tile only")
    ship_package(tiles.sparkSession)
    kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys)
    rows = tiles.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("y0", "x0", "h", "w")), F.col("data").cast("array<double>").alias("data"))
    strips = rows.mapInArrow(_strips(keys, size, margin), f"{kinds}, ty int, tx int, top int, left int, height int, width int, part array<double>")
    own = (F.col("top") == F.col("ty")) & (F.col("left") == F.col("tx"))
    # Nine parts at most: the tile and a strip of each neighbour.
    parts = strips.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("top", "left", "height", "width", own.alias("own"), "part")).alias("parts"))
    return parts.mapInArrow(_apply(keys, kernel, names), f"{kinds}, y0 int, x0 int, h int, w int, {', '.join(f'{n} array<double>' for n in names)}")


def cut(frames: DataFrame, keys: list[str], height: int, width: int, size: int) -> DataFrame:
    """Tiles of frames that are rows with ``data`` of height x width numbers."""
    ys, xs = range(0, height, size), range(0, width, size)
    places = F.array(*(F.struct(F.lit(y).alias("y0"), F.lit(x).alias("x0"), F.lit(min(size, height - y)).alias("h"), F.lit(min(size, width - x)).alias("w")) for y in ys for x in xs))
    rows = frames.select(*keys, F.col("data").cast("array<double>").alias("whole"), F.explode(places).alias("t")).select(*keys, "t.*", "whole")
    data = F.flatten(F.transform(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1), lambda y: F.slice("whole", y * width + F.col("x0") + 1, F.col("w"))))
    return rows.select(*keys, "y0", "x0", "h", "w", data.alias("data"))
