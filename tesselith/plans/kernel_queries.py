"""Queries of the image kernels, over the embeddings as 8 by 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.functions.geometry import Affine
from tesselith.operators import kernels as K
from tesselith.operators.ranking import first_per_group
from tesselith.plans.inputs import pixels, view, with_views
from tesselith.plans.registry import query

_GRID = "g AS (SELECT frame, y, x, x * 0.8e0 - y * 0.6e0 + 2.5e0 AS sx0, x * 0.6e0 + y * 0.8e0 - 0.25e0 AS sy0 FROM pixels), s AS (SELECT frame, y, x, round(sx0, 9) AS sx, round(sy0, 9) AS sy FROM g)"


def _turn() -> Affine:
    return Affine(*(F.lit(v) for v in (0.8, -0.6, 0.6, 0.8, 2.5, -0.25)))


@query(
    "warp_bilinear",
    with_views(
        f"""WITH {_GRID}, n AS (SELECT frame, y, x, floor(sy) + i AS py, floor(sx) + j AS px, (CASE WHEN i = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN j = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS part
            FROM s, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j))
        SELECT n.frame, n.y, n.x, round(sum(part * v), 6) AS v, bool_and(ok) AS ok FROM n JOIN pixels p ON p.frame = n.frame AND p.y = n.py AND p.x = n.px WHERE part > 0 GROUP BY ALL HAVING sum(part) > 1 - 1e-9""",
        "pixels",
    ),
)
def warp_bilinear(spark, sf_dir):
    return K.warp(pixels(spark, sf_dir), ["frame"], _turn(), 8, 8).select("frame", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.round("v", 6).alias("v"), "ok")


@query(
    "warp_nearest",
    with_views(
        f"WITH {_GRID} SELECT s.frame, s.y, s.x, round(v, 6) AS v, ok FROM s JOIN pixels p ON p.frame = s.frame AND p.y = round_even(sy, 0) AND p.x = round_even(sx, 0)",
        "pixels",
    ),
)
def warp_nearest(spark, sf_dir):
    return K.warp(pixels(spark, sf_dir), ["frame"], _turn(), 8, 8, 0).select("frame", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.round("v", 6).alias("v"), "ok")


_NEAR = "JOIN pixels p ON p.frame = o.frame AND abs(p.y - o.y) <= 1 AND abs(p.x - o.x) <= 1"


def _colour_sql(name: str, test: str) -> str:
    w = f"CASE WHEN {test} THEN 1 / pow(2e0, abs(p.y - o.y) + abs(p.x - o.x)) END"
    return f"round(coalesce(max(CASE WHEN {test} AND p.y = o.y AND p.x = o.x THEN p.v END), sum({w} * p.v) / sum({w})), 6) AS {name}"


_RGB = {"r": "(p.y % 2 = 0 AND p.x % 2 = 0)", "g": "(p.y % 2 <> p.x % 2)", "b": "(p.y % 2 = 1 AND p.x % 2 = 1)"}


@query("debayer_bilinear", with_views(f"SELECT o.frame, o.y, o.x, {', '.join(_colour_sql(n, t) for n, t in _RGB.items())} FROM pixels o {_NEAR} GROUP BY ALL", "pixels"))
def debayer_bilinear(spark, sf_dir):
    return K.debayer(pixels(spark, sf_dir), ["frame"], 8, 8).select("frame", "y", "x", *(F.round(c, 6).alias(c) for c in "rgb"))


@query("mask_morphology", with_views(f"SELECT o.frame, o.y, o.x, bool_and(p.ok) AS eroded, bool_or(p.ok) AS dilated FROM pixels o {_NEAR} GROUP BY ALL", "pixels"))
def mask_morphology(spark, sf_dir):
    return K.morphology(pixels(spark, sf_dir), ["frame"], 8, 8)


def _clip_steps() -> str:
    steps, last = [], "s0"
    for i in range(3):
        steps.append(f"c{i} AS (SELECT frame, by_, bx, median(v) AS c, stddev_pop(v) AS d FROM {last} GROUP BY ALL), s{i + 1} AS (SELECT frame, by_, bx, v FROM {last} JOIN c{i} USING (frame, by_, bx) WHERE abs(v - c) <= 1.5 * d OR NOT d > 1e-10)")
        last = f"s{i + 1}"
    return ", ".join(steps)


@query("background_boxes", with_views(f"WITH s0 AS (SELECT frame, y // 4 AS by_, x // 4 AS bx, v FROM pixels WHERE ok), {_clip_steps()} SELECT frame, by_ AS \"by\", bx, round(median(v), 6) AS background FROM s3 GROUP BY ALL", "pixels"))
def background_boxes(spark, sf_dir):
    return K.background(pixels(spark, sf_dir), ["frame"], 4, 1.5).select("frame", "by", "bx", F.round("background", 6).alias("background"))


def _frames(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("data"))


@query("detect_stars")
def detect_stars(spark, sf_dir):
    return K.detect_stars(_frames(spark, sf_dir), 8, 8, 1.5)


@query("phase_shift")
def phase_shift(spark, sf_dir):
    """Each frame against itself moved around by two rows and three columns."""
    data = F.col("data")
    moved = F.transform(data, lambda v, i: F.get(data, F.pmod(F.floor(i / 8) - 2, F.lit(8)) * 8 + F.pmod(i % 8 - 3, F.lit(8))))
    return K.phase_shifts(_frames(spark, sf_dir).select("frame", data.alias("one"), moved.alias("other")), 8, 8)


@query("register_pairs")
def register_pairs(spark, sf_dir):
    """Stars of each frame matched with their places after a small turn, a tenth of them wrong."""
    # A detector keeps so many of a frame's brightest stars, which bounds what one task gets.
    bright = first_per_group(view(spark, sf_dir, "star_frames"), ["frame"], [F.col("flux").desc(), F.col("star")], 250)
    wrong = F.when(F.col("star") % 10 == 0, 35.0).otherwise(0.0)
    return K.register(bright.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") * 0.9998 - F.col("y") * 0.02 + 3 + wrong).alias("qx"), (F.col("x") * 0.02 + F.col("y") * 0.9998 - 5).alias("qy")), "frame", 3.0)
