"""Queries of detection, mosaics and colours: 64 embeddings in a row make a frame of 64 by 64."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.operators import colour_session, demosaic, detection, tiles
from tesselith.plans.registry import query
from tesselith.staging import shared_folder

SIDE = 64


def _frames(spark, sf_dir):
    """(frame, data) of whole frames; codes around 30,000. A frame's rows are embeddings by vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / SIDE).alias("frame"), (F.col("vec_id") % SIDE).alias("y"), "embedding")
    whole = rows.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "embedding"))).alias("rows")).where(F.size("rows") == SIDE)  # 64 rows each
    return whole.select("frame", F.transform(F.flatten(F.transform("rows", lambda r: r["embedding"])), lambda v: 30000 + 40000 * v.cast("double")).alias("data"))


def _pixels(out, names):
    """One row for each pixel of tiles."""
    each = out.select("frame", "y0", "x0", "w", F.posexplode(F.arrays_zip(*names)).alias("i", "p"))
    return each.select("frame", (F.col("y0") + F.expr("i div w")).cast("bigint").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("bigint").alias("x"), *(F.round(F.col("p")[n], 3).alias(n) for n in names))


def _kernel(k) -> str:
    """A filter's sum at (y, x) of the frame's codes m, as SQL over the joined neighbours."""
    weights = ", ".join(f"({i - 2}, {j - 2}, {float(k[i][j])}::DOUBLE)" for i in range(5) for j in range(5) if k[i][j])
    return f"(SELECT * FROM (VALUES {weights}) AS v(i, j, k))"


_FOLD = lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {SIDE} THEN {2 * SIDE - 1} - ({c}) ELSE {c} END"
_FILTERS = {"green": demosaic.GREEN, "along": demosaic.ALONG, "down": demosaic.ALONG.T, "across": demosaic.ACROSS}
_MALVAR = f"""
WITH m AS (SELECT vec_id // {SIDE} AS frame, vec_id % {SIDE} AS y, unnest(range({SIDE})) AS x, least(greatest(30000 + 40000 * CAST(unnest(embedding) AS DOUBLE), 0), 65535) AS v FROM embeddings
           WHERE vec_id // {SIDE} IN (SELECT vec_id // {SIDE} FROM embeddings GROUP BY 1 HAVING count(*) = {SIDE})),
k AS ({" UNION ALL ".join(f"SELECT '{name}' AS name, * FROM {_kernel(kernel)}" for name, kernel in _FILTERS.items())}),
n AS (SELECT frame, y, x, name, k, {_FOLD("y + i")} AS ny, {_FOLD("x + j")} AS nx FROM (SELECT DISTINCT frame, y, x FROM m), k),
f AS (SELECT n.frame, n.y, n.x, least(greatest(sum(k * v) FILTER (name = 'green'), 0), 65535) AS green, least(greatest(sum(k * v) FILTER (name = 'along'), 0), 65535) AS along,
             least(greatest(sum(k * v) FILTER (name = 'down'), 0), 65535) AS down, least(greatest(sum(k * v) FILTER (name = 'across'), 0), 65535) AS across
      FROM n JOIN m ON n.frame = m.frame AND n.ny = m.y AND n.nx = m.x GROUP BY n.frame, n.y, n.x)
SELECT m.frame, m.y, m.x,
       round(CASE WHEN m.y % 2 = 0 AND m.x % 2 = 0 THEN v WHEN m.y % 2 = 1 AND m.x % 2 = 1 THEN across WHEN m.y % 2 = 0 THEN along ELSE down END, 3) AS red,
       round(CASE WHEN m.y % 2 = m.x % 2 THEN green ELSE v END, 3) AS green,
       round(CASE WHEN m.y % 2 = 1 AND m.x % 2 = 1 THEN v WHEN m.y % 2 = 0 AND m.x % 2 = 0 THEN across WHEN m.y % 2 = 1 THEN along ELSE down END, 3) AS blue
FROM m JOIN f ON m.frame = f.frame AND m.y = f.y AND m.x = f.x
"""


def _demosaiced(spark, sf_dir, method):
    cut = tiles.cut(_frames(spark, sf_dir), ["frame"], SIDE, SIDE, 32)
    return _pixels(demosaic.demosaic(cut, ["frame"], 32, "RGGB", method), ["red", "green", "blue"])


@query("demosaic_malvar", _MALVAR)
def demosaic_malvar(spark, sf_dir):
    return _demosaiced(spark, sf_dir, "malvar")


@query("demosaic_menon")
def demosaic_menon(spark, sf_dir):
    return _demosaiced(spark, sf_dir, "menon")


@query("detect_matched")
def detect_matched(spark, sf_dir):
    """Peaks of two pixels' width over three sigmas, from a threshold of six down."""
    return detection.find_stars(_frames(spark, sf_dir), SIDE, SIDE, detection.Finder(fwhm=2.0), 6.0, 3.0, 0.5, 20)


@query("register_colours")
def register_colours(spark, sf_dir):
    """The frame after each one for its red, itself for its blue."""
    frames = _frames(spark, sf_dir)
    after = frames.select((F.col("frame") - 1).alias("frame"), F.col("data").alias("red"))
    return detection.register_colours(frames.join(after, "frame", "left").select("frame", "red", F.col("data").alias("green"), F.col("data").alias("blue")), SIDE, SIDE)


@query("colour_sessions")
def colour_sessions(spark, sf_dir):
    """A model for the even and one for the odd frames, trained once; the second run finds them."""
    frames = _frames(spark, sf_dir)
    after = frames.select((F.col("frame") - 1).alias("frame"), F.col("data").alias("red"))
    rows = frames.join(after, "frame", "left").select(
        F.concat(F.lit("session_"), F.col("frame") % 2).alias("session"), F.col("frame").cast("string").alias("path"), F.size("data").cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modified"),
        "frame", F.coalesce("red", "data").alias("red"), F.col("data").alias("green"), F.col("data").alias("blue"),
    )
    root = shared_folder(spark)
    colour_session.session_models(spark, root, rows, SIDE, SIDE, "r1")
    models, _ = colour_session.session_models(spark, root, rows, SIDE, SIDE, "r1")
    return models.drop("fingerprint")
