"""Queries of the pixel reductions, over the embeddings as a stack of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.operators import stacking as S
from tesselith.plans.inputs import pixels, with_views
from tesselith.plans.registry import query

KEYS = ["batch", "pos"]
_GUARD = "(n < 4 OR NOT coalesce(spread > 1e-10, false) OR s BETWEEN centre - 3 * spread AND centre + 3 * spread)"
_S = "s AS (SELECT frame, batch, pos, y, x, v, CASE WHEN ok THEN v END AS s FROM pixels)"


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


for _method, _sql in {"mean": "avg(s)", "sum": "sum(s)", "max": "max(s)", "min": "min(s)", "median": "median(s)"}.items():

    def _combine(spark, sf_dir, method=_method):
        return _rounded(S.combine(pixels(spark, sf_dir), KEYS, method), "value")

    query(f"stack_{_method}", with_views(f"WITH {_S} SELECT batch, pos, round(coalesce({_sql}, 0), 6) AS value, count(s) AS n FROM s GROUP BY ALL", "pixels"))(_combine)


@query(
    "reject_sigma",
    with_views(
        f"""WITH {_S}, c AS (SELECT batch, pos, median(s) AS centre, stddev_pop(s) AS spread, count(s) AS n FROM s GROUP BY ALL)
        SELECT batch, pos, round(median(s), 6) AS value, count(s) AS n FROM s JOIN c USING (batch, pos) WHERE s IS NOT NULL AND {_GUARD} GROUP BY ALL""",
        "pixels",
    ),
)
def reject_sigma(spark, sf_dir):
    return _rounded(S.reject(pixels(spark, sf_dir), KEYS, S.Rejection("sigma")), "value")


@query(
    "reject_mad",
    with_views(
        f"""WITH {_S}, c AS (SELECT batch, pos, median(s) AS centre, count(s) AS n FROM s GROUP BY ALL),
        d AS (SELECT batch, pos, 1.4826e0 * median(abs(s - centre)) AS spread FROM s JOIN c USING (batch, pos) GROUP BY ALL)
        SELECT batch, pos, round(median(s), 6) AS value, count(s) AS n FROM s JOIN c USING (batch, pos) JOIN d USING (batch, pos) WHERE s IS NOT NULL AND {_GUARD} GROUP BY ALL""",
        "pixels",
    ),
)
def reject_mad(spark, sf_dir):
    return _rounded(S.reject(pixels(spark, sf_dir), KEYS, S.Rejection("mad")), "value")


@query(
    "reject_winsor",
    with_views(
        f"""WITH {_S}, c AS (SELECT batch, pos, quantile_cont(s, 0.2) AS lo, quantile_cont(s, 0.8) AS hi FROM s GROUP BY ALL)
        SELECT batch, pos, round(median(least(greatest(s, lo), hi)), 6) AS value, round(avg(least(greatest(s, lo), hi)), 6) AS mean FROM s JOIN c USING (batch, pos) WHERE s IS NOT NULL GROUP BY ALL""",
        "pixels",
    ),
)
def reject_winsor(spark, sf_dir):
    kept = S.clipped(pixels(spark, sf_dir), KEYS, S.Rejection("winsor", 2.0, 2.0))
    return kept.groupBy(*KEYS).agg(F.round(F.median("kept"), 6).alias("value"), F.round(F.avg("kept"), 6).alias("mean"))


@query(
    "reject_small_n",
    with_views(
        """WITH s AS (SELECT frame // 5 AS night, pos, CASE WHEN ok THEN v END AS s FROM pixels),
        c AS (SELECT night, pos, median(s) AS centre, stddev_pop(s) AS spread, count(s) AS n FROM s GROUP BY ALL)
        SELECT night, pos, round(CASE WHEN n < 4 THEN avg(s) ELSE median(CASE WHEN NOT coalesce(spread > 1e-10, false) OR s BETWEEN centre - 1.5 * spread AND centre + 1.5 * spread THEN s END) END, 6) AS value, n
        FROM s JOIN c USING (night, pos) WHERE s IS NOT NULL GROUP BY night, pos, n""",
        "pixels",
    ),
)
def reject_small_n(spark, sf_dir):
    stack = pixels(spark, sf_dir).withColumn("night", F.expr("frame div 5"))
    return _rounded(S.reject_or_combine(stack, ["night", "pos"], S.Rejection("sigma", 1.5, 1.5), "mean"), "value")


_W = "least(greatest((frame % 9) / 4e0, 0), 2)"


@query(
    "stack_qwm",
    with_views(
        f"""WITH {_S}, c AS (SELECT batch, pos, median(s) AS centre, stddev_pop(s) AS spread, count(s) AS n FROM s GROUP BY ALL)
        SELECT batch, pos, round(coalesce(sum({_W} * s) / nullif(sum({_W}), 0), 0), 6) AS value, round(coalesce(sum({_W}), 0), 6) AS weight
        FROM s JOIN c USING (batch, pos) WHERE s IS NOT NULL AND {_GUARD} GROUP BY ALL""",
        "pixels",
    ),
)
def stack_qwm(spark, sf_dir):
    return _rounded(S.weighted_mean(pixels(spark, sf_dir), KEYS, (F.col("frame") % 9) / 4.0, S.Rejection("sigma")), "value", "weight")


@query(
    "merge_qwm",
    with_views(
        f"""WITH {_S}, part AS (SELECT batch, pos, coalesce(sum({_W} * s) / nullif(sum(CASE WHEN s IS NOT NULL THEN {_W} END), 0), 0) AS v, coalesce(sum(CASE WHEN s IS NOT NULL THEN {_W} END), 0) AS w FROM s GROUP BY ALL)
        SELECT pos, round(coalesce(sum(v * w) / nullif(sum(w), 0), 0), 6) AS value, round(sum(w), 6) AS weight FROM part GROUP BY pos""",
        "pixels",
    ),
)
def merge_qwm(spark, sf_dir):
    parts = S.weighted_mean(pixels(spark, sf_dir), KEYS, (F.col("frame") % 9) / 4.0)
    merged = parts.groupBy("pos").agg(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("weight")), F.nullif(F.sum("weight"), F.lit(0.0))), F.lit(0.0)).alias("value"), F.sum("weight").alias("weight"))
    return _rounded(merged, "value", "weight")


@query("merge_mean", with_views(f"WITH {_S} SELECT pos, round(avg(s), 6) AS value, count(s) AS n FROM s GROUP BY pos", "pixels"))
def merge_mean(spark, sf_dir):
    """Means of batches merged by their counts are the mean of all."""
    parts = S.combine(pixels(spark, sf_dir), KEYS, "mean")
    merged = parts.groupBy("pos").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))
    return _rounded(merged, "value")


_LEAVES = f"""{_S}, f AS (SELECT batch, frame, (row_number() OVER (PARTITION BY batch ORDER BY frame) - 1) % 4 AS leaf FROM (SELECT DISTINCT batch, frame FROM s)),
    l AS (SELECT batch, pos, leaf, median(s) AS value, count(s) AS n FROM s JOIN f USING (batch, frame) GROUP BY ALL)"""


@query("hier_leaf", with_views(f"WITH {_LEAVES} SELECT batch, pos, leaf, round(value, 6) AS value, n FROM l", "pixels"))
def hier_leaf(spark, sf_dir):
    return _rounded(S.leaf_medians(pixels(spark, sf_dir), KEYS, [F.col("frame")], ["batch"]), "value").withColumn("leaf", F.col("leaf").cast("bigint"))


def _used(level: str) -> str:
    return f"SELECT * EXCLUDE (frames), CASE WHEN n >= greatest(1, ceil(0.7e0 * frames)) THEN value END AS used, frames FROM {level}"


@query(
    "hier_tree",
    with_views(
        f"""WITH {_LEAVES}, z AS (SELECT batch, leaf, count(*) AS frames FROM f GROUP BY ALL), l2 AS (SELECT l.*, frames FROM l JOIN z USING (batch, leaf)),
        p AS (SELECT batch, pos, leaf // 2 AS node, median(used) AS value, sum(n) AS n, sum(frames) AS frames FROM ({_used("l2")}) GROUP BY ALL),
        t AS (SELECT batch, pos, median(used) AS value, sum(n) AS n, sum(frames) AS frames FROM ({_used("p")}) GROUP BY ALL)
        SELECT batch, pos, round(coalesce(value, 0), 6) AS value, CAST(n AS BIGINT) AS n, n >= greatest(1, ceil(0.7e0 * frames)) AS valid FROM t""",
        "pixels",
    ),
)
def hier_tree(spark, sf_dir):
    return _rounded(S.tree_median(pixels(spark, sf_dir), KEYS, [F.col("frame")], ["batch"]), "value")


@query(
    "coverage_mask",
    with_views(
        """SELECT batch, pos, count(*) FILTER (ok) AS n, count(*) FILTER (ok) >= greatest(1, ceil(0.7e0 * any_value(k))) AS valid
        FROM pixels JOIN (SELECT batch, count(DISTINCT frame) AS k FROM pixels GROUP BY batch) USING (batch) GROUP BY ALL""",
        "pixels",
    ),
)
def coverage_mask(spark, sf_dir):
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("batch")).agg(F.count(F.lit(1)).alias("n_frames"))
    return S.coverage(pixels(spark, sf_dir), KEYS, frames, ["batch"])


_STATE = f"""{_S}, st AS (SELECT batch, pos, coalesce(sum(s), 0) AS sum, count(s) AS count, coalesce(sum(s * (1 + frame % 3)), 0) AS weighted_sum,
    coalesce(sum(CASE WHEN s IS NOT NULL THEN 1e0 + frame % 3 END), 0) AS weight_sum, max(s) AS highest, min(s) AS lowest FROM s GROUP BY ALL)"""


@query(
    "bundle_state",
    with_views(f"WITH {_STATE} SELECT batch, pos, round(sum, 5) AS sum, count, round(weighted_sum, 5) AS weighted_sum, weight_sum, round(highest, 6) AS highest, round(lowest, 6) AS lowest FROM st", "pixels"),
)
def bundle_state(spark, sf_dir):
    state = S.bundle_state(pixels(spark, sf_dir), KEYS, 1.0 + F.col("frame") % 3)
    return _rounded(_rounded(state, "highest", "lowest"), "sum", "weighted_sum", digits=5)


@query(
    "bundle_merge",
    with_views(
        f"""WITH {_STATE} SELECT pos, round(sum(sum) / sum(count), 6) AS mean, round(sum(sum), 4) AS sum, round(sum(weighted_sum) / nullif(sum(weight_sum), 0), 6) AS weighted_mean,
        round(max(highest), 6) AS highest, round(min(lowest), 6) AS lowest, CAST(sum(count) AS BIGINT) AS n FROM st GROUP BY pos""",
        "pixels",
    ),
)
def bundle_merge(spark, sf_dir):
    merged = S.merge_bundles(S.bundle_state(pixels(spark, sf_dir), KEYS, 1.0 + F.col("frame") % 3), ["pos"])
    return _rounded(_rounded(merged, "mean", "weighted_mean", "highest", "lowest"), "sum", digits=4)


@query("bundle_hier", with_views(f"WITH {_S}, m AS (SELECT batch, pos, coalesce(median(s), 0) AS m FROM s GROUP BY ALL) SELECT pos, round(median(m), 6) AS value FROM m GROUP BY pos", "pixels"))
def bundle_hier(spark, sf_dir):
    """Medians don't merge: the median of the batches' medians, whatever their masks."""
    masters = S.combine(pixels(spark, sf_dir), KEYS, "median")
    return masters.groupBy("pos").agg(F.round(F.median("value"), 6).alias("value"))


@query("master_median", with_views("SELECT batch, y, x, round(median(v), 6) AS master FROM pixels GROUP BY ALL", "pixels"))
def master_median(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("batch", "y", "x").agg(F.round(F.median("v"), 6).alias("master"))


_CAL = """d AS (SELECT pos, median(v) AS dark FROM pixels WHERE batch = 0 GROUP BY pos), f0 AS (SELECT pos, median(v) AS f FROM pixels WHERE batch = 1 GROUP BY pos),
    f AS (SELECT pos, CASE WHEN isfinite(f / m) AND f / m > 0.01 THEN f / m ELSE 1 END AS flat FROM f0, (SELECT median(f) AS m FROM f0)),
    cal AS (SELECT frame, pos, batch, CASE WHEN flat > 0.01 THEN (v - dark) / flat ELSE v - dark END AS v FROM pixels JOIN d USING (pos) JOIN f USING (pos) WHERE batch > 1)"""


def _masters(spark, sf_dir):
    """Dark and flat of each position: a row per position, as many as a frame has, so broadcast by size alone."""
    stack = pixels(spark, sf_dir)
    dark = stack.where("batch = 0").groupBy("pos").agg(F.median("v").alias("dark"))
    flat = stack.where("batch = 1").groupBy("pos").agg(F.median("v").alias("flat"))
    middle = flat.agg(F.median("flat").alias("middle"))
    even = flat.crossJoin(F.broadcast(middle)).withColumn("flat", F.try_divide("flat", "middle")).drop("middle")  # middle: one row
    usable = F.col("flat").isNotNull() & ~F.isnan("flat") & (F.abs("flat") != float("inf")) & (F.col("flat") > 0.01)
    return dark, even.withColumn("flat", F.when(usable, F.col("flat")).otherwise(1.0))


@query("flat_prepare", with_views(f"WITH {_CAL} SELECT pos, round(flat, 6) AS flat FROM f", "pixels"))
def flat_prepare(spark, sf_dir):
    return _rounded(_masters(spark, sf_dir)[1], "flat")


def _calibrated(spark, sf_dir):
    dark, flat = _masters(spark, sf_dir)
    lights = pixels(spark, sf_dir).where("batch > 1")
    return lights.join(dark, "pos").join(flat, "pos").withColumn("v", S.calibrate(F.col("v"), F.col("dark"), F.col("flat"))).select("frame", "pos", "batch", "v")


@query("calibrate", with_views(f"WITH {_CAL} SELECT frame, pos, round(v, 5) AS v FROM cal", "pixels"))
def calibrate(spark, sf_dir):
    return _calibrated(spark, sf_dir).select("frame", "pos", F.round("v", 5).alias("v"))


@query("calib_range", with_views(f"WITH {_CAL} SELECT round(min(v), 5) AS low, round(max(v), 5) AS high, count(*) AS n FROM cal WHERE isfinite(v)", "pixels"))
def calib_range(spark, sf_dir):
    rows = _calibrated(spark, sf_dir).where(~F.isnan("v") & (F.abs("v") != float("inf")))
    return rows.agg(F.round(F.min("v"), 5).alias("low"), F.round(F.max("v"), 5).alias("high"), F.count(F.lit(1)).alias("n"))


@query("encode_uint16", with_views("SELECT frame, pos, CAST(trunc(least(greatest((v + 0.5) / 1.5, 0), 1) * 65535) AS INTEGER) AS code FROM pixels", "pixels"))
def encode_uint16(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame", "pos", S.encode_uint16(F.col("v"), F.lit(-0.5), F.lit(1.0)).alias("code"))


@query("clip_uint16", with_views("SELECT frame, pos, CAST(trunc(least(greatest(v * 1e5, 0), 65535)) AS INTEGER) AS code FROM pixels", "pixels"))
def clip_uint16(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame", "pos", S.clip_uint16(F.col("v") * 1e5).alias("code"))


@query(
    "decode_uint16",
    with_views("SELECT frame, pos, round(-0.5 + trunc(least(greatest((v + 0.5) / 1.5, 0), 1) * 65535) / 65535e0 * 1.5, 6) AS v FROM pixels", "pixels"),
)
def decode_uint16(spark, sf_dir):
    code = S.encode_uint16(F.col("v"), F.lit(-0.5), F.lit(1.0))
    return pixels(spark, sf_dir).select("frame", "pos", F.round(S.decode_uint16(code, F.lit(-0.5), F.lit(1.0)), 6).alias("v"))


@query("minmax_norm", with_views("SELECT frame, pos, round((v - lo) / nullif(hi - lo, 0), 6) AS v FROM pixels JOIN (SELECT frame, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY frame) USING (frame)", "pixels"))
def minmax_norm(spark, sf_dir):
    """A frame's range is found in its row, before its positions are taken apart."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"), F.posexplode("embedding").alias("pos", "v"))
    value = F.try_divide(F.col("v").cast("double") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return rows.select("frame", F.col("pos").cast("bigint").alias("pos"), F.round(F.coalesce(value, F.lit(0.0)), 6).alias("v"))


@query(
    "luminance",
    with_views(
        """SELECT frame, y, x, round(0.2126 * r + 0.7152 * coalesce(g, r) + 0.0722 * coalesce(b, r), 6) AS v FROM (
        SELECT frame, (pos // 3) // 11 AS y, (pos // 3) % 11 AS x, max(v) FILTER (pos % 3 = 0) AS r, max(v) FILTER (pos % 3 = 1) AS g, max(v) FILTER (pos % 3 = 2) AS b FROM pixels GROUP BY ALL)""",
        "pixels",
    ),
)
def luminance(spark, sf_dir):
    """Three values are a pixel of three colours; one that is left over is grey."""
    rows = pixels(spark, sf_dir).select("frame", F.expr("pos div 3 div 11").alias("y"), F.expr("pos div 3 % 11").alias("x"), (F.col("pos") % 3).alias("c"), "v")
    pick = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    value = 0.2126 * pick(0) + 0.7152 * F.coalesce(pick(1), pick(0)) + 0.0722 * F.coalesce(pick(2), pick(0))
    return rows.groupBy("frame", "y", "x").agg(F.round(value, 6).alias("v"))


@query(
    "bayer_split",
    with_views(
        """SELECT frame, y // 2 AS y, x // 2 AS x, round(max(v) FILTER (y % 2 = 0 AND x % 2 = 0), 6) AS r, round(0.5 * (max(v) FILTER (y % 2 = 0 AND x % 2 = 1) + max(v) FILTER (y % 2 = 1 AND x % 2 = 0)), 6) AS g,
        round(max(v) FILTER (y % 2 = 1 AND x % 2 = 1), 6) AS b FROM pixels GROUP BY ALL""",
        "pixels",
    ),
)
def bayer_split(spark, sf_dir):
    cell = lambda y, x: F.max(F.when((F.col("y") % 2 == y) & (F.col("x") % 2 == x), F.col("v")))
    grouped = pixels(spark, sf_dir).groupBy("frame", F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx"))
    return grouped.agg(F.round(cell(0, 0), 6).alias("r"), F.round(0.5 * (cell(0, 1) + cell(1, 0)), 6).alias("g"), F.round(cell(1, 1), 6).alias("b")).withColumnsRenamed({"cy": "y", "cx": "x"})


@query(
    "norm_median",
    with_views(
        f"""WITH {_S}, m AS (SELECT frame, median(s) AS m FROM s GROUP BY frame), r AS (SELECT m AS ref FROM m WHERE frame = 0)
        SELECT frame, round(CASE WHEN m > 0 AND ref > 0 THEN ref / m ELSE 1 END, 6) AS factor FROM m, r""",
        "pixels",
    ),
)
def norm_median(spark, sf_dir):
    return _rounded(S.normalisation(pixels(spark, sf_dir), "frame", F.col("frame") == 0), "factor")


@query(
    "norm_mode",
    with_views(
        f"""WITH {_S}, e AS (SELECT batch, pos, quantile_cont(s, 0.05) AS lo, quantile_cont(s, 0.95) AS hi, median(s) AS m FROM s GROUP BY ALL),
        b AS (SELECT batch, pos, least(floor((s - lo) / (hi - lo) * 64), 63) AS bin, count(*) AS n FROM s JOIN e USING (batch, pos) WHERE s BETWEEN lo AND hi AND hi > lo GROUP BY ALL),
        f AS (SELECT batch, pos, bin FROM b QUALIFY row_number() OVER (PARTITION BY batch, pos ORDER BY n DESC, bin) = 1)
        SELECT batch, pos, round(coalesce(lo + (bin + 0.5) * (hi - lo) / 64, m), 6) AS mode FROM e LEFT JOIN f USING (batch, pos)""",
        "pixels",
    ),
)
def norm_mode(spark, sf_dir):
    return _rounded(S.mode(pixels(spark, sf_dir), KEYS), "mode")


@query("stride_sample", with_views("SELECT frame, y, x, round(v, 6) AS v FROM pixels WHERE y % 3 = 0 AND x % 3 = 0", "pixels"))
def stride_sample(spark, sf_dir):
    return _rounded(S.strided(pixels(spark, sf_dir), 3).select("frame", "y", "x", "v"), "v")


def _clip_sql(rounds: int) -> str:
    steps, last = [], "s0"
    for i in range(rounds):
        steps.append(f"c{i} AS (SELECT batch, pos, median(s) AS c, stddev_pop(s) AS d FROM {last} GROUP BY ALL), s{i + 1} AS (SELECT batch, pos, s FROM {last} JOIN c{i} USING (batch, pos) WHERE abs(s - c) <= 2 * d OR NOT d > 1e-10)")
        last = f"s{i + 1}"
    return f"WITH {_S}, s0 AS (SELECT batch, pos, s FROM s WHERE s IS NOT NULL), {', '.join(steps)} SELECT batch, pos, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS deviation, count(s) AS n FROM {last} GROUP BY ALL"


@query("sigma_clip_stats", with_views(_clip_sql(5), "pixels"))
def sigma_clip_stats(spark, sf_dir):
    return _rounded(S.clipped_stats(pixels(spark, sf_dir), KEYS, 5, 2.0), "mean", "median", "deviation")


_HDR = """h AS (SELECT pos, CASE WHEN batch % 5 = 0 THEN 1 ELSE 1 + batch % 3 END AS e, CASE WHEN batch % 4 = 1 THEN v * 2 - 1 ELSE v * (1 + batch % 3) END AS v
        FROM pixels WHERE ok AND CASE WHEN batch % 4 = 1 THEN v ELSE v * (1 + batch % 3) END < CASE WHEN batch % 6 > 0 THEN 0.35e0 ELSE 1e9 END),
    g AS (SELECT pos, sum(pow(e / 0.5, 2) * v / e) AS wr, sum(pow(e / 0.5, 2)) AS ws, count(*) AS n, avg(v / e) AS m, avg(v / e * v / e) AS m2, min(e) AS e FROM h GROUP BY pos)"""


def _hdr(spark, sf_dir):
    """Batches of three exposures; some are rates, some normalised to a range, and most know where they saturate."""
    seconds = (1 + F.col("batch") % 3).cast("double")
    normalised = F.col("batch") % 4 == 1
    rows = pixels(spark, sf_dir).withColumns(
        {
            "exposure": seconds,
            "v": F.when(normalised, F.col("v")).otherwise(F.col("v") * seconds),
            "saturation": F.when(F.col("batch") % 6 > 0, 0.35),
            "is_rate": F.col("batch") % 5 == 0,
            "low": F.when(normalised, -1.0),
            "high": F.when(normalised, 1.0),
        }
    )
    return S.hdr_fuse(rows, ["pos"], 0.5, 0.25)


@query("hdr_fuse", with_views(f"WITH {_HDR} SELECT pos, round(wr / ws, 6) AS radiance, ws > 0 AS valid FROM g", "pixels"))
def hdr_fuse(spark, sf_dir):
    return _rounded(_hdr(spark, sf_dir).select("pos", "radiance", "valid"), "radiance")


@query("hdr_disagree", with_views(f"WITH {_HDR} SELECT pos, n >= 2 AND sqrt(greatest(m2 - m * m, 0)) > 0.25 * 0.5 / e AS disagree FROM g", "pixels"))
def hdr_disagree(spark, sf_dir):
    return _hdr(spark, sf_dir).select("pos", "disagree")


@query("hdr_groups", "SELECT 1 + label % 3 AS exposure, count(*) AS n_frames, CASE WHEN (SELECT count(DISTINCT label % 3) FROM embeddings) > 1 THEN 'multi' ELSE 'equal' END AS capability FROM embeddings GROUP BY 1")
def hdr_groups(spark, sf_dir):
    groups = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy((1 + F.col("label") % 3).alias("exposure")).agg(F.count(F.lit(1)).alias("n_frames"))
    kinds = groups.agg(F.count(F.lit(1)).alias("kinds"))
    return groups.crossJoin(F.broadcast(kinds)).select("exposure", "n_frames", F.when(F.col("kinds") > 1, "multi").otherwise("equal").alias("capability"))  # kinds: one row


@query(
    "metadata_uniform",
    "SELECT label % 3 AS exposure, count(DISTINCT coalesce(CAST(nullif(label % 2, 1) AS VARCHAR), 'none')) = 1 AS one_filter, count(DISTINCT label) AS labels FROM embeddings GROUP BY 1",
)
def metadata_uniform(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kind = F.coalesce(F.nullif(F.col("label") % 2, F.lit(1)).cast("string"), F.lit("none"))
    return rows.groupBy((F.col("label") % 3).alias("exposure")).agg((F.countDistinct(kind) == 1).alias("one_filter"), F.countDistinct("label").alias("labels"))


@query(
    "diff_score",
    with_views(
        """WITH o AS (SELECT frame, batch, row_number() OVER (PARTITION BY batch ORDER BY frame) AS place FROM (SELECT DISTINCT frame, batch FROM pixels)),
        p AS (SELECT batch, pos, place, v FROM pixels JOIN o USING (frame, batch))
        SELECT a.batch, a.place, round(stddev_pop(a.v - b.v), 6) AS score FROM p a JOIN p b ON a.batch = b.batch AND a.pos = b.pos AND a.place = b.place + 1 GROUP BY ALL""",
        "pixels",
    ),
)
def diff_score(spark, sf_dir):
    from pyspark.sql.window import Window

    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("bigint").alias("place"))
    stack = pixels(spark, sf_dir).join(frames, "frame")
    return _rounded(S.difference_scores(stack, ["pos"], ["batch"], "place"), "score")


@query(
    "dither_shift",
    with_views(
        """WITH m AS (SELECT frame, CAST(y + round_even((frame % 5 - 2) / 2e0, 0) AS BIGINT) AS y, CAST(x + round_even((frame % 7 - 3) / 2e0, 0) AS BIGINT) AS x, v FROM pixels)
        SELECT frame, y, x, round(v, 6) AS v FROM m WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7""",
        "pixels",
    ),
)
def dither_shift(spark, sf_dir):
    moved = S.shifted(pixels(spark, sf_dir), (F.col("frame") % 5 - 2) / 2.0, (F.col("frame") % 7 - 3) / 2.0, 8, 8)
    return moved.select("frame", "y", "x", F.round("v", 6).alias("v"))


@query("center_crop", with_views("SELECT frame, y - 2 AS y, x - 1 AS x, round(v, 6) AS v FROM pixels WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6", "pixels"))
def center_crop(spark, sf_dir):
    return S.centre_crop(pixels(spark, sf_dir), 8, 8, 4, 6).select("frame", "y", "x", F.round("v", 6).alias("v"))
