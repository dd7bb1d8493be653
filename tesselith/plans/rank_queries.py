"""Queries of ranks, scores, selections, summaries and joins of frame metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.functions import metrics as M
from tesselith.operators import flow as X
from tesselith.operators import ranking as R
from tesselith.operators import stack_plan as P
from tesselith.plans.inputs import pixels, view, with_views
from tesselith.plans.registry import query
from tesselith.plans.scalar_queries import TRAIL_SQL
from tesselith.sources import fits, fits_sink
from tesselith.staging import shared_folder

WEIGHTS = {"fwhm": 0.4, "roundness": 0.3, "snr": 0.2, "rms": 0.1}
LOWER = {"fwhm", "rms"}


def _rank_sql(metric: str) -> str:
    share = f"((2 * (rank() OVER (PARTITION BY batch ORDER BY {metric}) - 1) + count(*) OVER (PARTITION BY batch, {metric}) - 1) / 2e0) / greatest(count(*) OVER (PARTITION BY batch) - 1, 1)"
    return f"SELECT batch, frame_id, '{metric}' AS metric, {'1 - ' + share if metric in LOWER else share} AS rank FROM frames WHERE {metric} IS NOT NULL"


_RANKS = f"ranks AS ({' UNION ALL '.join(map(_rank_sql, WEIGHTS))}), w AS (SELECT * FROM (VALUES {', '.join(f"('{m}', CAST({w} AS DOUBLE))" for m, w in WEIGHTS.items())}) AS v(metric, w))"
_SCORES = f"""{_RANKS}, scores AS (SELECT f.frame_id, f.batch, sum(w * rank) / sum(w) AS score, coalesce(sum(w), 0) AS available, coalesce(sum(w), 0) / 1e0 >= 0.6e0 - 1e-12 AS eligible, count(rank) AS n
    FROM frames f LEFT JOIN ranks r ON r.frame_id = f.frame_id LEFT JOIN w USING (metric) GROUP BY ALL)"""
_SELECTED = f"""{_SCORES}, cand AS (SELECT f.*, CASE WHEN eligible THEN round(score, 9) END AS score, count(CASE WHEN eligible THEN 1 END) OVER (PARTITION BY f.batch) AS n_eligible, count(*) OVER (PARTITION BY f.batch) AS n_all FROM frames f JOIN scores USING (frame_id)),
    placed AS (SELECT *, CASE WHEN n_eligible > 0 THEN n_eligible ELSE n_all END AS n_of, row_number() OVER (PARTITION BY batch ORDER BY score DESC NULLS LAST, lower(path), path, frame_id) AS place FROM cand WHERE score IS NOT NULL OR n_eligible = 0),
    chosen AS (SELECT * FROM placed WHERE place <= greatest(least(3, n_of), floor(n_of * 40 / 100e0)))"""


@query("pct_rank_avg", with_views(f"WITH {_RANKS} SELECT batch, frame_id, metric, round(rank, 6) AS rank FROM ranks", "frames"))
def pct_rank_avg(spark, sf_dir):
    return R.percentile_ranks(view(spark, sf_dir, "frames"), "frame_id", list(WEIGHTS), ["batch"]).select("batch", "frame_id", "metric", F.round("rank", 6).alias("rank"))


@query("quality_score", with_views(f"WITH {_SCORES} SELECT frame_id, batch, CASE WHEN eligible THEN round(score, 6) END AS score, round(available, 6) AS available, eligible FROM scores", "frames"))
def quality_score(spark, sf_dir):
    scores = R.quality_scores(view(spark, sf_dir, "frames"), "frame_id", WEIGHTS, ["batch"])
    return scores.select("frame_id", "batch", F.round("score", 6).alias("score"), F.round("available", 6).alias("available"), "eligible")


@query(
    "score_components",
    with_views(
        f"""WITH {_SCORES}, lack AS (SELECT frame_id, string_agg(metric, ',' ORDER BY metric) AS missing, count(*) AS n FROM (SELECT frame_id, metric FROM frames, w) ANTI JOIN ranks USING (frame_id, metric) GROUP BY frame_id)
        SELECT s.frame_id, s.n AS n_components, coalesce(l.n, 0) AS n_missing, round(r.rank, 6) AS fwhm, coalesce(l.missing, '') AS missing
        FROM scores s LEFT JOIN lack l ON l.frame_id = s.frame_id LEFT JOIN ranks r ON r.frame_id = s.frame_id AND r.metric = 'fwhm'""",
        "frames",
    ),
)
def score_components(spark, sf_dir):
    scores = R.quality_scores(view(spark, sf_dir, "frames"), "frame_id", WEIGHTS, ["batch"])
    return scores.select(
        "frame_id",
        F.size("components").cast("bigint").alias("n_components"),
        F.size("missing").cast("bigint").alias("n_missing"),
        F.round(F.try_element_at("components", F.lit("fwhm")), 6).alias("fwhm"),
        F.array_join("missing", ",").alias("missing"),
    )


@query(
    "robust_location",
    with_views(
        """WITH m AS (SELECT batch, median(snr) AS snr_median, median(fwhm) AS fwhm_median FROM frames GROUP BY batch)
        SELECT batch, round(any_value(snr_median), 6) AS snr_median, round(any_value(fwhm_median), 6) AS fwhm_median, round(1.4826e0 * median(abs(snr - snr_median)), 6) AS snr_sigma,
        round(1.4826e0 * median(abs(fwhm - fwhm_median)), 6) AS fwhm_sigma FROM frames JOIN m USING (batch) GROUP BY batch""",
        "frames",
    ),
)
def robust_location(spark, sf_dir):
    found = R.robust(view(spark, sf_dir, "frames"), ["snr", "fwhm"], ["batch"])
    return found.select("batch", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query(
    "trail_class",
    with_views(f"WITH {TRAIL_SQL} SELECT frame_id, trail_class, cause, round(confidence, 6) AS confidence, penalty FROM trail", "frames"),
)
def trail_class(spark, sf_dir):
    return R.trail_classes(view(spark, sf_dir, "frames"), "frame_id", ["batch"]).withColumn("confidence", F.round("confidence", 6))


@query(
    "stack_weights",
    with_views(
        """WITH m AS (SELECT batch, median(CASE WHEN snr > 0 THEN snr END) AS m FROM frames GROUP BY batch)
        SELECT frame_id, round(least(greatest(coalesce(snr / m, 0.25), 0.25), 2), 6) AS stack_weight FROM frames JOIN m USING (batch)""",
        "frames",
    ),
)
def stack_weights(spark, sf_dir):
    return R.stack_weights(view(spark, sf_dir, "frames"), "frame_id", "snr", ["batch"]).select("frame_id", F.round("stack_weight", 6).alias("stack_weight"))


_BEST = """SELECT frame_id, batch FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY roundness DESC, lower(path), path, frame_id) AS k, count(*) OVER (PARTITION BY batch) AS n
    FROM frames WHERE roundness > 0 AND roundness <= 1) WHERE k <= greatest(least(3, n), floor(n * 40 / 100e0))"""


@query("select_best_pct", with_views(_BEST, "frames"))
def select_best_pct(spark, sf_dir):
    return R.best_share(view(spark, sf_dir, "frames"), ["batch"], "roundness", 40, "path", "frame_id").select("frame_id", "batch")


@query(
    "select_best_fwhm",
    with_views(
        """WITH v AS (SELECT *, CASE WHEN fwhm > 0 THEN fwhm END AS u FROM frames), c AS (SELECT *, count(u) OVER (PARTITION BY batch) AS n, count(*) OVER (PARTITION BY batch) AS every FROM v)
        SELECT frame_id, batch FROM (SELECT *, CASE WHEN n > 0 THEN n ELSE every END AS n_of, row_number() OVER (PARTITION BY batch ORDER BY u, lower(path), path, frame_id) AS k FROM c WHERE u IS NOT NULL OR n = 0) WHERE k <= greatest(least(3, n_of), floor(n_of * 25 / 100e0))""",
        "frames",
    ),
)
def select_best_fwhm(spark, sf_dir):
    return R.best_share(view(spark, sf_dir, "frames"), ["batch"], "fwhm", 25, "path", "frame_id").select("frame_id", "batch")


@query("select_multimetric", with_views(f"WITH {_SELECTED} SELECT frame_id, place, n_eligible = 0 AS fallback FROM chosen", "frames"))
def select_multimetric(spark, sf_dir):
    return R.best_scores(view(spark, sf_dir, "frames"), "frame_id", WEIGHTS, ["batch"], 40, "path").select("frame_id", "place", "fallback")


@query(
    "selection_report",
    with_views(
        f"""WITH sel AS ({_BEST}) SELECT f.frame_id, s.frame_id IS NOT NULL AS selected, CASE WHEN s.frame_id IS NOT NULL THEN 'selected' WHEN roundness IS NULL OR roundness <= 0 OR roundness > 1 OR star_count < 8 THEN 'missing_shape_measurement'
        WHEN roundness < 0.6 THEN 'elongated_stars' ELSE 'below_share' END AS reason FROM frames f LEFT JOIN sel s USING (frame_id)""",
        "frames",
    ),
)
def selection_report(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    chosen = R.best_share(frames, ["batch"], "roundness", 40, "path", "frame_id").select("frame_id", F.lit(True).alias("chosen"))
    reason = F.coalesce(F.when(F.col("chosen"), "selected"), M.trail_reason(F.col("roundness"), F.col("star_count"), 0.6, 8), F.lit("below_share"))
    return frames.join(chosen, "frame_id", "left").select("frame_id", F.coalesce("chosen", F.lit(False)).alias("selected"), reason.alias("reason"))


@query(
    "master_elect",
    with_views(
        """SELECT batch, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN fwhm > 0 THEN star_count / fwhm ELSE star_count END DESC NULLS LAST, star_count DESC, lower(path), frame_id) AS k FROM frames) WHERE k = 1""",
        "frames",
    ),
)
def master_elect(spark, sf_dir):
    quality = M.anchor_quality(F.col("star_count"), F.col("fwhm"))
    return R.first_per_group(view(spark, sf_dir, "frames"), ["batch"], [quality.desc_nulls_last(), F.col("star_count").desc(), F.lower("path"), F.col("frame_id")]).select("batch", "frame_id")


@query(
    "best_edge",
    with_views("SELECT batch, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY matches % 4, rms, abs(tx), id) AS k FROM transforms) WHERE k = 1", "transforms"),
)
def best_edge(spark, sf_dir):
    return R.first_per_group(view(spark, sf_dir, "transforms"), ["batch"], [F.col("matches") % 4, F.col("rms"), F.abs("tx"), F.col("id")]).select("batch", "id")


@query(
    "best_failure",
    with_views("SELECT batch, id, inliers, round(rms, 6) AS rms FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY inliers DESC, rms, id) AS k FROM transforms WHERE matches < 30) WHERE k = 1", "transforms"),
)
def best_failure(spark, sf_dir):
    failed = view(spark, sf_dir, "transforms").where("matches < 30")
    return R.first_per_group(failed, ["batch"], [F.col("inliers").desc(), F.col("rms"), F.col("id")]).select("batch", "id", "inliers", F.round("rms", 6).alias("rms"))


@query(
    "best_reference",
    with_views("SELECT batch, id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY coverage >= 0.3 DESC, response DESC, rms, id) AS k FROM transforms) WHERE k = 1", "transforms"),
)
def best_reference(spark, sf_dir):
    best = F.max_by("id", F.struct((F.col("coverage") >= 0.3).cast("int").alias("c"), F.col("response"), (-F.col("rms")).alias("r"), (-F.col("id")).alias("i")))
    return view(spark, sf_dir, "transforms").groupBy("batch").agg(best.alias("id"))


@query("topn_per_group", with_views("SELECT frame, star, place FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) AS place FROM stars) WHERE place <= 25", "stars"))
def topn_per_group(spark, sf_dir):
    return R.first_per_group(view(spark, sf_dir, "stars"), ["frame"], [F.col("flux").desc(), F.col("star")], 25, "place").select("frame", "star", "place")


@query(
    "candidate_topk",
    with_views(
        """SELECT batch, frame_id, candidate, place FROM (SELECT a.batch, a.frame_id, b.frame_id AS candidate, row_number() OVER (PARTITION BY a.frame_id ORDER BY abs(a.seq - b.seq), b.seq) AS place
        FROM frames a JOIN frames b ON a.batch = b.batch AND a.seq <> b.seq) WHERE place <= 4""",
        "frames",
    ),
)
def candidate_topk(spark, sf_dir):
    """The nearest four in sequence."""
    return R.nearest_in_order(view(spark, sf_dir, "frames"), ["batch"], "frame_id", "seq", 4)


def _within(frames, width):
    block = F.floor(F.col("seq") / width)
    left = frames.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    right = frames.select("batch", F.col("frame_id").alias("other"), F.col("seq").alias("other_seq"), block.alias("block"))
    return left.join(right, ["batch", "block"]).where(F.abs(F.col("seq") - F.col("other_seq")).between(1, width))


@query(
    "neighbor_candidates",
    with_views("SELECT a.batch, a.frame_id, b.frame_id AS other FROM frames a JOIN frames b ON a.batch = b.batch AND abs(a.seq - b.seq) BETWEEN 1 AND 40", "frames"),
)
def neighbor_candidates(spark, sf_dir):
    return _within(view(spark, sf_dir, "frames").select("batch", "frame_id", "seq"), 40).select("batch", "frame_id", "other")


@query("even_sample", with_views("SELECT batch, frame_id FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY seq) - 1 AS p, count(*) OVER (PARTITION BY batch) AS n FROM frames) WHERE n <= 12 OR list_contains(list_transform(range(12), lambda i: i * (n - 1) // 11), p)", "frames"))
def even_sample(spark, sf_dir):
    return R.even_sample(view(spark, sf_dir, "frames"), ["batch"], [F.col("seq")], 12).select("batch", "frame_id")


@query("inventory", with_views("SELECT batch, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS suffix, count(*) AS n, round(sum(snr), 4) AS total, round(median(snr), 6) AS median, min(snr) AS low, max(snr) AS high FROM frames GROUP BY ROLLUP (1, 2)", "frames"))
def inventory(spark, sf_dir):
    frames = view(spark, sf_dir, "frames").withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    return frames.rollup("batch", "suffix").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("snr"), 4).alias("total"), F.round(F.median("snr"), 6).alias("median"), F.min("snr").alias("low"), F.max("snr").alias("high"))


_SUMMARY = {"quality": "quality", "fwhm": "fwhm", "roundness": "roundness", "star_count": "star_count", "rotation": "rotation_deg", "scale": "scale", "rms": "cumulative_rms"}


@query(
    "quality_summary",
    with_views(
        f"""WITH q AS (SELECT *, star_count / greatest(coalesce(fwhm, 0), 0.1e0) AS quality FROM frames),
        m AS (SELECT median(quality) AS qm, median(roundness) AS rm FROM q WHERE timed), d AS (SELECT 1.4826e0 * median(abs(quality - qm)) AS qs, 1.4826e0 * median(abs(roundness - rm)) AS rs FROM q, m WHERE timed),
        g AS (SELECT batch, count(*) AS frame_count, count(*) FILTER (timed) AS timed_frame_count, count(*) FILTER (status = 'accepted') AS accepted_frame_count,
            {", ".join(f"round(median({c}), 6) AS median_{n}" for c, n in _SUMMARY.items())}, round(max(abs(rotation)), 6) AS max_abs_rotation_deg, median(quality) AS mq, median(roundness) AS mr FROM q GROUP BY batch),
        t AS (SELECT g.*, round(CASE WHEN rs > 0 THEN rm - 3 * rs END, 6) AS roundness_threshold, coalesce(qs > 0 AND mq < qm - 3 * qs, false) AS low, coalesce(rs > 0 AND mr < rm - 3 * rs, false) AS flat FROM g, m, d)
        SELECT batch, frame_count, timed_frame_count, accepted_frame_count, {", ".join(f"median_{n}" for n in _SUMMARY.values())}, max_abs_rotation_deg, roundness_threshold, flat AS roundness_review_suggested, low OR flat AS review_suggested,
            CASE WHEN low THEN 'quality_below_robust_session_baseline' WHEN flat THEN 'roundness_below_robust_session_baseline' END AS review_reason FROM t""",
        "frames",
    ),
)
def quality_summary(spark, sf_dir):
    """Groups of frames beside the baseline of all timed ones."""
    frames = view(spark, sf_dir, "frames").withColumn("quality", M.temporal_quality(F.lit(None).cast("double"), F.col("star_count"), F.col("fwhm")))
    found = R.quality_summaries(frames, ["batch"], _SUMMARY, F.col("timed"), F.col("status") == "accepted")
    rounded = [c for c in found.columns if c.startswith(("median_", "max_")) or c == "roundness_threshold"]
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@query("rotation_span", with_views("SELECT batch, round(min(rotation), 6) AS low, round(max(rotation), 6) AS high, round(max(rotation) - min(rotation), 6) AS span, round(max(abs(rotation)), 6) AS largest FROM frames GROUP BY batch", "frames"))
def rotation_span(spark, sf_dir):
    r = F.col("rotation")
    return view(spark, sf_dir, "frames").groupBy("batch").agg(F.round(F.min(r), 6).alias("low"), F.round(F.max(r), 6).alias("high"), F.round(F.max(r) - F.min(r), 6).alias("span"), F.round(F.max(F.abs(r)), 6).alias("largest"))


@query(
    "flow_stats",
    with_views(
        """SELECT batch, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, round(count(*) FILTER (status = 'accepted') / count(*), 6) AS share,
        min(seq) FILTER (status = 'accepted') AS first, max(seq) FILTER (status = 'accepted') AS last FROM frames GROUP BY batch""",
        "frames",
    ),
)
def flow_stats(spark, sf_dir):
    yes = F.col("status") == "accepted"
    return view(spark, sf_dir, "frames").groupBy("batch").agg(
        F.count_if(yes).alias("accepted"), F.count_if(~yes).alias("rejected"), F.round(F.count_if(yes) / F.count(F.lit(1)), 6).alias("share"), F.min(F.when(yes, F.col("seq"))).alias("first"), F.max(F.when(yes, F.col("seq"))).alias("last")
    )


@query(
    "axial_coherence",
    with_views("SELECT batch, round(sqrt(pow(avg(cos(2 * rotation)), 2) + pow(avg(sin(2 * rotation)), 2)), 6) AS coherence, round(atan2(avg(sin(2 * rotation)), avg(cos(2 * rotation))) / 2, 6) AS angle FROM frames GROUP BY batch", "frames"),
)
def axial_coherence(spark, sf_dir):
    c, s = F.avg(F.cos(2 * F.col("rotation"))), F.avg(F.sin(2 * F.col("rotation")))
    return view(spark, sf_dir, "frames").groupBy("batch").agg(F.round(F.sqrt(c * c + s * s), 6).alias("coherence"), F.round(F.atan2(s, c) / 2, 6).alias("angle"))


_CELLS = ("a", "b", "c", "d", "tx", "ty")


@query(
    "chromatic_model",
    with_views(
        f"""WITH u AS (SELECT batch, response, i, m[i] AS v FROM (SELECT batch, response, [{", ".join(_CELLS)}] AS m, unnest(range(1, 7)) AS i FROM transforms)),
        c AS (SELECT batch, i, median(v) AS centre, count(*) AS n, median(response) AS sure FROM u GROUP BY ALL),
        d AS (SELECT batch, i, any_value(centre) AS centre, median(abs(v - centre)) AS mad, any_value(n) AS n, any_value(sure) AS sure FROM u JOIN c USING (batch, i) GROUP BY ALL),
        g AS (SELECT batch FROM d GROUP BY batch HAVING max(CASE WHEN i < 5 THEN mad ELSE mad / 1000 END) <= 0.35e0 AND max(sure) >= 0.15e0 AND max(n) >= 3)
        SELECT batch, CAST(i - 1 AS INTEGER) AS cell, round(centre, 6) AS centre, round(mad, 6) AS mad, n, round(sure, 6) AS confidence FROM d SEMI JOIN g USING (batch)""",
        "transforms",
    ),
)
def chromatic_model(spark, sf_dir):
    """A thousandth of a translation stands for the shift between colours."""
    rows = view(spark, sf_dir, "transforms")
    found = R.fixed_model(rows.withColumns({"tx": F.col("tx") / 1000, "ty": F.col("ty") / 1000}), ["batch"], list(_CELLS), "response")
    back = F.when(F.col("cell") < 4, 1).otherwise(1000)
    return found.select("batch", "cell", F.round(F.col("centre") * back, 6).alias("centre"), F.round(F.col("mad") * back, 6).alias("mad"), "n", F.round("confidence", 6).alias("confidence"))


# --- joins and sets of frames, their transforms and revisions

#: A flow's frames: the transform of the same number, whose revision is that of its batch or an older one.
_FLOW = "flow AS (SELECT id AS frame_id, batch AS night, CASE WHEN id % 5 = 0 THEN 1 ELSE 2 END AS revision, CASE WHEN matches >= 4 THEN a END AS a, rms AS flow_rms, inliers FROM transforms)"


def _flow(spark, sf_dir):
    return view(spark, sf_dir, "transforms").selectExpr("id AS frame_id", "batch AS night", "CASE WHEN id % 5 = 0 THEN 1 ELSE 2 END AS revision", "CASE WHEN matches >= 4 THEN a END AS a", "rms AS flow_rms", "inliers")


@query(
    "join_metrics_left",
    with_views(f"WITH {_FLOW} SELECT f.frame_id, coalesce(flow_rms, rms) AS rms, inliers, w.frame_id IS NOT NULL AS in_flow FROM frames f LEFT JOIN flow w USING (frame_id)", "frames", "transforms"),
)
def join_metrics_left(spark, sf_dir):
    """Each frame with the flow's measures; where both have one, the flow's counts."""
    return X.with_flow_metrics(view(spark, sf_dir, "frames"), _flow(spark, sf_dir), "frame_id", {"rms": "flow_rms"}).select("frame_id", "rms", "inliers", "in_flow")


@query(
    "join_transform_inner",
    with_views(f"WITH {_FLOW} SELECT frame_id, f.batch, a FROM frames f JOIN flow USING (frame_id) WHERE revision = 2 AND a IS NOT NULL AND status = 'accepted'", "frames", "transforms"),
)
def join_transform_inner(spark, sf_dir):
    """The accepted frames whose transform is of the revision in force and has a matrix."""
    accepted = view(spark, sf_dir, "frames").where("status = 'accepted'")
    return X.usable_transforms(accepted, _flow(spark, sf_dir), "frame_id", 2, "a").select("frame_id", "batch", "a")


@query(
    "join_revision_anti",
    with_views(f"WITH {_FLOW} SELECT f.batch, count(*) AS failed, min(f.frame_id) AS first FROM frames f ANTI JOIN (SELECT * FROM flow WHERE revision = 2 AND a IS NOT NULL) w USING (frame_id) WHERE status = 'accepted' GROUP BY f.batch", "frames", "transforms"),
)
def join_revision_anti(spark, sf_dir):
    """How many accepted frames of each batch have no usable transform of the revision in force."""
    accepted = view(spark, sf_dir, "frames").where("status = 'accepted'")
    return X.without_transform(accepted, _flow(spark, sf_dir), "frame_id", 2, "a").groupBy("batch").agg(F.count(F.lit(1)).alias("failed"), F.min("frame_id").alias("first"))


@query(
    "join_semi_exists",
    with_views("SELECT frame_id, batch FROM frames f WHERE has_mask AND EXISTS (SELECT 1 FROM transforms t WHERE t.id = f.frame_id) AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = f.frame_id)", "frames", "transforms"),
)
def join_semi_exists(spark, sf_dir):
    """The frames with a mask that have both a transform and pixels."""
    pixel_rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"))
    return X.present_in(view(spark, sf_dir, "frames").where("has_mask"), "frame_id", _flow(spark, sf_dir), pixel_rows).select("frame_id", "batch")


@query(
    "except_disconnected",
    with_views(f"WITH {_FLOW} SELECT DISTINCT frame_id FROM frames WHERE status = 'accepted' EXCEPT SELECT frame_id FROM flow WHERE a IS NOT NULL", "frames", "transforms"),
)
def except_disconnected(spark, sf_dir):
    """The accepted frames that the flow didn't reach."""
    return X.disconnected(view(spark, sf_dir, "frames").where("status = 'accepted'"), _flow(spark, sf_dir).where("a is not null"), "frame_id")


@query("distinct_paths", with_views("SELECT lower(path) AS path, min(seq) AS first, count(*) AS n FROM frames GROUP BY 1", "frames"))
def distinct_paths(spark, sf_dir):
    return view(spark, sf_dir, "frames").groupBy(F.lower("path").alias("path")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))


def _plan_rank(metric: str, lower: bool) -> str:
    share = f"((2 * (rank() OVER (PARTITION BY batch ORDER BY {metric}) - 1) + count(*) OVER (PARTITION BY batch, {metric}) - 1) / 2e0) / greatest(count(*) OVER (PARTITION BY batch) - 1, 1)"
    return f"SELECT frame_id, {R.BALANCED[metric]}::DOUBLE AS w, {'1 - ' + share if lower else share} AS rank FROM frames WHERE {metric} IS NOT NULL"


_PLAN = f"""{TRAIL_SQL},
    pr AS ({" UNION ALL ".join(_plan_rank(m, m in LOWER) for m in R.BALANCED)}),
    ps AS (SELECT f.*, t.trail_class, t.confidence AS sure, (SELECT 1) AS one, s.score FROM frames f JOIN trail t USING (frame_id)
        LEFT JOIN (SELECT frame_id, CASE WHEN sum(w) >= 0.6e0 - 1e-9 THEN sum(w * rank) / sum(w) END AS score FROM pr GROUP BY frame_id) s USING (frame_id)
        SEMI JOIN embeddings e ON e.vec_id = f.frame_id),
    pc AS (SELECT *, count(score) OVER (PARTITION BY batch) AS n_eligible, count(*) OVER (PARTITION BY batch) AS n_all FROM ps WHERE NOT (trail_class = 'severe' AND sure >= 0.8e0)),
    pp AS (SELECT *, CASE WHEN n_eligible > 0 THEN n_eligible ELSE n_all END AS n_of, row_number() OVER (PARTITION BY batch ORDER BY round(score, 9) DESC NULLS LAST, lower(path), path, frame_id) AS place FROM pc WHERE score IS NOT NULL OR n_eligible = 0),
    pw AS (SELECT frame_id, batch AS night, least(greatest((0.25e0 + 0.75e0 * least(greatest(coalesce(score, 1), 0), 1)) * CASE trail_class WHEN 'severe' THEN 0 WHEN 'moderate' THEN 0.65e0 ELSE 1 END, 0), 2) AS raw FROM pp WHERE place <= greatest(least(3, n_of), floor(n_of * 80 / 100e0))),
    px AS (SELECT frame_id AS frame, night, least(greatest(coalesce(raw / (median(CASE WHEN raw > 0 THEN raw END) OVER (PARTITION BY night)), 0.25e0), 0.25e0), 2) AS w FROM pw),
    pv AS (SELECT night, pos, frame, w, CASE WHEN ok THEN v END AS s FROM pixels JOIN px USING (frame)),
    pm AS (SELECT night, pos, median(s) AS c, stddev_pop(s) AS d, count(s) AS n FROM pv GROUP BY ALL),
    pk AS (SELECT night, pos, sum(w * s) / sum(w) AS value FROM pv JOIN pm USING (night, pos) WHERE s IS NOT NULL AND (n < 4 OR NOT coalesce(d > 1e-10, false) OR s BETWEEN c - 3 * d AND c + 3 * d) GROUP BY ALL),
    pz AS (SELECT night, count(*) AS n_frames FROM px GROUP BY night),
    po AS (SELECT night, pos, value, n, n_frames, n >= greatest(1, ceil(0.7e0 * n_frames)) AS valid FROM pk JOIN pm USING (night, pos) JOIN pz USING (night)),
    pl AS (SELECT night, min(CASE WHEN valid THEN value END) AS low, max(CASE WHEN valid THEN value END) AS high FROM po GROUP BY night)"""


@query(
    "stack_plan",
    with_views(f"WITH {_PLAN} SELECT night AS batch, pos, round(value, 6) AS value, n, n_frames, valid, coalesce(CASE WHEN valid AND high > low THEN round((value - low) / (high - low), 5) END, 0) AS level FROM po JOIN pl USING (night)", "frames", "pixels"),
)
def stack_plan(spark, sf_dir):
    """Frames that have pixels, from their metrics to a weighted stack of each batch with its mask. ``level``: the value within the range of the code."""
    found, _ = _stacked(spark, sf_dir)
    level = F.when(F.col("valid") & (F.col("high") > F.col("low")), F.round((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")), 5))
    return found.select("batch", "pos", F.round("value", 6).alias("value"), "n", "n_frames", "valid", F.coalesce(level, F.lit(0.0)).alias("level"))


@query(
    "stack_files",
    with_views(
        f"""WITH {_PLAN} SELECT night AS batch, pos // 8 AS y, pos % 8 AS x, CASE WHEN valid AND high > low THEN CAST(trunc(least(greatest((value - low) / (high - low), 0), 1) * 65535) AS INTEGER) ELSE 0 END AS code, valid, n_frames
        FROM po JOIN pl USING (night)""",
        "frames",
        "pixels",
    ),
)
def stack_files(spark, sf_dir):
    """The same stacks as FITS files with masks and provenance, written and read back."""
    found, chosen = _stacked(spark, sf_dir)
    made = P.provenance(chosen, ["batch"], P.StackPlan())
    rows = found.join(made.drop("n_frames"), "batch").withColumn("saturated", F.lit(False))
    cards = {"BATCH": F.col("batch"), "NFRAMES": F.col("n_frames"), "METHOD": F.col("combination"), "REJECT": F.col("rejection"), "WMAX": F.col("largest_weight")}
    keys = ["batch", "n_frames", "combination", "rejection", "largest_weight"]
    name = F.concat(F.lit("stack_"), F.regexp_replace("batch", "[^A-Za-z0-9]", "_"), F.lit(".fits"))
    folder = shared_folder(spark)
    fits_sink.register(spark)
    fits_sink.image_rows(rows, keys, name, 8, 8, cards).write.format("fits_images").mode("append").save(folder)
    heads = fits.read_headers(spark, folder).select("path", F.element_at("cards", "BATCH").alias("batch"), F.element_at("cards", "NFRAMES").cast("bigint").alias("n_frames"))
    pixel = fits.long_table(fits.read_tiles(spark, folder))
    return pixel.join(heads, "path").select("batch", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("int").alias("code"), F.col("ok").alias("valid"), "n_frames")


def _stacked(spark, sf_dir):
    """The coded stacks, and the frames that they are made of."""
    frames = X.present_in(view(spark, sf_dir, "frames"), "frame_id", spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id")))
    # Scores and trails are relative to all frames of a batch, pixels or not.
    plan = P.StackPlan()
    known = P.annotated(view(spark, sf_dir, "frames"), "frame_id", ["batch"], plan).join(frames.select("frame_id").hint("merge"), "frame_id", "left_semi")
    chosen = P.selected(known, "frame_id", ["batch"], "path", plan).select(F.col("frame_id").alias("frame"), "batch", "stack_weight")
    rows = pixels(spark, sf_dir).drop("batch").join(chosen.select("frame", "batch").hint("merge"), "frame")
    return P.stacked(rows, chosen, ["batch", "pos"], ["batch"], plan), chosen
