"""Queries of the row-wise operators: scans, predicates, scalar math, text and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.functions import geometry, metrics, text
from tesselith.functions.geometry import Affine
from tesselith.plans.inputs import view, with_views
from tesselith.operators import ranking
from tesselith.plans.registry import query

#: SQL for the trail classes of frames: trail (frame_id, batch, trail_class, cause, confidence, penalty).
TRAIL_SQL = """tm AS (SELECT batch, median(roundness) AS rm, median(trail_excess) AS em FROM frames GROUP BY batch),
    td AS (SELECT batch, 1.4826e0 * median(abs(roundness - rm)) AS rs, 1.4826e0 * median(abs(trail_excess - em)) AS es FROM frames JOIN tm USING (batch) GROUP BY batch),
    tx AS (SELECT f.*, coalesce(rm, roundness) AS rm, coalesce(em, trail_excess) AS em, CASE WHEN rs > 0 THEN rs ELSE 0.05e0 END AS rs, CASE WHEN es > 0 THEN es ELSE 0.25e0 END AS es,
        greatest(coalesce(coherence, 0), coalesce(tangential, 0)) AS g,
        CASE WHEN tangential >= greatest(coalesce(coherence, 0), 0.45e0) THEN 'field_rotation' WHEN coherence >= 0.45e0 THEN 'tracking' WHEN elongation >= 1.25e0 THEN 'optical_or_mixed' ELSE 'unclassified' END AS why
        FROM frames f JOIN tm USING (batch) JOIN td USING (batch)),
    tc AS (SELECT *, CASE WHEN star_count IS NULL OR roundness IS NULL OR elongation IS NULL OR trail_excess IS NULL THEN 'unreliable'
        WHEN star_count >= 8 AND roundness <= least(0.65e0, rm - 3 * rs) AND elongation >= 1.5e0 AND trail_excess >= greatest(1, em + 3 * es) AND g >= 0.65e0 THEN 'severe'
        WHEN star_count >= 8 AND roundness <= least(0.75e0, rm - 2 * rs) AND elongation >= 1.25e0 AND trail_excess >= greatest(0.5e0, em + 2 * es) AND g >= 0.4e0 THEN 'moderate'
        WHEN star_count < 8 THEN 'unreliable' ELSE 'none' END AS trail_class FROM tx),
    trail AS (SELECT frame_id, batch, trail_class, CASE trail_class WHEN 'unreliable' THEN 'unclassified' ELSE why END AS cause,
        CASE trail_class WHEN 'unreliable' THEN 0 WHEN 'severe' THEN least(1, 0.55e0 + 0.35e0 * g) WHEN 'moderate' THEN least(1, 0.35e0 + 0.45e0 * g) ELSE least(1, 0.5e0 + 0.3e0 * g) END AS confidence,
        CASE trail_class WHEN 'severe' THEN 0e0 WHEN 'moderate' THEN 0.65e0 ELSE 1e0 END AS penalty FROM tc)"""


@query(
    "scan_sequence_order",
    with_views(
        """SELECT frame_id, batch, row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN regexp_extract(path, '_(\\d+)\\.[^.]*$', 1) = '' THEN 1 ELSE 0 END,
           TRY_CAST(regexp_extract(path, '_(\\d+)\\.[^.]*$', 1) AS BIGINT), lower(path), frame_id) AS place FROM frames""",
        "frames",
    ),
)
def scan_sequence_order(spark, sf_dir):
    from pyspark.sql.window import Window

    frames = view(spark, sf_dir, "frames")
    return frames.select("frame_id", "batch", F.row_number().over(Window.partitionBy("batch").orderBy(*text.sequence_key(F.col("path")), "frame_id")).cast("bigint").alias("place"))


@query(
    "natural_order",
    with_views(
        """SELECT frame_id, batch, row_number() OVER (PARTITION BY batch ORDER BY
             list_transform(regexp_extract_all(lower(path), '(\\d+|\\D+)'), lambda p: {'k': CASE WHEN TRY_CAST(p AS BIGINT) IS NULL THEN 1 ELSE 0 END,
             'n': coalesce(TRY_CAST(p AS BIGINT), 0), 't': p}), frame_id) AS place FROM frames""",
        "frames",
    ),
)
def natural_order(spark, sf_dir):
    from pyspark.sql.window import Window

    return view(spark, sf_dir, "frames").select("frame_id", "batch", F.row_number().over(Window.partitionBy("batch").orderBy(text.natural_key(F.col("path")), "frame_id")).cast("bigint").alias("place"))


@query("scan_batch_counts", with_views("SELECT split_part(path, '/', 1) AS folder, count(*) AS n_frames FROM frames GROUP BY 1", "frames"))
def scan_batch_counts(spark, sf_dir):
    return view(spark, sf_dir, "frames").groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_frames"))


@query(
    "single_format_guard",
    with_views(
        """SELECT batch, count(DISTINCT CASE WHEN lower(regexp_extract(path, '\\.([^.]+)$', 1)) IN ('fit', 'fits', 'fts') THEN 'fits' ELSE 'tiff' END) = 1 AS one_format,
           count(DISTINCT regexp_extract(path, '\\.([^.]+)$', 1)) AS n_suffixes FROM frames GROUP BY batch""",
        "frames",
    ),
)
def single_format_guard(spark, sf_dir):
    suffix = F.regexp_extract("path", r"\.([^.]+)$", 1)
    kind = F.when(F.lower(suffix).isin("fit", "fits", "fts"), "fits").otherwise("tiff")
    return view(spark, sf_dir, "frames").groupBy("batch").agg((F.countDistinct(kind) == 1).alias("one_format"), F.countDistinct(suffix).alias("n_suffixes"))


@query(
    "scale_restore",
    "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS INTEGER) = 7 THEN NULL ELSE round(l_quantity * 1.5e0 + 100e0, 6) END AS physical FROM lineitem",
)
def scale_restore(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    return raw.select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity").cast("int") != 7, F.round(F.col("l_quantity") * 1.5 + 100.0, 6)).alias("physical"))


@query(
    "metric_overlay",
    with_views(
        """SELECT f.frame_id, coalesce(t.rms, f.rms) AS rms, coalesce(t.coverage, f.coverage) AS coverage, f.snr FROM frames f LEFT JOIN transforms t ON f.frame_id = t.id""",
        "frames",
        "transforms",
    ),
)
def metric_overlay(spark, sf_dir):
    side = view(spark, sf_dir, "frames").select("frame_id", "rms", "coverage", "snr")
    flow = view(spark, sf_dir, "transforms").select(F.col("id").alias("frame_id"), F.col("rms").alias("flow_rms"), F.col("coverage").alias("flow_coverage"))
    return side.join(flow, "frame_id", "left").select("frame_id", F.coalesce("flow_rms", "rms").alias("rms"), F.coalesce("flow_coverage", "coverage").alias("coverage"), "snr")


_RAW = "CASE frame_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'n/a' WHEN 3 THEN '-1.5' WHEN 4 THEN cast(frame_id AS string) ELSE '2e3' END"


@query(
    "finite_coerce",
    with_views(f"SELECT frame_id, CASE WHEN isfinite(n) THEN n END AS number, CASE WHEN isfinite(n) THEN n ELSE 0 END AS or_zero FROM (SELECT frame_id, TRY_CAST({_RAW} AS DOUBLE) AS n FROM frames)", "frames"),
)
def finite_coerce(spark, sf_dir):
    raw = view(spark, sf_dir, "frames").selectExpr("frame_id", f"{_RAW} AS raw")
    return raw.select("frame_id", metrics.finite(F.col("raw")).alias("number"), metrics.finite(F.col("raw"), F.lit(0.0)).alias("or_zero"))


@query(
    "metric_alias",
    with_views(
        "SELECT frame_id, coalesce(CASE WHEN frame_id % 4 = 0 THEN fwhm * 2 END, fwhm) AS fwhm, coalesce(rms, coverage) AS alignment_rms FROM frames",
        "frames",
    ),
)
def metric_alias(spark, sf_dir):
    frames = view(spark, sf_dir, "frames").withColumn("shape_fwhm", F.when(F.col("frame_id") % 4 == 0, F.col("fwhm") * 2))
    return frames.select("frame_id", metrics.aliased(frames.columns, "fwhm").alias("fwhm"), metrics.aliased(frames.columns, "alignment_rms", F.col("coverage")).alias("alignment_rms"))


@query(
    "stack_quality",
    with_views(
        """SELECT frame_id, round(CASE WHEN has_mask THEN 1.1e0 ELSE 1 END * CASE WHEN rms > 0 AND rms < 999 THEN q / (1 + rms / 10) ELSE q END, 6) AS quality
           FROM (SELECT *, CASE WHEN fwhm > 0 THEN star_count / greatest(fwhm, 0.1e0) ELSE star_count END AS q FROM frames)""",
        "frames",
    ),
)
def stack_quality(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", F.round(metrics.stack_quality(F.col("star_count"), F.col("fwhm"), F.col("rms"), F.col("has_mask")), 6).alias("quality"))


@query("temporal_quality", with_views("SELECT frame_id, round(coalesce(coverage, star_count / greatest(coalesce(fwhm, 0), 0.1e0)), 6) AS quality FROM frames", "frames"))
def temporal_quality(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", F.round(metrics.temporal_quality(F.col("coverage"), F.col("star_count"), F.col("fwhm")), 6).alias("quality"))


@query("anchor_quality", with_views("SELECT frame_id, round(CASE WHEN fwhm > 0 THEN star_count / fwhm ELSE star_count END, 6) AS quality FROM frames", "frames"))
def anchor_quality(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", F.round(metrics.anchor_quality(F.col("star_count"), F.col("fwhm")), 6).alias("quality"))


@query(
    "trail_filter",
    with_views(
        """SELECT frame_id, CASE WHEN roundness IS NULL OR roundness <= 0 OR roundness > 1 OR star_count < 8 THEN 'missing_shape_measurement' WHEN roundness < 0.6 THEN 'elongated_stars' END AS reason FROM frames""",
        "frames",
    ),
)
def trail_filter(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", metrics.trail_reason(F.col("roundness"), F.col("star_count"), 0.6, 8).alias("reason"))


@query("trail_exclude", with_views(f"WITH {TRAIL_SQL} SELECT frame_id FROM trail WHERE NOT (trail_class = 'severe' AND confidence >= 0.8e0)", "frames"))
def trail_exclude(spark, sf_dir):
    found = ranking.trail_classes(view(spark, sf_dir, "frames"), "frame_id", ["batch"])
    return found.where(~metrics.trail_excluded(F.col("trail_class"), F.col("confidence"))).select("frame_id")


@query(
    "validate_transform",
    with_views(
        """SELECT id, CASE WHEN matches = 0 THEN 'phase_correlation_failed' WHEN matches < 4 THEN 'insufficient_matches' WHEN inliers < 4 THEN 'insufficient_inliers'
           WHEN coalesce(inliers / nullif(matches, 0), 0) < 0.15 THEN 'low_inlier_ratio' WHEN coalesce(CASE WHEN id % 31 > 0 THEN rms END, 999) > 4 THEN 'high_rms'
           WHEN sqrt(tx * tx + ty * ty) > 1500 THEN 'high_translation' WHEN abs(degrees(atan2(c, a))) > 10 THEN 'high_rotation'
           WHEN NOT sqrt(a * a + c * c) BETWEEN 0.95 AND 1.05 THEN 'invalid_scale' ELSE 'accepted' END AS reason FROM transforms""",
        "transforms",
    ),
)
def validate_transform(spark, sf_dir):
    """Fewer than four matches give no matrix; some residuals are unknown."""
    rows = view(spark, sf_dir, "transforms").withColumn("a", F.when(F.col("matches") >= 4, F.col("a"))).withColumn("rms", F.when(F.col("id") % 31 > 0, F.col("rms")))
    return rows.select("id", geometry.validation(F.col("matches"), F.col("inliers"), F.col("rms"), Affine.of()).alias("reason"))


@query(
    "flow_confidence",
    with_views(
        """SELECT id, CASE WHEN inliers / nullif(matches, 0) >= 0.5 AND rms <= 2 AND response >= 0.15 AND spatial >= 0.01 THEN 'accepted' ELSE 'low_confidence' END AS confidence FROM transforms""",
        "transforms",
    ),
)
def flow_confidence(spark, sf_dir):
    ratio = F.try_divide(F.col("inliers").cast("double"), F.col("matches"))
    return view(spark, sf_dir, "transforms").select("id", geometry.confidence(ratio, F.col("rms"), F.col("response"), F.col("spatial")).alias("confidence"))


@query(
    "align_decision",
    with_views(
        """SELECT id, CASE WHEN NOT checked THEN 'unverified' WHEN coverage < 0.2e0 THEN 'insufficient_overlap'
           WHEN response >= 0.15e0 AND rms <= 3 AND sqrt(tx / 1000 * tx / 1000 + ty / 1000 * ty / 1000) <= 1.5 THEN 'verified' ELSE 'failed_quality' END AS decision FROM transforms""",
        "transforms",
    ),
)
def align_decision(spark, sf_dir):
    """The thousandth of a translation stands for the shift that is left after alignment, the phase response for its confidence."""
    c = F.col
    return view(spark, sf_dir, "transforms").select("id", geometry.alignment_decision(c("checked"), c("response"), c("rms"), c("coverage"), c("tx") / 1000, c("ty") / 1000).alias("decision"))


@query(
    "matrix_decompose",
    with_views("SELECT id, tx, ty, round(degrees(atan2(c, a)), 6) AS rotation_deg, round(sqrt(a * a + c * c), 6) AS scale FROM transforms", "transforms"),
)
def matrix_decompose(spark, sf_dir):
    m = Affine.of()
    return view(spark, sf_dir, "transforms").select("id", "tx", "ty", F.round(m.rotation(), 6).alias("rotation_deg"), F.round(m.scale(), 6).alias("scale"))


@query(
    "matrix_compose",
    with_views(
        """SELECT l.id, round(g.a * l.a + g.b * l.c, 6) AS a, round(g.a * l.b + g.b * l.d, 6) AS b, round(g.c * l.a + g.d * l.c, 6) AS c, round(g.c * l.b + g.d * l.d, 6) AS d,
           round(g.a * l.tx + g.b * l.ty + g.tx, 4) AS tx, round(g.c * l.tx + g.d * l.ty + g.ty, 4) AS ty
           FROM transforms l JOIN transforms g ON g.id = l.batch + 1""",
        "transforms",
    ),
)
def matrix_compose(spark, sf_dir):
    local = view(spark, sf_dir, "transforms").select("id", "batch", *Affine.of().columns("l_"))
    whole = view(spark, sf_dir, "transforms").select((F.col("id") - 1).alias("batch"), *Affine.of().columns("g_"))
    m = Affine.of("g_").after(Affine.of("l_"))
    return local.join(whole, "batch").select("id", *m.columns(digits=6)[:4], *m.columns(digits=4)[4:])


@query(
    "matrix_rebase",
    with_views(
        """SELECT id, round(ia * a + ib * c, 6) AS a, round(ia * b + ib * d, 6) AS b, round(ic * a + id_ * c, 6) AS c, round(ic * b + id_ * d, 6) AS d,
           round(ia * (tx - rx) + ib * (ty - ry), 4) AS tx, round(ic * (tx - rx) + id_ * (ty - ry), 4) AS ty
           FROM (SELECT m.*, r.d / (r.a * r.d - r.b * r.c) AS ia, -r.b / (r.a * r.d - r.b * r.c) AS ib, -r.c / (r.a * r.d - r.b * r.c) AS ic, r.a / (r.a * r.d - r.b * r.c) AS id_,
                 r.tx AS rx, r.ty AS ry FROM transforms m JOIN transforms r ON r.id = m.batch + 1)""",
        "transforms",
    ),
)
def matrix_rebase(spark, sf_dir):
    own = view(spark, sf_dir, "transforms").select("id", "batch", *Affine.of().columns("m_"))
    root = view(spark, sf_dir, "transforms").select((F.col("id") - 1).alias("batch"), *Affine.of().columns("r_"))
    m = Affine.of("r_").inverse().after(Affine.of("m_"))
    return own.join(root, "batch").select("id", *m.columns(digits=6)[:4], *m.columns(digits=4)[4:])


@query(
    "score_weight",
    with_views(
        """SELECT frame_id, round(least(greatest((0.25 + 0.75 * least(greatest(coverage, 0), 1)) * CASE WHEN elongation > 2.5e0 THEN 0 WHEN elongation > 1.8e0 THEN 0.65 ELSE 1 END, 0), 2), 6) AS weight FROM frames WHERE coverage IS NOT NULL""",
        "frames",
    ),
)
def score_weight(spark, sf_dir):
    kind = F.when(F.col("elongation") > 2.5, "severe").when(F.col("elongation") > 1.8, "moderate").otherwise("none")
    return view(spark, sf_dir, "frames").where("coverage is not null").select("frame_id", F.round(metrics.score_weight(F.col("coverage"), kind), 6).alias("weight"))


@query("weight_sanitize", with_views("SELECT frame_id, CASE WHEN rms > 0 THEN least(greatest(rms, 0.25e0), 2e0) ELSE 1e0 END AS weight FROM frames", "frames"))
def weight_sanitize(spark, sf_dir):
    return view(spark, sf_dir, "frames").select("frame_id", metrics.sane_weight(F.col("rms")).alias("weight"))


_SPEC = """CASE frame_id % 4 WHEN 0 THEN concat('{"fwhm": ', cast(frame_id % 9 AS string), ', "snr": 0.6, "other": 1}') WHEN 1 THEN concat('fwhm=0.4;roundness=', cast(frame_id % 7 AS string), ',snr=x') WHEN 2 THEN 'snr = 0.25 ; fwhm=-1' ELSE 'nothing' END"""


@query(
    "parse_weights",
    with_views(
        f"""SELECT frame_id, CASE WHEN frame_id % 4 = 0 THEN CASE WHEN frame_id % 9 > 0 THEN cast(frame_id % 9 AS DOUBLE) END WHEN frame_id % 4 = 1 THEN 0.4e0 END AS fwhm,
            CASE WHEN frame_id % 4 = 0 THEN 0.6e0 WHEN frame_id % 4 = 2 THEN 0.25e0 END AS snr,
            CASE WHEN frame_id % 4 = 1 AND frame_id % 7 > 0 THEN cast(frame_id % 7 AS DOUBLE) END AS roundness,
            length({_SPEC}) AS n FROM frames""",
        "frames",
    ),
)
def parse_weights(spark, sf_dir):
    spec = view(spark, sf_dir, "frames").selectExpr("frame_id", f"{_SPEC} AS spec")
    weights = spec.select("frame_id", metrics.parsed_weights(F.col("spec")).alias("w"), F.length("spec").cast("bigint").alias("n"))
    return weights.select("frame_id", *(F.try_element_at("w", F.lit(k)).alias(k) for k in ("fwhm", "snr", "roundness")), "n")


@query(
    "ascii_fold",
    f"""SELECT doc_id, regexp_replace(translate(text, '{text.ACCENTED}', '{text.PLAIN}'), '[^\\x20-\\x7e]', '', 'g') AS folded FROM documents""",
)
def ascii_fold(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.ascii_fold(F.col("text")).alias("folded"))


_STAMP_SPARK = """CASE id % 5 WHEN 0 THEN date_format(ts, "yyyyMMdd'T'HHmmss") WHEN 1 THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '-03:00') WHEN 2 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 3 THEN 'not a timestamp' ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z') END"""


@query(
    "parse_timestamp",
    with_views(
        """SELECT id, CASE WHEN id % 5 <> 3 THEN epoch_us(date_trunc('second', ts)) + CASE WHEN id % 5 = 1 THEN 10800000000 ELSE 0 END END AS micros,
           CASE WHEN id % 5 = 3 THEN 'unknown' ELSE 'valid' END AS state, CASE id % 5 WHEN 1 THEN '-03:00' WHEN 4 THEN 'Z' END AS zone FROM sequence""",
        "sequence",
    ),
)
def parse_timestamp(spark, sf_dir):
    stamped = view(spark, sf_dir, "sequence").selectExpr("id", f"{_STAMP_SPARK} AS stamp")
    micros, state, zone = text.timestamp_state(F.col("stamp"))
    return stamped.select("id", micros.alias("micros"), state.alias("state"), zone.alias("zone"))


@query(
    "fingerprint",
    "SELECT p_partkey, substr(sha256(p_brand || '|' || p_type || '|' || p_size), 1, 16) AS revision FROM part",
)
def fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.fingerprint(F.col("p_brand"), F.col("p_type"), F.col("p_size")).alias("revision"))


@query(
    "stale_check",
    """SELECT a.p_partkey, substr(sha256(a.p_brand || '|' || a.p_size), 1, 16) <> substr(sha256(a.p_brand || '|' || (CASE WHEN a.p_partkey % 9 = 0 THEN a.p_size + 1 ELSE a.p_size END)), 1, 16) AS stale FROM part a""",
)
def stale_check(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.fingerprint(F.col("p_brand"), F.col("p_size")).alias("now"))
    size = F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    then = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.fingerprint(F.col("p_brand"), size).alias("then"))
    return now.join(then, "p_partkey", "left").select("p_partkey", (~F.col("now").eqNullSafe(F.col("then"))).alias("stale"))


@query(
    "json_extract",
    """SELECT event_id, event_type, json_extract_string(props, '$.' || k) AS value, k FROM (SELECT *, unnest(json_keys(props)) AS k FROM events)""",
)
def json_extract(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("m"))
    return events.select("event_id", "event_type", F.explode("m").alias("k", "value"))
