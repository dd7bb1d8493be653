"""Queries of registration: edges between frames, batches against a master, changed references, and where flows are kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.functions import text
from tesselith.functions.geometry import Limits, confidence_reason
from tesselith.operators import edges as E
from tesselith.operators import flow
from tesselith.operators import kernels as K
from tesselith.operators import registration
from tesselith.plans.inputs import pixels, view, with_views
from tesselith.plans.registry import query
from tesselith.sources import revisions
from tesselith.staging import shared_folder


@query("edge_attempts")
def edge_attempts(spark, sf_dir):
    """Each frame of the sky against the one before it, and as a wider probe against the one before that."""
    stars = view(spark, sf_dir, "sky").where("seen").select("frame", "star", "x", "y", "flux")
    frames = stars.select("frame").distinct()
    back = F.explode(F.array(F.lit(1), F.lit(2))).alias("gap")
    pairs = frames.select(F.col("frame").alias("target"), back).select("target", "gap", (F.col("target") - F.col("gap")).alias("reference"))
    pairs = pairs.join(frames.select(F.col("frame").alias("reference")), "reference").withColumn("edge", F.col("target") * 2 + F.col("gap") - 1)
    of = lambda side: pairs.select("edge", F.col(side).alias("frame")).join(stars, "frame").select("edge", "star", "x", "y", "flux")
    reference, target = of("reference"), of("target")
    told = pairs.join(E.voted_shift(reference, target, "edge"), "edge")
    # The motion that the votes tell, which a transform may not be far from.
    run = F.floor(F.col("target") / 1000)
    motions = told.where("gap = 1").select("edge", "target", run.alias("run"), F.col("dx").alias("tx"), F.col("dy").alias("ty"), F.lit(0.0).alias("rotation"))
    past = E.recent_motion(motions, ["run"], [F.col("target")], "edge")
    edges = told.join(past, "edge", "left").select("edge", "dx", "dy", (F.col("gap") == 1).alias("primary"), (F.col("reference") == 0).alias("from_anchor"), "gap", "past_tx", "past_ty", "past_rotation")
    return E.attempt_edges(reference, target, edges, "edge", 12.0, 1e6)


@query("global_pairs")
def global_pairs(spark, sf_dir):
    """All frames of the sky against the first one."""
    stars = view(spark, sf_dir, "sky").where("seen").select("frame", "star", "x", "y", "flux")
    return E.global_pairs(stars.where("frame = 0").drop("frame"), stars.where("frame > 0"), "frame")


#: How the frames of the sky are registered.
_SKY = registration.Flow(height=1400, width=1400, radius=12.0, threshold=3.0, limits=Limits(inliers=12))


def _sky_batches(spark, sf_dir):
    """Twenty frames of the sky a batch, the eighth its anchor. Every eleventh frame shows other stars, every thirteenth hardly any."""
    stars = view(spark, sf_dir, "sky").where("seen AND (frame % 13 <> 6 OR star < 3)")
    odd = F.col("frame") % 11 == 5
    x, y = F.when(odd, F.col("x") * 31 % 1000).otherwise(F.col("x") + 100), F.when(odd, F.col("y") * 17 % 1000).otherwise(F.col("y") + 150)
    # A frame has a hundred stars at most.
    rows = stars.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(x.alias("x"), y.alias("y"), "flux"))).alias("stars"))
    return rows.select(F.floor(F.col("frame") / 20).alias("batch"), (F.col("frame") % 20).cast("int").alias("place"), "stars", (F.col("frame") % 20 == 7).alias("anchor"))


@query("flow_chain")
def flow_chain(spark, sf_dir):
    """Each frame of a batch against the last accepted one."""
    return registration.chain(_sky_batches(spark, sf_dir), _SKY)


@query("flow_tree")
def flow_tree(spark, sf_dir):
    """A tree of each batch's frames, grown from its anchor by making edges."""
    return registration.tree(_sky_batches(spark, sf_dir), _SKY)


_CHANGED = with_views(
    """WITH e AS (SELECT id, batch AS source, (batch + id % 5 + 1) % 25 AS target, a, b, c, d, tx, ty FROM transforms),
    ch AS (SELECT batch, a, b, c, d, tx, ty, a * d - b * c AS k FROM transforms WHERE batch % 3 = 0 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY id) = 1),
    t AS (SELECT e.id, e.source, e.target, e.a IS NOT NULL AND r.batch IS NOT NULL AS moved, CASE WHEN r.batch IS NULL THEN e.a ELSE e.a * r.a + e.b * r.c END AS a, CASE WHEN r.batch IS NULL THEN e.b ELSE e.a * r.b + e.b * r.d END AS b,
        CASE WHEN r.batch IS NULL THEN e.c ELSE e.c * r.a + e.d * r.c END AS c, CASE WHEN r.batch IS NULL THEN e.d ELSE e.c * r.b + e.d * r.d END AS d,
        CASE WHEN r.batch IS NULL THEN e.tx ELSE e.a * r.tx + e.b * r.ty + e.tx END AS tx, CASE WHEN r.batch IS NULL THEN e.ty ELSE e.c * r.tx + e.d * r.ty + e.ty END AS ty FROM e LEFT JOIN ch r ON r.batch = e.target)
    SELECT t.id, t.source, t.target, CASE WHEN moved OR r.batch IS NOT NULL THEN 'reference_rebased' ELSE 'direct' END AS method,
        round(CASE WHEN r.batch IS NULL THEN t.a ELSE (r.d * t.a - r.b * t.c) / k END, 5) AS a, round(CASE WHEN r.batch IS NULL THEN t.b ELSE (r.d * t.b - r.b * t.d) / k END, 5) AS b,
        round(CASE WHEN r.batch IS NULL THEN t.c ELSE (r.a * t.c - r.c * t.a) / k END, 5) AS c, round(CASE WHEN r.batch IS NULL THEN t.d ELSE (r.a * t.d - r.c * t.b) / k END, 5) AS d,
        round(CASE WHEN r.batch IS NULL THEN t.tx ELSE (r.d * (t.tx - r.tx) - r.b * (t.ty - r.ty)) / k END, 4) AS tx, round(CASE WHEN r.batch IS NULL THEN t.ty ELSE (r.a * (t.ty - r.ty) - r.c * (t.tx - r.tx)) / k END, 4) AS ty
    FROM t LEFT JOIN ch r ON r.batch = t.source""",
    "transforms",
)


def _reference_tables(spark, sf_dir):
    rows = view(spark, sf_dir, "transforms")
    edges = rows.select("id", F.col("batch").alias("source"), ((F.col("batch") + F.col("id") % 5 + 1) % 25).alias("target"), *E.CELLS, F.lit("direct").alias("method"))
    changes = rows.where("batch % 3 = 0").groupBy("batch").agg(*(F.min_by(c, "id").alias(f"r_{c}") for c in E.CELLS))
    return edges, changes


def _in_digits(out):
    return out.select("id", "source", "target", "method", *(F.round(c, 5).alias(c) for c in "abcd"), *(F.round(c, 4).alias(c) for c in ("tx", "ty")))


@query("reference_change", _CHANGED)
def reference_change(spark, sf_dir):
    """Edges between batches after a third of the batches took the first of their frames for a reference."""
    return _in_digits(E.change_references(*_reference_tables(spark, sf_dir)))


@query("reference_publish", _CHANGED)
def reference_publish(spark, sf_dir):
    """The same by way of published revisions: the edges, then the change of their references, then what is in force."""
    edges, changes = _reference_tables(spark, sf_dir)
    root = shared_folder(spark)
    first = revisions.publish(spark, root, None, {"edges": edges}, "flow")
    E.publish_reference_change(spark, root, changes, first.version)
    return _in_digits(revisions.read(spark, root, "edges"))


@query(
    "confidence_reason",
    with_views(
        "SELECT id, printf('phase_response=%.4f; inlier_coverage=%.3f; rms=%.3f; spatial_coverage=%.4f; motion=plausible', response, CASE WHEN matches > 0 THEN inliers / matches ELSE 0e0 END, CASE WHEN checked THEN rms ELSE 999e0 END, spatial) AS reason FROM transforms",
        "transforms",
    ),
)
def confidence_reasons(spark, sf_dir):
    ratio = F.try_divide(F.col("inliers").cast("double"), F.col("matches"))
    return view(spark, sf_dir, "transforms").select("id", confidence_reason(F.col("response"), ratio, F.when(F.col("checked"), F.col("rms")), F.col("spatial")).alias("reason"))


@query(
    "json_safe",
    with_views("""SELECT id, '{"rms":' || CASE WHEN id % 4 = 0 THEN 'null' ELSE CAST(rms AS VARCHAR) END || ',"response":' || CASE WHEN id % 6 = 0 THEN 'null' ELSE CAST(response AS VARCHAR) END || '}' AS json FROM transforms""", "transforms"),
)
def json_safe(spark, sf_dir):
    """Measures some of which aren't numbers or aren't finite."""
    rms = F.when(F.col("id") % 4 == 0, float("nan")).otherwise(F.col("rms"))
    response = F.when(F.col("id") % 12 == 0, float("-inf")).when(F.col("id") % 6 == 0, float("inf")).otherwise(F.col("response"))
    return view(spark, sf_dir, "transforms").select("id", text.json_safe({"rms": rms, "response": response}).alias("json"))


_NAMED = "CASE frame_id % 7 WHEN 0 THEN ' rggb ' WHEN 1 THEN '''BGGR''' WHEN 2 THEN 'MONO' WHEN 3 THEN 'grbg' WHEN 4 THEN '' WHEN 5 THEN 'GBRG' END"
_OTHER = "CASE frame_id % 3 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'none' END"


@query(
    "bayer_pattern",
    with_views(
        """SELECT frame_id, coalesce(CASE frame_id % 7 WHEN 0 THEN 'RGGB' WHEN 1 THEN 'BGGR' WHEN 3 THEN 'GRBG' WHEN 5 THEN 'GBRG' END, CASE WHEN frame_id % 3 = 0 THEN 'RGGB' END, CASE WHEN frame_id % 5 = 0 THEN 'GBRG' END) AS pattern FROM frames""", "frames"
    ),
)
def bayer_pattern(spark, sf_dir):
    """Three cards, of which some are missing or name none."""
    cards = [F.expr(_NAMED), F.expr(_OTHER), F.when(F.col("frame_id") % 5 == 0, "gbrg")]
    return view(spark, sf_dir, "frames").select("frame_id", text.mosaic(*cards).alias("pattern"))


_FLOWS = """f AS (SELECT frame_id, cast(floor(frame_id / 10) AS bigint) AS k FROM frames), b AS (SELECT DISTINCT 'batch_' || k AS batch, k FROM f),
    night AS (SELECT batch, 'revisions/' || k || '/flow_local.json' AS path FROM b WHERE k % 3 = 0), own AS (SELECT batch, batch || '/own.json' AS path FROM b WHERE k % 2 = 0)"""


def _flow_tables(spark, sf_dir):
    """A batch for each ten frames, some named in a manifest of the night, some in one of their own."""
    batches = view(spark, sf_dir, "frames").select(F.floor(F.col("frame_id") / 10).alias("k")).distinct().select("k", F.concat(F.lit("batch_"), "k").alias("batch"))
    night = batches.where("k % 3 = 0").select("batch", F.concat(F.lit("revisions/"), "k", F.lit("/flow_local.json")).alias("path"))
    own = batches.where("k % 2 = 0").select("batch", F.concat("batch", F.lit("/own.json")).alias("path"))
    return batches, night, own


@query(
    "flow_resolution",
    with_views(
        f"""WITH {_FLOWS} SELECT b.batch, coalesce(night.path, own.path, b.batch || '/flow_local.json') AS path, CASE WHEN night.path IS NOT NULL THEN 'manifest' WHEN own.path IS NOT NULL THEN 'batch_manifest' ELSE 'legacy' END AS origin,
        CASE WHEN night.path IS NOT NULL THEN k % 5 <> 0 WHEN own.path IS NOT NULL THEN k % 7 <> 0 ELSE k % 11 <> 0 END AS found FROM b LEFT JOIN night USING (batch) LEFT JOIN own USING (batch)""",
        "frames",
    ),
)
def flow_resolution(spark, sf_dir):
    batches, night, own = _flow_tables(spark, sf_dir)
    at = lambda rows, n: rows.join(batches, "batch").where(f"k % {n} <> 0").select("path")
    legacy = batches.select("batch", F.concat("batch", F.lit("/flow_local.json")).alias("path"))
    return flow.active_flows(batches, night, own, at(night, 5).unionByName(at(own, 7)).unionByName(at(legacy, 11)))


@query(
    "union_batches",
    with_views(f"WITH {_FLOWS} SELECT b.batch, coalesce(night.path, b.batch || '/flow_local.json') AS path FROM b LEFT JOIN night USING (batch) WHERE night.path IS NOT NULL OR k % 4 <> 0", "frames"),
)
def union_batches(spark, sf_dir):
    batches, night, _ = _flow_tables(spark, sf_dir)
    return flow.all_batches(batches.where("k % 4 <> 0").select("batch", F.concat("batch", F.lit("/flow_local.json")).alias("path")), night)


_MESH = """box AS (SELECT frame, y // 4 AS by_, x // 4 AS bx, count(*) FILTER (ok) * 2 >= count(*) AS counts FROM pixels GROUP BY ALL),
    s0 AS (SELECT frame, y // 4 AS by_, x // 4 AS bx, v FROM pixels WHERE ok)"""


def _clip(rounds: int, sigma: float) -> str:
    return ", ".join(f"c{i} AS (SELECT frame, by_, bx, median(v) AS c, stddev_pop(v) AS d FROM s{i} GROUP BY ALL), s{i + 1} AS (SELECT frame, by_, bx, v FROM s{i} JOIN c{i} USING (frame, by_, bx) WHERE abs(v - c) <= {sigma} * d OR NOT d > 1e-10)" for i in range(rounds))


@query(
    "background_flatten",
    with_views(
        f"""WITH {_MESH}, {_clip(3, 1.5)}, m AS (SELECT frame, by_, bx, median(v) AS level FROM s3 JOIN box USING (frame, by_, bx) WHERE counts GROUP BY ALL),
        f AS (SELECT a.frame, a.by_, a.bx, median(b.level) AS level FROM (SELECT DISTINCT frame, by_, bx FROM box) a JOIN m b ON a.frame = b.frame AND abs(a.by_ - b.by_) <= 1 AND abs(a.bx - b.bx) <= 1 GROUP BY ALL),
        p AS (SELECT frame, y, x, v, least(greatest((y + 0.5e0) / 4 - 0.5e0, 0e0), 1e0) AS gy, least(greatest((x + 0.5e0) / 4 - 0.5e0, 0e0), 1e0) AS gx FROM pixels),
        w AS (SELECT p.frame, p.y, p.x, p.v, (CASE f.by_ WHEN 0 THEN 1 - gy ELSE gy END) * (CASE f.bx WHEN 0 THEN 1 - gx ELSE gx END) AS w, level FROM p LEFT JOIN f USING (frame))
        SELECT frame, y, x, round(any_value(v) - coalesce(sum(w * level) / sum(w), 0), 5) AS v, round(sum(w * level) / sum(w), 5) AS background FROM w WHERE w > 0 GROUP BY frame, y, x""",
        "pixels",
    ),
)
def background_flatten(spark, sf_dir):
    flat = K.flatten(pixels(spark, sf_dir), ["frame"], 8, 8, 4, 1.5)
    return flat.select("frame", "y", "x", F.round("v", 5).alias("v"), F.round("background", 5).alias("background"))


@query("detect_adaptive")
def detect_adaptive(spark, sf_dir):
    """At least three regions in each of the embeddings as 8 by 8 frames, from a threshold of 3 down to 1."""
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("data"))
    return K.detect_adaptive(frames, 8, 8, 3, 3.0, 1.0, 0.5)
