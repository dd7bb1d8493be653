"""Edges of registration graphs: matched stars, a similarity, its checks, and another attempt where the first one fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.functions.geometry import GLOBAL_LIMITS, NO_RMS, Affine, Limits, validation
from tesselith.operators import kernels as K
from tesselith.operators import matching as M
from tesselith.operators.ranking import first_per_group
from tesselith.operators.temporal import rolling_median
from tesselith.sources import revisions
from tesselith.staging import stage

CELLS = ("a", "b", "c", "d", "tx", "ty")


@dataclass(frozen=True)
class Inertia:
    """How far a motion may be from the median of those before it, for each step in the sequence."""

    shift: float = 120.0
    rotation: float = 2.0


def recent_motion(motions: DataFrame, batch: list[str], order: list[Column], key: str) -> DataFrame:
    """(key, past_tx, past_ty, past_rotation): medians of up to eight motions (tx, ty, rotation) before each, null where there are fewer than four."""
    out = motions.select(key)
    for name in ("tx", "ty", "rotation"):
        past = rolling_median(motions.where(F.col(name).isNotNull()), batch, order, name).select(key, F.col("rolling").alias(f"past_{name}"))
        out = out.join(past, key, "left")
    return out


def voted_shift(reference: DataFrame, target: DataFrame, edge: str, stars: int = 20, cell: float = 8.0) -> DataFrame:
    """(edge, dx, dy, response): the shift from target to reference that most pairs of bright stars agree on, the peak of the
    correlation of both frames' star maps. ``response`` is the share of the target's stars that agree.

    Both: (edge, star, x, y, flux); the ``stars`` brightest of a frame bound an edge's pairs. Of equal peaks the smaller shift wins."""
    order = [F.col("flux").desc(), F.col("star")]
    r = first_per_group(reference, [edge], order, stars).select(edge, F.col("x").alias("rx"), F.col("y").alias("ry"))
    t = first_per_group(target, [edge], order, stars).select(edge, "star", "x", "y")
    shifts = r.join(t, edge).select(edge, "star", (F.col("rx") - F.col("x")).alias("dx"), (F.col("ry") - F.col("y")).alias("dy"))
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(K.offsets(1)).alias("o")
    votes = shifts.select("*", around).groupBy(edge, (at("dy") + F.col("o.dy")).alias("cy"), (at("dx") + F.col("o.dx")).alias("cx"))
    counted = votes.agg(F.count_distinct("star").alias("n"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    far = F.hypot("dx", "dy")
    best = counted.groupBy(edge).agg(F.max(F.struct("n", (-far).alias("near"), "dx", "dy")).alias("b"))
    seen = t.groupBy(edge).agg(F.count(F.lit(1)).alias("n"))
    return best.join(seen, edge).select(edge, "b.dx", "b.dy", (F.col("b.n") / F.col("n")).alias("response"))


def _fitted(reference: DataFrame, target: DataFrame, edges: DataFrame, edge: str, radius: float, threshold: float) -> DataFrame:
    """The similarity of each edge from the stars that its shift brings within the radius of one of the reference's."""
    stars = target.join(edges.select(edge, "dx", "dy"), edge)
    shifted = stars.select(edge, "star", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    wanted = reference.join(edges.select(edge), edge, "left_semi")
    pairs = M.nearest_matches(shifted, wanted, [edge], radius)
    current = target.select(edge, F.col("star").alias("current"), F.col("x").alias("px"), F.col("y").alias("py"))
    previous = reference.select(edge, F.col("star").alias("previous"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return K.register(pairs.join(current, [edge, "current"]).join(previous, [edge, "previous"]).select(edge, "px", "py", "qx", "qy"), edge, threshold)


def _checked(found: DataFrame, edges: DataFrame, edge: str, area: float, limits: Limits, fewest: int) -> DataFrame:
    """Every edge with its measures; one with too few matches has no similarity."""
    rows = edges.join(found, edge, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    enough = F.col("matches") >= fewest
    rows = rows.withColumns({c: F.when(enough, F.col(c)) for c in (*CELLS, "rms", "area")} | {"inliers": F.when(enough, F.coalesce("inliers", F.lit(0))).otherwise(0)})
    rows = rows.withColumn("ratio", F.coalesce(F.try_divide(F.col("inliers").cast("double"), F.col("matches")), F.lit(0.0)))
    rows = rows.withColumn("spatial", F.coalesce(F.least(F.col("area") / area, F.lit(1.0)), F.lit(0.0))).withColumn("rms", F.coalesce("rms", F.lit(NO_RMS)))
    return rows.withColumn("status", validation(F.col("matches"), F.col("inliers"), F.col("rms"), Affine.of(), limits)).drop("area")


def attempt_edges(reference: DataFrame, target: DataFrame, edges: DataFrame, edge: str, radius: float, area: float, limits: Limits = Limits(), inertia: Inertia = Inertia(), threshold: float = 3.0, fewest: int = 4) -> DataFrame:
    """(edge, status, attempt, matches, inliers, ratio, rms, spatial, a .. ty): one row for each of ``edges``.

    ``reference`` and ``target``: (edge, star, x, y), the stars of both frames of an edge. ``edges``: (edge, dx, dy, primary,
    from_anchor, gap, past_tx, past_ty, past_rotation). A primary edge is tried within the radius, then within twice the
    radius if that fails; others within twice the radius only. A valid transform must keep to the recent motion where that is
    known. Of failed attempts the one of most inliers, then least residual, tells why; without any inliers the phase is
    to blame. Edges of equal ids are one. A null star, x or y has no match."""
    edges, reference, target = stage(edges.dropDuplicates([edge]), "edges"), stage(reference, "reference"), stage(target, "target")

    def attempt(of: DataFrame, within: float, number: int, name: Column) -> DataFrame:
        rows = _checked(_fitted(reference, target, of, edge, within, threshold), of, edge, area, limits, fewest)
        m, gap = Affine.of(), F.greatest(F.col("gap"), F.lit(1))
        far = (F.abs(m.tx - F.col("past_tx")) > inertia.shift * gap) | (F.abs(m.ty - F.col("past_ty")) > inertia.shift * gap) | (F.abs(m.rotation() - F.col("past_rotation")) > inertia.rotation * gap)
        status = F.when((F.col("status") == "accepted") & F.coalesce(far, F.lit(False)), "temporal_validation_failed").otherwise(F.col("status"))
        return rows.select(edge, status.alias("status"), name.alias("attempt"), F.lit(number).alias("number"), "matches", "inliers", "ratio", "rms", "spatial", *CELLS)

    first = stage(attempt(edges.where("primary"), radius, 1, F.lit("normal")), "first")
    again = edges.join(first.where("status = 'accepted'").select(edge), edge, "left_anti")
    wider = F.when(F.col("primary"), "relaxed_radius").when(F.col("from_anchor"), "anchor").otherwise("neighbor")
    second = attempt(again, 2 * radius, 2, wider)
    good = F.col("status") == "accepted"
    # Two attempts an edge at most, so a window's partition holds two rows.
    w = Window.partitionBy(edge).orderBy((~good).cast("int"), F.col("inliers").desc(), "rms", "number")
    best = first.unionByName(second).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "number")
    blame = F.when(~good & (F.col("inliers") == 0), "phase_correlation_failed").otherwise(F.col("status"))
    return best.withColumn("status", blame).withColumns({c: F.when(good, F.col(c)) for c in CELLS})


def global_pairs(master: DataFrame, targets: DataFrame, batch: str, limits: Limits = GLOBAL_LIMITS, threshold: float = 3.0, stars: int = 50, tolerance: float = 0.02, fewest: int = 4) -> DataFrame:
    """(batch, status, matches, inliers, ratio, rms, a .. ty): every target batch against one master, by quads of stars.

    ``master``: (star, x, y, flux), ``targets``: (batch, star, x, y, flux). The master's quads are those of its ``stars``
    brightest stars, so they stay a small table for any number of targets; the targets' are joined with them by
    cells of the hash. A side of fewer than four stars has ``missing_data``."""
    bright = stage(first_per_group(targets, [batch], [F.col("flux").desc(), F.col("star")], stars), "bright")
    one = first_per_group(master.withColumn("_m", F.lit(0)), ["_m"], [F.col("flux").desc(), F.col("star")], stars)
    one = stage(one, "master")
    pairs = M.quad_matches(M.quad_hashes(M.quads(one, ["_m"], stars)).drop("_m"), M.quad_hashes(M.quads(bright, [batch], stars)), [batch], tolerance)
    at = pairs.join(bright.select(batch, F.col("star").alias("target"), F.col("x").alias("px"), F.col("y").alias("py")), [batch, "target"])
    at = at.join(one.select(F.col("star").alias("reference"), F.col("x").alias("qx"), F.col("y").alias("qy")), "reference")
    found = K.register(at.select(batch, "px", "py", "qx", "qy"), batch, threshold)
    enough = bright.groupBy(batch).agg(F.count(F.lit(1)).alias("n_stars")).crossJoin(one.agg(F.count(F.lit(1)).alias("n_master")))  # one row
    rows = _checked(found, enough, batch, 1.0, limits, max(fewest, limits.inliers))
    missing = (F.col("n_stars") < 4) | (F.col("n_master") < 4)
    rows = rows.withColumn("status", F.when(missing, "missing_data").otherwise(F.col("status")))
    good = F.col("status") == "accepted"
    return rows.select(batch, "status", "matches", "inliers", "ratio", "rms", *(F.when(good, F.col(c)).alias(c) for c in CELLS))


def change_references(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges (source, target, a .. ty, method) after batches took other references.

    ``changes``: (batch, r_a .. r_ty), the place of the new reference in the old one's frame. A target's change comes before
    the edge, a source's is undone after it, both if both change. ``method`` tells which edges changed. A change
    that can't be undone, or is null, is none."""
    sound = changes.where(F.abs(F.col("r_a") * F.col("r_d") - F.col("r_b") * F.col("r_c")) > 1e-12).dropDuplicates(["batch"])
    side = lambda name: sound.select(F.col("batch").alias(name), *(F.col(f"r_{c}").alias(f"{name}_{c}") for c in CELLS))
    rows = edges.join(side("target"), "target", "left").join(side("source"), "source", "left")
    one = {c: F.lit(1.0 if c in "ad" else 0.0) for c in CELLS}
    change = lambda name: Affine(*(F.coalesce(F.col(f"{name}_{c}"), one[c]) for c in CELLS))
    m = change("source").inverse().after(Affine.of().after(change("target")))
    changed = F.col("target_a").isNotNull() | F.col("source_a").isNotNull()
    method = F.when(changed & F.col("a").isNotNull(), "reference_rebased").otherwise(F.col("method"))
    kept = [c for c in edges.columns if c not in (*CELLS, "method")]
    return rows.select(*kept, *(F.when(changed, value).otherwise(F.col(c)).alias(c) for c, value in zip(CELLS, (m.a, m.b, m.c, m.d, m.tx, m.ty), strict=True)), method.alias("method"))


def publish_reference_change(spark: SparkSession, root: str, changes: DataFrame, parent: int) -> revisions.Revision:
    """The table ``edges`` of revision ``parent`` under ``root`` after ``changes``, as the next revision, beside the changes themselves.

    No pixels are read. If another revision has been put in force since, there is a Conflict and nothing changes."""
    before = revisions.read(spark, root, "edges", parent)
    after = change_references(before, changes)
    return revisions.publish(spark, root, parent, {"edges": after, "reference_changes": changes}, f"reference-change-{parent + 1}", {"reads_pixels": False})
