"""Queries of point matching, star shapes and transform graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.functions.geometry import Affine
from tesselith.operators import graphs as G
from tesselith.operators import matching as M
from tesselith.plans.inputs import pixels, view, with_views
from tesselith.plans.registry import query


@query(
    "nn_match",
    with_views(
        """WITH p AS (SELECT a.frame, a.star AS cur, b.star AS prev, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM stars a JOIN stars b ON a.frame = b.frame + 1 AND abs(a.x - b.x) < 12 AND abs(a.y - b.y) < 12),
        o AS (SELECT * FROM p WHERE d < 12 QUALIFY row_number() OVER (PARTITION BY cur ORDER BY round(d, 9), prev) = 1)
        SELECT frame, cur AS current, prev AS previous, round(d, 6) AS dist FROM o QUALIFY row_number() OVER (PARTITION BY prev ORDER BY round(d, 9), cur) = 1""",
        "stars",
    ),
)
def nn_match(spark, sf_dir):
    stars = view(spark, sf_dir, "stars")
    found = M.nearest_matches(stars, stars.withColumn("frame", F.col("frame") + 1), ["frame"], 12.0)
    return found.select("frame", "current", "previous", F.round("dist", 6).alias("dist"))


@query(
    "spatial_nms",
    with_views(
        """WITH o AS (SELECT frame, list([{'star': star, 'x': x, 'y': y}] ORDER BY flux DESC, star) AS stars FROM stars GROUP BY frame),
        k AS (SELECT frame, list_reduce(stars, lambda kept, s: CASE WHEN len(list_filter(kept, lambda k: sqrt(pow(k.x - s[1].x, 2) + pow(k.y - s[1].y, 2)) < 25)) > 0 THEN kept ELSE list_concat(kept, s) END) AS kept FROM o)
        SELECT frame, s.star AS star FROM (SELECT frame, unnest(kept) AS s FROM k)""",
        "stars",
    ),
)
def spatial_nms(spark, sf_dir):
    return M.suppress_close(view(spark, sf_dir, "stars"), ["frame"], 25.0, "flux")


_QUADS = """br AS (SELECT * FROM star_frames QUALIFY row_number() OVER (PARTITION BY frame ORDER BY flux DESC, star) <= 50),
    knn AS (SELECT a.frame, a.star AS of, b.star, b.x, b.y FROM br a JOIN br b USING (frame) QUALIFY row_number() OVER (PARTITION BY a.frame, a.star ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.star) <= 8),
    q AS (SELECT DISTINCT a.frame, a.star AS sa, a.x AS xa, a.y AS ya, b.star AS sb, b.x AS xb, b.y AS yb, c.star AS sc, c.x AS xc, c.y AS yc, d.star AS sd, d.x AS xd, d.y AS yd
        FROM knn a JOIN knn b ON a.frame = b.frame AND a.of = b.of AND a.star < b.star JOIN knn c ON a.frame = c.frame AND a.of = c.of AND b.star < c.star JOIN knn d ON a.frame = d.frame AND a.of = d.of AND c.star < d.star)"""


@query("quad_enumerate", with_views(f"WITH {_QUADS} SELECT frame, sa AS a, sb AS b, sc AS c, sd AS d FROM q", "star_frames"))
def quad_enumerate(spark, sf_dir):
    return M.quads(view(spark, sf_dir, "star_frames"), ["frame"], 50).select("frame", *(F.col(f"{n}.star").alias(n) for n in "abcd"))


def _pair(i: int, p: str, q: str, r: str, s: str) -> str:
    return f"SELECT frame, sa, sb, sc, sd, {i} AS o, sqrt(pow(x{p} - x{q}, 2) + pow(y{p} - y{q}, 2)) AS len, x{p} AS px, y{p} AS py, x{q} AS qx, y{q} AS qy, x{r} AS rx, y{r} AS ry, x{s} AS sx, y{s} AS sy FROM q"


_HASH = f"""{_QUADS}, o AS ({" UNION ALL ".join(_pair(i, *p) for i, p in enumerate(("abcd", "acbd", "adbc", "bcad", "bdac", "cdab")))}),
    b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY frame, sa, sb, sc, sd ORDER BY len DESC, o) = 1),
    t AS (SELECT *, (px > qx OR (px = qx AND py > qy)) AS turn FROM b),
    v AS (SELECT frame, sa, sb, sc, sd, rx, ry, sx, sy, CASE WHEN turn THEN qx ELSE px END AS ax, CASE WHEN turn THEN qy ELSE py END AS ay, CASE WHEN turn THEN px - qx ELSE qx - px END AS dx, CASE WHEN turn THEN py - qy ELSE qy - py END AS dy FROM t),
    n AS (SELECT frame, sa, sb, sc, sd, ((rx - ax) * dx + (ry - ay) * dy) / (dx * dx + dy * dy) AS u1, ((ry - ay) * dx - (rx - ax) * dy) / (dx * dx + dy * dy) AS v1,
        ((sx - ax) * dx + (sy - ay) * dy) / (dx * dx + dy * dy) AS u2, ((sy - ay) * dx - (sx - ax) * dy) / (dx * dx + dy * dy) AS v2 FROM v)"""


@query(
    "quad_hash",
    with_views(
        f"""WITH {_HASH} SELECT frame, sa AS a, sb AS b, sc AS c, sd AS d, round(CASE WHEN w THEN u2 ELSE u1 END, 6) AS h1, round(CASE WHEN w THEN v2 ELSE v1 END, 6) AS h2,
        round(CASE WHEN w THEN u1 ELSE u2 END, 6) AS h3, round(CASE WHEN w THEN v1 ELSE v2 END, 6) AS h4 FROM (SELECT *, (u1 > u2 OR (u1 = u2 AND v1 > v2)) AS w FROM n)""",
        "star_frames",
    ),
)
def quad_hash(spark, sf_dir):
    hashed = M.quad_hashes(M.quads(view(spark, sf_dir, "star_frames"), ["frame"], 50))
    return hashed.select("frame", *(F.col(f"{n}.star").alias(n) for n in "abcd"), *(F.round(f"h{i}", 6).alias(f"h{i}") for i in range(1, 5)))


@query("quad_match")
def quad_match(spark, sf_dir):
    """Stars of each frame against a turned and doubled copy of them, some of whose stars are moved."""
    stars = view(spark, sf_dir, "star_frames")
    moved = F.when(F.col("star") % 25 == 0, 40.0).otherwise(0.0)
    copy = stars.select("star", "frame", (2 * F.col("x") * 0.8 - 2 * F.col("y") * 0.6 + 90 + moved).alias("x"), (2 * F.col("x") * 0.6 + 2 * F.col("y") * 0.8 - 30).alias("y"), "flux")
    return M.quad_matches(M.quad_hashes(M.quads(stars, ["frame"], 60)), M.quad_hashes(M.quads(copy, ["frame"], 60)), ["frame"])


@query(
    "star_moments",
    with_views(
        """WITH b AS (SELECT frame, median(v) AS m FROM pixels GROUP BY frame), w AS (SELECT frame, x, y, greatest(v - m, 0) AS w FROM pixels JOIN b USING (frame)),
        c AS (SELECT frame, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy FROM w GROUP BY frame),
        s AS (SELECT frame, any_value(cx) AS cx, any_value(cy) AS cy, sum(w * pow(x - cx, 2)) / sum(w) AS xx, sum(w * pow(y - cy, 2)) / sum(w) AS yy, sum(w * (x - cx) * (y - cy)) / sum(w) AS xy, sum(w) AS flux FROM w JOIN c USING (frame) GROUP BY frame)
        SELECT frame, round(cx, 5) AS cx, round(cy, 5) AS cy, round(flux, 5) AS flux, round(sqrt(l2 / l1), 5) AS roundness, round(sqrt(l1 / l2), 5) AS elongation FROM (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l1, (xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS l2 FROM s)""",
        "pixels",
    ),
)
def star_moments(spark, sf_dir):
    """Second moments of what rises over the background; the axes are the eigenvalues of a 2 x 2 matrix."""
    stack = pixels(spark, sf_dir)
    base = stack.groupBy("frame").agg(F.median("v").alias("m"))
    rows = stack.join(base, "frame").select("frame", "x", "y", F.greatest(F.col("v") - F.col("m"), F.lit(0.0)).alias("w"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = rows.groupBy("frame").agg(F.sum(w).alias("flux"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    s = sums.where("flux > 0").withColumn("cx", F.col("sx") / F.col("flux")).withColumn("cy", F.col("sy") / F.col("flux"))
    xx, yy, xy = F.col("sxx") / F.col("flux") - F.col("cx") * F.col("cx"), F.col("syy") / F.col("flux") - F.col("cy") * F.col("cy"), F.col("sxy") / F.col("flux") - F.col("cx") * F.col("cy")
    root = F.sqrt(F.pow((xx - yy) / 2, 2) + xy * xy)
    s = s.withColumn("l1", (xx + yy) / 2 + root).withColumn("l2", (xx + yy) / 2 - root)
    return s.select("frame", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round("flux", 5).alias("flux"), F.round(F.sqrt(F.col("l2") / F.col("l1")), 5).alias("roundness"), F.round(F.sqrt(F.col("l1") / F.col("l2")), 5).alias("elongation"))


@query(
    "align_rms",
    with_views(
        """WITH f AS (SELECT frame, avg(v) AS m, stddev_pop(v) AS s FROM pixels WHERE ok GROUP BY frame), z AS (SELECT frame, pos, ok, (v - m) / s AS z FROM pixels JOIN f USING (frame))
        SELECT a.frame, round(count(*) FILTER (a.ok AND b.ok) / count(*), 6) AS coverage, round(sqrt(avg(CASE WHEN a.ok AND b.ok THEN pow(a.z - b.z, 2) END)), 6) AS rms FROM z a JOIN z b ON b.frame = a.frame - a.frame % 10 AND a.pos = b.pos GROUP BY a.frame""",
        "pixels",
    ),
)
def align_rms(spark, sf_dir):
    """Coverage and residual of each frame against the first of its ten, both standardised."""
    stack = pixels(spark, sf_dir)
    stats = stack.where("ok").groupBy("frame").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = stack.join(stats, "frame").select("frame", "pos", "ok", F.try_divide(F.col("v") - F.col("m"), F.nullif(F.col("s"), F.lit(0.0))).alias("z"))
    reference = z.where("frame % 10 = 0").select(F.col("frame").alias("of"), "pos", F.col("ok").alias("r_ok"), F.col("z").alias("r"))
    both = z.withColumn("of", F.col("frame") - F.col("frame") % 10).join(reference, ["of", "pos"])
    fine = F.col("ok") & F.col("r_ok")
    return both.groupBy("frame").agg(F.round(F.count_if(fine) / F.count(F.lit(1)), 6).alias("coverage"), F.round(F.sqrt(F.avg(F.when(fine, F.pow(F.col("z") - F.col("r"), 2)))), 6).alias("rms"))


# --- graphs: in each brand, a frame hangs on the one before it in sequence

_EDGES = """e AS (SELECT frame_id AS node, lag(frame_id) OVER (PARTITION BY batch ORDER BY seq) AS parent, batch, coalesce(rms, 0.5e0) AS rms,
    1e0 AS a, 0e0 AS b, 0e0 AS c, 1e0 AS d, cast(frame_id % 7 - 3 AS DOUBLE) AS tx, cast(frame_id % 5 - 2 AS DOUBLE) AS ty FROM frames)"""
_WALK = f"""{_EDGES}, r AS (SELECT node, node AS root, batch, 0e0 AS tx, 0e0 AS ty, CAST(0 AS BIGINT) AS hops, 0e0 AS sq FROM e WHERE parent IS NULL
    UNION ALL SELECT e.node, r.root, e.batch, r.tx + e.tx, r.ty + e.ty, r.hops + 1, r.sq + e.rms * e.rms FROM r JOIN e ON e.parent = r.node)"""


def _edges(spark, sf_dir):
    w = Window.partitionBy("batch").orderBy("seq")
    frames = view(spark, sf_dir, "frames")
    return frames.select(
        F.col("frame_id").alias("node"), F.lag("frame_id").over(w).alias("parent"), "batch", F.coalesce("rms", F.lit(0.5)).alias("rms"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), (F.col("frame_id") % 7 - 3).cast("double").alias("tx"), (F.col("frame_id") % 5 - 2).cast("double").alias("ty")
    )


@query("graph_cumulative", with_views(f"WITH RECURSIVE {_WALK} SELECT node, root, hops, round(sqrt(sq), 6) AS cumulative_rms, tx, ty FROM r", "frames"))
def graph_cumulative(spark, sf_dir):
    return G.to_root(_edges(spark, sf_dir)).select("node", "root", "hops", F.round("cumulative_rms", 6).alias("cumulative_rms"), "tx", "ty")


@query(
    "graph_rebase",
    with_views(f"WITH RECURSIVE {_WALK}, m AS (SELECT batch, max(node) AS ref FROM r GROUP BY batch), b AS (SELECT m.batch, m.ref, r.tx, r.ty FROM m JOIN r ON r.node = m.ref) SELECT r.node, b.ref AS root, r.tx - b.tx AS tx, r.ty - b.ty AS ty FROM r JOIN b USING (batch)", "frames"),
)
def graph_rebase(spark, sf_dir):
    paths = G.to_root(_edges(spark, sf_dir))
    last = paths.groupBy("root").agg(F.max("node").alias("reference"))
    return G.rebase(paths, last).select("node", "root", "tx", "ty")


@query(
    "graph_adjacency",
    with_views(f"WITH {_EDGES} SELECT node AS source, parent AS target, tx, ty FROM e WHERE parent IS NOT NULL UNION ALL SELECT parent, node, 0e0 - tx, 0e0 - ty FROM e WHERE parent IS NOT NULL", "frames"),
)
def graph_adjacency(spark, sf_dir):
    both = G.adjacency(_edges(spark, sf_dir).where("parent is not null"))
    return both.select("source", "target", (F.col("tx") + 0.0).alias("tx"), (F.col("ty") + 0.0).alias("ty"))


_RUNS = """o AS (SELECT frame_id, batch, seq, frame_id % 9 = 0 AS seed, coalesce(rms < 2.5, false) AS linked, row_number() OVER (PARTITION BY batch ORDER BY seq) AS place FROM frames),
    g AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY batch ORDER BY seq) AS run FROM o)"""


@query(
    "graph_seed_expand",
    with_views(
        f"""WITH {_RUNS} SELECT a.frame_id, min(abs(a.place - b.place)) AS hops, CASE WHEN any_value(a.seed) THEN 'master_direct' WHEN count(b.frame_id) > 0 THEN 'neighbor_chain' ELSE 'rejected' END AS state
        FROM g a LEFT JOIN g b ON a.batch = b.batch AND a.run = b.run AND b.seed GROUP BY a.frame_id""",
        "frames",
    ),
)
def graph_seed_expand(spark, sf_dir):
    nodes = view(spark, sf_dir, "frames").select("frame_id", "batch", "seq", (F.col("frame_id") % 9 == 0).alias("seed"), F.coalesce(F.col("rms") < 2.5, F.lit(False)).alias("linked"))
    return G.seed_and_expand(nodes, ["batch"], "seq", "seed", "linked").select("frame_id", "hops", "state")


_GROWN = """n AS (SELECT batch, id AS node, row_number() OVER (PARTITION BY batch ORDER BY id) AS place FROM transforms),
    e AS (SELECT a.batch, a.node, b.node AS other, abs(a.place - b.place) AS distance, b.place = 1 AS anchor, (a.node * b.node) % 17 / 10e0 AS rms, (a.node + b.node) % 4 <> 0 AS works FROM n a JOIN n b ON a.batch = b.batch AND abs(a.place - b.place) BETWEEN 1 AND 3),
    r AS (SELECT 0 AS round, batch, node, CAST(NULL AS BIGINT) AS parent, 0 AS hops, 0e0 AS square FROM n WHERE place = 1
        UNION ALL
        SELECT round + 1, batch, node, parent, hops, square FROM (
            WITH open AS (SELECT t.round, e.batch, e.node, e.other, e.distance, e.anchor, e.works, t.hops + 1 AS hops, t.square + e.rms * e.rms AS square FROM e JOIN r t ON t.batch = e.batch AND t.node = e.other WHERE NOT EXISTS (SELECT 1 FROM r u WHERE u.batch = e.batch AND u.node = e.node)),
            looked AS (SELECT * FROM open QUALIFY anchor OR row_number() OVER (PARTITION BY batch, node ORDER BY distance > 1, hops, distance, other) <= 3),
            new AS (SELECT * FROM looked WHERE works QUALIFY row_number() OVER (PARTITION BY batch, node ORDER BY hops, square, distance, other) = 1)
            SELECT round, batch, node, other AS parent, hops, square FROM new UNION ALL SELECT round, batch, node, parent, hops, square FROM r WHERE EXISTS (SELECT 1 FROM new)))"""


@query("graph_bfs", with_views(f"WITH RECURSIVE {_GROWN} SELECT batch, node, parent, hops, round(sqrt(square), 6) AS cumulative_rms FROM r WHERE round = (SELECT max(round) FROM r)", "transforms"))
def graph_bfs(spark, sf_dir):
    """Suppliers of a nation in order; edges reach three places, and some don't work."""
    w = Window.partitionBy("batch").orderBy("id")
    nodes = view(spark, sf_dir, "transforms").select("batch", F.col("id").alias("node"), F.row_number().over(w).cast("bigint").alias("place")).withColumn("anchor", F.col("place") == 1)
    other = nodes.select("batch", F.col("node").alias("other"), F.col("place").alias("other_place"))
    shifts = F.explode(F.array(*(F.lit(i) for i in (-3, -2, -1, 1, 2, 3))))
    pairs = nodes.select("batch", "node", "place", shifts.alias("shift")).withColumn("other_place", F.col("place") + F.col("shift")).join(other, ["batch", "other_place"])
    edges = pairs.select("batch", "node", "other", ((F.col("node") * F.col("other")) % 17 / 10.0).alias("rms"), ((F.col("node") + F.col("other")) % 4 != 0).alias("works"))
    return G.grow(nodes, edges).withColumn("cumulative_rms", F.round("cumulative_rms", 6))


_CROSS = """x AS (SELECT l.id, g.a AS ga, g.b AS gb, g.c AS gc, g.d AS gd, g.tx AS gx, g.ty AS gy, l.a, l.b, l.c, l.d, l.tx, l.ty FROM transforms l JOIN transforms g ON g.id = l.id + 1)"""


@query(
    "closure_check",
    with_views(f"WITH {_CROSS} SELECT id, round(sqrt((pow(ga - a, 2) + pow(gb - b, 2) + pow(gc - c, 2) + pow(gd - d, 2) + pow(gx - tx, 2) + pow(gy - ty, 2)) / 9), 6) AS rms, sqrt((pow(ga - a, 2) + pow(gb - b, 2) + pow(gc - c, 2) + pow(gd - d, 2) + pow(gx - tx, 2) + pow(gy - ty, 2)) / 9) <= 5 AS closed FROM x", "transforms"),
)
def closure_check(spark, sf_dir):
    rms = G.matrix_distance(Affine.of("g_"), Affine.of())
    return _next(spark, sf_dir).select("id", F.round(rms, 6).alias("rms"), (rms <= 5).alias("closed"))


def _next(spark, sf_dir):
    rows = view(spark, sf_dir, "transforms")
    return rows.join(rows.select((F.col("id") - 1).alias("id"), *Affine.of().columns("g_")), "id")


def _probe(x: float, y: float) -> str:
    return f"pow((ga - a) * {x} + (gb - b) * {y} + gx - tx, 2) + pow((gc - c) * {x} + (gd - d) * {y} + gy - ty, 2)"


_PROBES = ((0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (100.0, 100.0))


@query("route_check", with_views(f"WITH {_CROSS} SELECT id, round(sqrt(({' + '.join(_probe(*p) for p in _PROBES)}) / 4), 5) AS distance FROM x", "transforms"))
def route_check(spark, sf_dir):
    return _next(spark, sf_dir).select("id", F.round(G.probe_distance(Affine.of("g_"), Affine.of(), _PROBES), 5).alias("distance"))
