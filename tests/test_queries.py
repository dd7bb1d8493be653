"""Queries against their SQL in DuckDB, and those without SQL against plain Python."""

import math
import os

import duckdb
import pytest

from tesselith.plans.all_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{SF}/{table}.parquet"):
            connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 5) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


def test_spatial_nms_is_the_greedy_walk(spark):
    from tesselith.plans.inputs import view

    kept = {r.star for r in QUERIES["spatial_nms"](spark, SF).collect()}
    walk = []
    for r in sorted(view(spark, SF, "stars").collect(), key=lambda r: (-r.flux, r.star)):
        if all(r.frame != o.frame or math.hypot(r.x - o.x, r.y - o.y) >= 25 for o in walk):
            walk.append(r)
    assert kept == {r.star for r in walk}


def test_quad_match_pairs_copies(spark):
    found = QUERIES["quad_match"](spark, SF).collect()
    # Stars that the copy moved make quads that may by chance be like others within the tolerance.
    assert len(found) >= 20 and sum(r.reference == r.target for r in found) >= 0.8 * len(found)


def test_star_frames_hold_all_stars(spark):
    """Frames grow with the table and stay within the 250 stars that register_pairs takes of each."""
    from tesselith.plans.inputs import view

    for sf, least in ((SF, 5), ("/root/testdata/sf0.01", 50)):
        sizes = [r["count"] for r in view(spark, sf, "star_frames").groupBy("frame").count().collect()]
        assert len(sizes) > least and max(sizes) <= 250 and sum(sizes) == view(spark, sf, "stars").count()
    assert len({r.frame for r in QUERIES["register_pairs"](spark, SF).collect()}) > 5


def test_graph_bfs_is_a_forest(spark):
    found = {r.node: r for r in QUERIES["graph_bfs"](spark, SF).collect()}
    for r in found.values():
        assert r.parent is None or (found[r.parent].hops == r.hops - 1 and r.cumulative_rms >= found[r.parent].cumulative_rms - 1e-9)


def test_grow_takes_few_jobs_for_long_chains(spark, monkeypatch):
    """Two chains of 400 places, whose rounds are over a hundred, in one block or many; short ones as by single rounds."""
    from pyspark.sql import functions as F

    from tesselith.operators import graphs

    nodes = spark.range(800).select((F.col("id") % 2).alias("batch"), (F.col("id") * 7 % 5003).alias("node"), F.floor(F.col("id") / 2).alias("place")).withColumn("anchor", F.col("place").isin(0, 211) & ((F.col("place") == 0) | (F.col("batch") == 1)))
    other = nodes.select("batch", F.col("node").alias("other"), F.col("place").alias("p"))
    edges = nodes.join(other, "batch").where(F.abs(F.col("place") - F.col("p")).between(1, 3))
    edges = edges.select("batch", "node", "other", F.when(F.col("node") % 41 != 0, (F.col("node") * F.col("other")) % 17 / 10.0).alias("rms"), ((F.col("node") + F.col("other")) % 4 != 0).alias("works"))
    written = []
    real = graphs.stage
    monkeypatch.setattr(graphs, "stage", lambda df, name="stage": (written.append(name), real(df, name))[1])
    found = lambda most, **sizes: sorted(map(tuple, graphs.grow(nodes.where(f"place < {most}"), edges, **sizes).collect()), key=repr)
    whole = found(400)
    assert len(written) <= 6 and max(r[3] for r in whole) > 80
    assert found(400, block=64, halo=40) == whole
    assert found(24, block=8, halo=24) == found(24, halo=3) == found(24)


def crowd(spark, n):
    """Points so dense that each has hundreds around it, some at equal places; a few have none."""
    from pyspark.sql import functions as F

    free = spark.createDataFrame([(0, 90_001, None, 1.0, 5.0), (0, 90_002, float("nan"), 1.0, 5.0)], "frame int, star long, x double, y double, flux double")
    return spark.range(n).select((F.col("id") % 2).cast("int").alias("frame"), F.col("id").alias("star"), ((F.col("id") * 7919) % 83 / 2.0).alias("x"), ((F.col("id") * 6271) % 59 / 2.0).alias("y"), ((F.col("id") * 31) % 100 / 1.0).alias("flux")).union(free)


def test_nearest_matches_lists_few_pairs(spark, monkeypatch):
    """Among dense points, ties at the same distance included, by pairs in proportion to the points and no broadcast."""
    from pyspark.sql import functions as F

    from tesselith.operators import matching

    points = crowd(spark, 6000)
    made, real = [], matching.close_pairs
    monkeypatch.setattr(matching, "close_pairs", lambda *a: (made.append(real(*a)), made[-1])[1])
    out = matching.nearest_matches(points.withColumn("x", F.col("x") + 0.25), points, ["frame"], 12.0)
    found = {(r.frame, r.current, r.previous) for r in out.collect()}
    rows, best = points.where("x is not null and not isnan(x)").collect(), {}
    for frame in (0, 1):
        places = {}
        for r in sorted((r for r in rows if r.frame == frame), key=lambda r: r.star):
            places.setdefault((r.x, r.y), r.star)
        for (x, y), star in places.items():
            d, previous = min((round(math.sqrt((x + 0.25 - u) ** 2 + (y - v) ** 2), 9), s) for (u, v), s in places.items() if abs(x - u) <= 1 and abs(y - v) <= 1)
            best[frame, previous] = min(best.get((frame, previous), (d, star)), (d, star))
    assert found == {(frame, star, previous) for (frame, previous), (_, star) in best.items()}
    assert sum(pairs.count() for pairs in made) < 40 * 6000 and "Broadcast" not in made[-1]._jdf.queryExecution().executedPlan().toString()


def test_suppress_close_lists_no_pairs(spark, monkeypatch):
    """The greedy walk among dense points, without pairs of points or a broadcast of them."""
    from tesselith.operators import matching

    monkeypatch.setattr(matching, "close_pairs", lambda *a: 1 / 0)
    staged, real = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name="stage": (staged.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    points = crowd(spark, 6000)
    found = [(r.frame, r.star) for r in matching.suppress_close(points, ["frame"], 8.0, "flux").collect()]
    walk = []
    for r in sorted(points.collect(), key=lambda r: (-r.flux, r.star)):
        if all(r.frame != o.frame or not math.hypot((r.x or 0) - (o.x or 0), r.y - o.y) < 8 or r.x is None or o.x is None for o in walk):
            walk.append(r)
    assert sorted(found) == sorted((r.frame, r.star) for r in walk)
    assert not any("Broadcast" in plan for plan in staged)


BY_ROW = r"BroadcastHashJoin \[[^\]]*(frame|frame_id|metric|pos|py)#"


def test_stack_plan_broadcasts_no_frames(spark, monkeypatch):
    """Joins by frame, metric value or position are merged in all that stack_plan stages and returns."""
    import re

    from tesselith.operators import stack_plan as P

    plans, real = [], P.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "stage", lambda df, name="stage": (plans.append(plan(df)), real(df, name))[1])
    plans.append(plan(QUERIES["stack_plan"](spark, SF)))
    assert len(plans) == 4 and not any(re.search(BY_ROW, p) for p in plans)


def test_stack_files_broadcasts_no_frames(spark, monkeypatch):
    """What stack_files writes and reads back is made of merged joins by frame."""
    import re

    from tesselith.operators import stack_plan as P
    from tesselith.sources import fits_sink

    plans, stage, images = [], P.stage, fits_sink.image_rows
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(P, "stage", lambda df, name="stage": (plans.append(plan(df)), stage(df, name))[1])
    monkeypatch.setattr(fits_sink, "image_rows", lambda *a: (plans.append(plan(a[0])), images(*a))[1])
    assert QUERIES["stack_files"](spark, SF).count() > 0
    assert len(plans) == 4 and not any(re.search(BY_ROW, p) for p in plans)


def test_warps_broadcast_no_pixels(spark):
    import re

    for name in ("warp_bilinear", "warp_nearest"):
        assert not re.search(BY_ROW, QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_quads_are_shuffled_as_stars(spark):
    """Nothing is shuffled between the stars and the pairs of stars that quads vote for, and matches are those of all pairs of quads."""
    from pyspark.sql import functions as F

    from tesselith.operators import matching

    stars = spark.range(90).select((F.col("id") % 3).alias("frame"), F.col("id").alias("star"), ((F.col("id") * 7919) % 203 / 2.0).alias("x"), ((F.col("id") * 6271) % 199 / 2.0).alias("y"), (F.col("id") * 31 % 50 / 1.0).alias("flux"))
    copy = stars.withColumns({"x": F.col("x") * 1.001 + F.when(F.col("star") % 29 == 0, 5.0).otherwise(0.0), "y": F.col("y") + 3})
    sides = [matching.quad_hashes(matching.quads(s, ["frame"], 25)) for s in (stars, copy)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert [plan(s).count("Exchange") for s in sides] == [1, 1]
    out = matching.quad_matches(*sides, ["frame"])
    assert plan(out).count("Exchange") == 3
    pairs = {}
    one, other = ([(r.frame, (r.h1, r.h2, r.h3, r.h4), tuple(r.stars)) for r in s.collect()] for s in sides)
    assert len(one) > 300
    for frame, h, t in other:
        near = min(((math.sqrt(sum((a - b) ** 2 for a, b in zip(h, g))), r) for f, g, r in one if f == frame), default=(1.0, ()))
        if near[0] <= 0.02:
            for r, s in zip(near[1], t):
                pairs.setdefault((frame, r), set()).add(s)
    wanted = {(frame, r, *s) for (frame, r), s in pairs.items() if len(s) == 1}
    assert {tuple(r) for r in out.collect()} == wanted and len(wanted) > 5
    # A reference without frames is one for all of them.
    whole = matching.quad_matches(sides[0].where("frame = 1").drop("frame"), sides[1].where("frame = 1"), ["frame"])
    assert {tuple(r) for r in whole.collect()} == {w for w in wanted if w[0] == 1}
