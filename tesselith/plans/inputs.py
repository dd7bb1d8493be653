"""Frames, pixels, sequences and stars as views of the given tables.

Each view is a select list that Spark and DuckDB read alike, so that queries and
their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, select list, the table's rows multiplied by array positions or not)
VIEWS: dict[str, tuple[str, list[str]]] = {
    # frame metrics: brands are batches, sizes are widths of stars with many ties
    "frames": (
        "part",
        [
            "p_partkey AS frame_id",
            "p_brand AS batch",
            "concat(p_brand, '/Light_', cast(p_partkey % 997 AS string), '.', CASE WHEN p_partkey % 5 = 0 THEN 'FIT' ELSE 'fits' END) AS path",
            "p_partkey AS seq",
            "CASE WHEN p_partkey % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS status",
            "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE cast(p_size AS double) END AS fwhm",
            "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE cast(p_retailprice AS double) END AS snr",
            "cast(p_partkey % 37 AS double) AS star_count",
            "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 0.3e0 + (p_partkey % 71) / 100e0 END AS roundness",
            "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE cast(p_partkey % 13 AS double) / 4e0 END AS rms",
            "1e0 + (p_partkey % 29) / 14e0 AS elongation",
            "(p_partkey % 31) / 10e0 AS trail_excess",
            "CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE (p_partkey % 17) / 16e0 END AS coherence",
            "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 19) / 24e0 END AS tangential",
            "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 100e0 END AS coverage",
            "p_partkey % 3 = 0 AS has_mask",
            "(p_partkey % 41) / 10e0 - 2e0 AS rotation",
            "1e0 + (p_partkey % 9 - 4) / 1000e0 AS scale",
            "p_partkey % 13 <> 0 AS timed",
        ],
    ),
    # an affine transform for each row: matches, inliers and a matrix a b tx / c d ty
    "transforms": (
        "supplier",
        [
            "s_suppkey AS id",
            "s_nationkey AS batch",
            "cast(s_suppkey % 60 AS int) AS matches",
            "cast(s_suppkey % 41 AS int) AS inliers",
            "(s_suppkey % 97) / 20e0 AS rms",
            "1e0 + (s_suppkey % 9 - 4) / 100e0 AS a",
            "(s_suppkey % 13 - 6) / 50e0 AS b",
            "(s_suppkey % 11 - 5) / 50e0 AS c",
            "1e0 + (s_suppkey % 7 - 3) / 100e0 AS d",
            "(s_suppkey % 401) * 10e0 - 2000e0 AS tx",
            "(s_suppkey % 307) * 10e0 - 1500e0 AS ty",
            "(s_suppkey % 19) / 40e0 AS response",
            "(s_suppkey % 23) / 400e0 AS spatial",
            "(s_suppkey % 21) / 20e0 AS coverage",
            "s_suppkey % 10 <> 0 AS checked",
        ],
    ),
    # a pixel stack is a table of its own, below; a sequence of times and values for each user
    "sequence": (
        "events",
        [
            "event_id AS id",
            "user_id AS batch",
            "ts",
            "value",
            "event_type AS kind",
            "props",
            "event_id % 13 = 0 AS untimed",
        ],
    ),
    # points in the plane: two frames of stars for each brand
    "stars": (
        "part",
        [
            "p_partkey AS star",
            "cast(p_size % 5 AS int) AS frame",
            "cast((p_partkey * 7919) % 2003 AS double) / 2e0 AS x",
            "cast((p_partkey * 6271) % 1999 AS double) / 2e0 AS y",
            "cast(p_retailprice AS double) AS flux",
        ],
    ),
    # the same points in frames whose number grows with the table: one for each brand among 500 parts in a row
    "star_frames": (
        "part",
        [
            "p_partkey AS star",
            "cast(floor(p_partkey / 500) AS bigint) * 100 + cast(substr(p_brand, 7) AS bigint) AS frame",
            "cast((p_partkey * 7919) % 2003 AS double) / 2e0 AS x",
            "cast((p_partkey * 6271) % 1999 AS double) / 2e0 AS y",
            "cast(p_retailprice AS double) AS flux",
        ],
    ),
    # one sky of a hundred stars, seen once by each hundred parts in a row: turned and moved, in two frames of three with some stars unseen and some misplaced
    "sky": (
        "part",
        [
            "p_partkey % 100 AS star",
            "cast(floor(p_partkey / 100) AS bigint) AS frame",
            "((p_partkey % 100) * ((p_partkey % 100) * 911 + 7919) % 2003) / 2e0 * cos((floor(p_partkey / 100) % 9) / 1000e0) - ((p_partkey % 100) * ((p_partkey % 100) * (p_partkey % 100) * 577 + 6271) % 1999) / 2e0 * sin((floor(p_partkey / 100) % 9) / 1000e0) + (floor(p_partkey / 100) % 12) * 15e0 + CASE WHEN p_partkey % 31 = 0 AND floor(p_partkey / 100) % 3 <> 0 THEN 9e0 ELSE 0e0 END AS x",
            "((p_partkey % 100) * ((p_partkey % 100) * 911 + 7919) % 2003) / 2e0 * sin((floor(p_partkey / 100) % 9) / 1000e0) + ((p_partkey % 100) * ((p_partkey % 100) * (p_partkey % 100) * 577 + 6271) % 1999) / 2e0 * cos((floor(p_partkey / 100) % 9) / 1000e0) - (floor(p_partkey / 100) % 5) * 20e0 AS y",
            "cast((p_partkey % 100) * 613 % 997 AS double) AS flux",
            "floor(p_partkey / 100) % 3 = 0 OR (p_partkey % 19 <> 0 AND p_size > 1) AS seen",
        ],
    ),
}

PIXELS_SQL = """pixels AS (
    SELECT vec_id AS frame, label AS batch, pos - 1 AS pos, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x,
           CAST(embedding[pos] AS DOUBLE) AS v, (vec_id + pos - 1) % 7 <> 0 AS ok
    FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings))"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a stack of 8 by 8 frames: frame, batch, pos, y, x, v, ok."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.selectExpr("vec_id AS frame", "label AS batch", "posexplode(embedding) AS (pos, value)").selectExpr(
        "frame", "batch", "cast(pos AS bigint) AS pos", "cast(pos div 8 AS bigint) AS y", "cast(pos % 8 AS bigint) AS x", "cast(value AS double) AS v", "(frame + pos) % 7 <> 0 AS ok"
    )


def with_views(sql: str, *names: str) -> str:
    """``sql`` with its views as common table expressions; ``sql`` may begin with further ones after WITH."""
    made = []
    for name in names:
        if name == "pixels":
            made.append(PIXELS_SQL)
        else:
            source, columns = VIEWS[name]
            made.append(f"{name} AS (SELECT {', '.join(columns)} FROM {source})")
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(made)}, {body}"
    return f"WITH {', '.join(made)} {body}"
