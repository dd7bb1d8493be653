"""Session models of colours: trained once, reused, and trained again where frames change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesselith.operators import colour_session as C
from tesselith.sources import revisions
from tests.test_imaging import field, spread_out

SIDE = 120
SCHEMA = "session string, path string, length bigint, modified timestamp, frame bigint, red array<double>, green array<double>, blue array<double>"


def rows(session, n, first, shift, seed):
    stars, r = spread_out(seed, 18, SIDE, SIDE), np.random.default_rng(seed)
    for k in range(n):
        dx, dy = shift(k)
        image = lambda a, b: (field(stars, SIDE, SIDE, dx=a, dy=b) + r.normal(0, 1, (SIDE, SIDE))).ravel().tolist()  # noqa: B023, E731
        yield session, f"{session}/{k:03d}.fits", 1000 + k, None, first + k, image(dx, dy), image(0, 0), image(0.2, 0.1)


def test_models_are_trained_once(spark, tmp_path):
    steady = list(rows("one", 14, 0, lambda k: (0.8, -0.5), 3))
    wild = list(rows("two", 5, 100, lambda k: ((k - 2) * 0.9, 0.0), 4))
    short = list(rows("three", 2, 200, lambda k: (0.5, 0.0), 5))
    frames = spark.createDataFrame([*steady, steady[0], *wild, *short, (None, "x", 1, None, 999, None, None, None)], SCHEMA)
    root = str(tmp_path)
    models, trained = C.session_models(spark, root, frames, SIDE, SIDE, "r1")
    got = {(m.session, m.colour): m for m in models.collect()}
    assert trained == 3 and len(got) == 6
    red = got["one", "red"]
    assert red.accepted and red.reason is None and red.samples == 12 and abs(red.tx + 0.8) < 0.1 and abs(red.ty - 0.5) < 0.1
    assert not got["two", "red"].accepted and got["two", "red"].reason == "inconsistent_samples" and not got["two", "blue"].accepted
    assert got["three", "red"].reason == "insufficient_samples"
    version = revisions.head(spark, root).version

    again, trained = C.session_models(spark, root, frames.repartition(5), SIDE, SIDE, "r1")
    assert trained == 0 and revisions.head(spark, root).version == version
    assert sorted(again.collect()) == sorted(got.values())

    changed = frames.withColumn("length", F.when(F.col("session") == "three", F.col("length") + 1).otherwise(F.col("length")))
    models, trained = C.session_models(spark, root, changed, SIDE, SIDE, "r1")
    assert trained == 1 and models.count() == 6 and revisions.head(spark, root).version == version + 1
    assert C.session_models(spark, root, changed.where("session = 'three'"), SIDE, SIDE, "r2")[1] == 1


def test_no_sessions(spark, tmp_path):
    models, trained = C.session_models(spark, str(tmp_path), spark.createDataFrame([], SCHEMA), SIDE, SIDE, "r1")
    assert (models.collect(), trained) == ([], 0)
