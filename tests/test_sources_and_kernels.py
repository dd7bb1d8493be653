"""FITS files, kernels, streams and scalar cases with hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.functions import metrics, text
from tesselith.functions.geometry import Affine
from tesselith.operators import graphs, kernels, matching, ranking, stacking, temporal
from tesselith.sources import bundles, fits
from tesselith.streaming import sequences


def test_fits_round_trip(spark, tmp_path):
    values = np.arange(2 * 300 * 270, dtype=float).reshape(2, 300, 270)
    values[1, 5, 7] = np.nan
    folder = tmp_path / "batch_01"
    folder.mkdir()
    (folder / "Light_1.fits").write_bytes(fits.encode(values, {"DATE-OBS": "2026-01-02T03:04:05.125-03:00", "EXPTIME": 2.5, "OBJECT": "O'Brien"}))
    raw = np.array([[1, 2], [-5, 4]], ">i2")
    head = "".join(f"{c:<80}" for c in ("SIMPLE  =                    T / standard", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2", "BSCALE  =                  2.0", "BZERO   =                 10.0", "BLANK   =                   -5", "END"))
    (folder / "Light_2.fits").write_bytes((head + " " * (-len(head) % 2880)).encode() + raw.tobytes() + b"\0" * (2880 - 8))
    listed = fits.list_files(spark, str(tmp_path)).select("batch", "name").collect()
    assert sorted((r.batch, r.name) for r in listed) == [("batch_01", "Light_1.fits"), ("batch_01", "Light_2.fits")]
    headers = fits.read_headers(spark, str(tmp_path))
    got = {r.path[-12:-5]: r for r in headers.collect()}
    assert (got["Light_1"].channels, got["Light_1"].height, got["Light_1"].width) == (2, 300, 270) and got["Light_1"].cards["OBJECT"] == "O'Brien"
    times = {r.path[-12:-5]: r for r in fits.times(headers).collect()}
    assert times["Light_1"].micros == 1_767_333_845_125_000 + 0 and times["Light_1"].state == "valid"
    assert times["Light_1"].zone == "-03:00" and times["Light_2"].state == "unknown"
    long = fits.long_table(fits.read_tiles(spark, str(tmp_path)))
    one = long.where(F.col("path").endswith("Light_1.fits"))
    assert one.count() == values.size and one.where("not ok").collect()[0].asDict()["y"] == 5
    assert one.where("c = 1 and y = 299 and x = 269").first().v == values[1, 299, 269]
    two = {(r.y, r.x): r.v for r in long.where(F.col("path").endswith("Light_2.fits")).collect()}
    assert two[0, 0] == 12 and two[1, 1] == 18 and np.isnan(two[1, 0])


def test_fits_masks_and_parts(spark, tmp_path):
    codes = np.arange(300 * 270, dtype=np.uint16).reshape(300, 270)
    valid, full = np.ones((300, 270), bool), np.zeros((300, 270), bool)
    valid[280, 3] = full[299, 269] = full[0, 0] = False
    full[299, 269] = True
    cube = np.stack([codes, codes + 1.0, codes + 2.0]).astype(float)
    (tmp_path / "one.fits").write_bytes(fits.encode(codes, {"ORIGIN": "here"}, valid, full))
    (tmp_path / "three.fits").write_bytes(fits.encode(cube, None, np.stack([valid, ~full])))
    (tmp_path / "low.fits").write_bytes(fits.encode(np.zeros((4, 5))))
    long = fits.long_table(fits.read_tiles(spark, str(tmp_path))).cache()
    one = long.where(F.col("path").endswith("one.fits"))
    assert one.agg(F.sum("v")).first()[0] == codes.sum() and one.where("not ok").select("y", "x").collect() == [(280, 3)]
    assert one.where("saturated").select("y", "x", "v").collect() == [(299, 269, float(codes[299, 269]))]
    assert sorted(set((r.y, r.x) for r in long.where(F.col("path").endswith("three.fits") & ~F.col("ok")).collect())) == [(280, 3), (299, 269)]
    band = fits.read_tiles(spark, str(tmp_path), rows=(270, 290), channel=2)
    assert sorted((r.path[-10:], r.c, r.y0, r.x0, r.h, r.w) for r in band.collect()) == [("three.fits", 2, 270, 0, 20, 256), ("three.fits", 2, 270, 256, 20, 14)]
    got = {(r.y, r.x): r.v for r in fits.long_table(band).collect()}
    assert len(got) == 20 * 270 and all(v == cube[2, y, x] for (y, x), v in got.items())
    assert [(h.channels, h.height) for h in fits.read_headers(spark, str(tmp_path), "three.fits").collect()] == [(3, 300)]
    with pytest.raises(ValueError, match="beside an image"):
        fits.masks(fits.encode(codes, None, valid[:10]), 300, 270)


def test_revisions_switch_whole(spark, tmp_path):
    for k in (1, 2):
        bundles.write_revision(spark.range(k * 10).withColumn("batch", F.col("id") % 2), str(tmp_path), f"r{k}", "batch")
    assert bundles.read_current(spark, str(tmp_path)).count() == 20


def test_kernels():
    frame = np.random.default_rng(1).normal(size=(16, 16))
    assert kernels.phase_shift(frame, np.roll(frame, (3, -2), (0, 1)))[:2] == (3, -2)
    draw = np.random.default_rng(2)
    p = draw.uniform(0, 100, (40, 2))
    q = p @ np.array([[0.8, 0.6], [-0.6, 0.8]]) * 1.5 + [3, -7]
    q[:8] += 50
    m, fits_ = kernels.ransac(p, q, 0.01)
    assert fits_.sum() == 32 and not fits_[:8].any() and np.allclose(m[:, 2], [3, -7])
    assert kernels.hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1]])) == 12
    image = np.zeros((20, 20)) + draw.normal(0, 0.01, (20, 20))
    image[4:7, 10:13] += 5
    image[15, 3] += 9
    stars = kernels.detect(image, 30)
    assert [(round(s[0]), round(s[1]), s[3]) for s in stars] == [(11, 5, 9), (3, 15, 1)]
    assert kernels.ransac(p[:1], q[:1], 1) is None


def test_registered_pairs_find_the_turn(spark):
    from tesselith.plans.all_queries import QUERIES
    from tesselith.plans.inputs import view

    found = QUERIES["register_pairs"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(abs(r.tx - 3) < 0.5 and abs(r.ty + 5) < 0.5 for r in found)
    # Small frames may have no wrong match; in each, the inliers are all its stars but the wrong ones.
    stars = view(spark, "/root/testdata/sf0.001", "star_frames").groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("star") % 10 != 0).alias("right")).collect()
    expected = {r.frame: (r.n, r.right) for r in stars}
    assert all((r.matches, r.inliers) == expected[r.frame] for r in found) and sum(r.matches - r.inliers for r in found) > 5
    shifts = QUERIES["phase_shift"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.dy, r.dx) for r in shifts} == {(2, 3)}
    assert QUERIES["detect_stars"](spark, "/root/testdata/sf0.001").count() > 0


def stack_of(spark, cells):
    """Rows of one position: (value, valid)."""
    return spark.createDataFrame([(0, i, *c) for i, c in enumerate(cells)], "pos int, frame int, v double, ok boolean")


@pytest.mark.parametrize(
    ("cells", "method", "value"),
    [([(1.0, True), (float("nan"), True), (9.0, False)], "mean", 1.0), ([(float("inf"), True), (2.0, True)], "max", float("inf")), ([(1.0, False)], "median", 0.0), ([(1.0, False)], "sum", 0.0), ([(float("nan"), True), (3.0, True), (1.0, True)], "max", 3.0)],
)
def test_plain_combinations(spark, cells, method, value):
    assert stacking.combine(stack_of(spark, cells), ["pos"], method).first().value == value


def test_rejection(spark):
    rule = stacking.Rejection("sigma", 1.5, 1.5)
    many = [(float(i), True) for i in (10, 11, 12, 11, 10, 12, 11)] + [(900.0, True)]
    assert stacking.reject(stack_of(spark, many), ["pos"], rule).first().value == 11
    few = [(1.0, True), (2.0, True), (900.0, True)]
    assert stacking.reject_or_combine(stack_of(spark, few), ["pos"], rule, "mean").first().value == 301
    same = [(5.0, True)] * 6
    assert stacking.reject(stack_of(spark, same), ["pos"], stacking.Rejection("mad")).first().value == 5
    endless = [(float("inf"), True)] + [(float(i), True) for i in range(5)]
    assert stacking.reject(stack_of(spark, endless), ["pos"], rule).first().n == 6
    assert stacking.reject(stack_of(spark, [(1.0, False)]), ["pos"], rule).count() == 0


def test_uint16(spark):
    row = spark.range(1).select(
        stacking.encode_uint16(F.lit(10.0), F.lit(10.0), F.lit(40.0)).alias("a"), stacking.encode_uint16(F.lit(20.0), F.lit(10.0), F.lit(40.0)).alias("b"), stacking.encode_uint16(F.lit(50.0), F.lit(10.0), F.lit(40.0)).alias("c"), stacking.encode_uint16(F.lit(1.0), F.lit(3.0), F.lit(3.0)).alias("d")
    ).first()
    assert tuple(row) == (0, 21845, 65535, 0)


def test_sessions_join_equal_gaps(spark):
    times = ["2026-01-01 00:30:00", "2026-01-01 00:00:00", "2026-01-01 00:15:00", "2026-01-01 00:46:00", None, None, "2026-01-01 00:46:00"]
    rows = spark.createDataFrame([(1, f"frame_{k:03d}", t) for k, t in zip((3, 1, 2, 4, 5, 6, 7), times, strict=True)], "batch int, name string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.name[-1]: r.session for r in temporal.gap_sessions(rows, ["batch"], "t", ["name"]).collect()}
    assert got == {"1": 1, "2": 1, "3": 1, "4": 2, "7": 2, "5": 0, "6": 0}


def test_drift(spark):
    drift = temporal.Drift(3)
    assert [drift.step(s) for s in (1, 1, 1, 1, 1, 10, 1, None, float("nan"))] == [1, 1, 1, 1, 1, 2, 2, 2, 2]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(b, k, float(10 if k == 6 else 1)) for b in (1, 2) for k in range(12)], "batch bigint, k bigint, score double")
    rows.where("k < 6").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sequences.streaming_drift(stream, "batch", "k", "score", 3.0).writeStream.format("memory").queryName("drift").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    rows.where("k >= 6").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    whole = temporal.drift_batches(rows, "batch", ["k"], "score", 3.0)
    assert sorted(map(tuple, spark.table("drift").collect())) == sorted((r.batch, r.k, r.segment) for r in whole.collect())
    assert {r.segment for r in whole.where("k >= 6").collect()} == {2}

    times = spark.createDataFrame([(1, f"2026-01-01 {h}:{m:02d}:00") for h, m in ((10, 0), (10, 15), (10, 31), (12, 0), (14, 0))], "batch int, t string").withColumn("t", F.col("t").cast("timestamp"))
    times.coalesce(1).write.parquet(f"{tmp_path}/times")
    stream = spark.readStream.schema(times.schema).parquet(f"{tmp_path}/times")
    query = sequences.streaming_sessions(stream, "batch", "t").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 1, 2]


def test_natural_order_and_times(spark):
    names = ["img10.fits", "img2.fits", "IMG1.fits", "a.fits", "10.fits", "9b.fits"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == ["9b.fits", "10.fits", "a.fits", "IMG1.fits", "img2.fits", "img10.fits"]
    micros, state, zone = text.timestamp_state(F.col("t"))
    stamps = spark.createDataFrame([("2026-01-02T03:04:05.125-03:00",), ("20260102T030405",), ("not a timestamp",), (None,), ("",)], "t string").select(micros.alias("m"), state.alias("s"), zone.alias("z")).collect()
    assert [r.s for r in stamps] == ["valid", "valid", "unknown", "unknown", "unknown"] and stamps[0].z == "-03:00"
    assert stamps[0].m - stamps[1].m == 3 * 3600 * 10**6 + 125000


def test_weights_and_ranks(spark):
    spec = spark.createDataFrame([('{"fwhm": 0.4, "snr": 0.6}',), ("fwhm=0.4;roundness=0.3,snr=0.3",), ("nope",)], "t string").select(metrics.parsed_weights(F.col("t")).alias("w")).collect()
    assert spec[0].w == {"fwhm": 0.4, "snr": 0.6} and spec[1].w == {"fwhm": 0.4, "roundness": 0.3, "snr": 0.3} and spec[2].w == {}
    frames = spark.createDataFrame([("a", 2.0, 0.95, 20.0), ("b", 4.0, 0.8, 10.0), ("c", 6.0, 0.7, 5.0), ("d", None, None, None)], "path string, fwhm double, roundness double, star_count double")
    frames = frames.withColumn("rms", F.lit(None).cast("double"))
    got = {r.path: r for r in ranking.quality_scores(frames, "path", {"fwhm": 0.4, "roundness": 0.2, "star_count": 0.2, "rms": 0.2}).collect()}
    assert [got[k].score for k in "abcd"] == [1.0, 0.5, 0.0, None] and got["a"].eligible and not got["d"].eligible
    assert got["a"].missing == ["rms"] and abs(got["a"].available - 0.8) < 1e-9


def test_nearest_and_paths(spark):
    previous = spark.createDataFrame([(0, i, 10.0 * i, 0.0) for i in range(4)], "g int, star int, x double, y double")
    current = spark.createDataFrame([(0, i, x, 0.0) for i, x in enumerate((0.1, 0.2, 10.1, 20.1))], "g int, star int, x double, y double")
    got = {(r.current, r.previous) for r in matching.nearest_matches(current, previous, ["g"], 2.0).collect()}
    assert got == {(0, 0), (2, 1), (3, 2)}
    edges = spark.createDataFrame([(1, None, 0.0), (2, 1, 2.0), (3, 2, 3.0), (7, 8, 1.0), (8, 7, 1.0)], "node int, parent int, tx double")
    edges = edges.select("node", "parent", F.lit(0.5).alias("rms"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), "tx", F.lit(0.0).alias("ty"))
    paths = graphs.to_root(edges)
    assert {(r.node, r.root, r.tx, r.hops) for r in paths.collect()} == {(1, 1, 0.0, 0), (2, 1, 2.0, 1), (3, 1, 5.0, 2)}
    moved = graphs.rebase(paths, spark.createDataFrame([(1, 2)], "root int, reference int"))
    assert {(r.node, r.tx) for r in moved.collect()} == {(1, -2.0), (2, 0.0), (3, 3.0)}
    m = Affine.of().inverse().after(Affine.of())
    assert [round(v, 9) for v in edges.where("node = 3").select(*m.columns()).first()] == [1, 0, 0, 1, 0, 0]
