"""The sink of FITS images: whole files or none, with masks and provenance."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tesselith.sources import fits, fits_bands, fits_sink


@pytest.fixture(scope="module")
def images(spark):
    fits_sink.register(spark)
    pixels = spark.range(3 * 20).select((F.col("id") % 3).alias("batch"), F.floor(F.col("id") / 3).alias("pos"), (F.col("id") * 1000).cast("int").alias("code"), (F.col("id") % 7 > 0).alias("valid"), (F.col("id") % 5 == 0).alias("saturated"))
    pixels = pixels.where("NOT (batch = 1 AND pos = 4)").withColumn("n", F.lit(12))
    rows = fits_sink.image_rows(pixels, ["batch", "n"], F.concat(F.lit("stack_"), F.col("batch"), F.lit(".fits")), 4, 5, {"METHOD": F.lit("median"), "NFRAMES": F.col("n")})
    return pixels, rows.repartition(2)


def test_files_hold_codes_masks_and_provenance(spark, images, tmp_path):
    pixels, rows = images
    rows.write.format("fits_images").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["stack_0.fits", "stack_1.fits", "stack_2.fits"]
    got = {(r.path[-6], r.y * 5 + r.x): (int(r.v), r.ok, r.saturated) for r in fits.long_table(fits.read_tiles(spark, str(tmp_path))).collect()}
    want = {(str(r.batch), r.pos): (r.code, r.valid, r.saturated) for r in pixels.collect()} | {("1", 4): (0, False, False)}
    assert got == want
    heads = fits_bands.read_headers(spark, str(tmp_path)).collect()
    assert {(h.cards["METHOD"], h.cards["NFRAMES"], h.bitpix, h.height, h.width) for h in heads} == {("median", "12", 16, 4, 5)}


def test_names_that_exist_are_kept_or_replaced(images, tmp_path):
    _, rows = images
    (tmp_path / "stack_1.fits").write_bytes(b"old")
    (tmp_path / "other.fits").write_bytes(b"other")
    with pytest.raises(Exception, match="exists already"):
        rows.write.format("fits_images").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["other.fits", "stack_1.fits"] and (tmp_path / "stack_1.fits").read_bytes() == b"old"
    rows.write.format("fits_images").mode("overwrite").save(str(tmp_path))
    assert len(os.listdir(tmp_path)) == 4 and (tmp_path / "stack_1.fits").read_bytes()[:6] == b"SIMPLE" and (tmp_path / "other.fits").read_bytes() == b"other"


def test_nothing_is_left_of_a_write_that_fails(images, tmp_path):
    _, rows = images
    bad = rows.withColumn("height", F.when(F.col("name") == "stack_2.fits", 9).otherwise(F.col("height")))
    with pytest.raises(Exception, match="reshape"):
        bad.write.format("fits_images").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="two images"):
        rows.withColumn("name", F.lit("same.fits")).write.format("fits_images").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    rows.where("false").write.format("fits_images").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
