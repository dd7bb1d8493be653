"""The data source of FITS bands: the same pixels as whole files give, for fewer bytes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselith.sources import fits, fits_bands

HEIGHT, WIDTH = 700, 520


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = np.random.default_rng(3)
    top = tmp_path_factory.mktemp("night")
    (top / "batch_1").mkdir()
    codes = r.integers(0, 65535, (HEIGHT, WIDTH)).astype(np.uint16)
    (top / "batch_1" / "a.fits").write_bytes(fits.encode(codes, {"DATE-OBS": "2026-01-02T03:04:05", "EXPTIME": 2.5}, r.random((HEIGHT, WIDTH)) < 0.9, r.random((HEIGHT, WIDTH)) < 0.1))
    cube = r.normal(size=(3, HEIGHT, WIDTH))
    cube[1, 5, 7] = np.nan
    (top / "b.FIT").write_bytes(fits.encode(cube, {f"KEY{k}": k for k in range(60)}))
    (top / "none.fits").write_bytes(fits._unit(np.zeros(4), -64, {}, True))
    (top / "notes.txt").write_text("no image")
    return str(top), {"a.fits": codes[None].astype(float), "b.FIT": cube}


def assembled(tiles, name, shape, column="data"):
    out = np.full(shape, -1.0)
    for t in tiles:
        if t.path.endswith(name):
            out[t.c, t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.array(getattr(t, column), float).reshape(t.h, t.w)
    return out


@pytest.mark.parametrize("band_bytes", [1 << 30, 200_000])
def test_tiles_equal_the_images(spark, folder, band_bytes):
    path, images = folder
    rows = fits_bands.read_bands(spark, path, band_bytes=band_bytes).collect()
    for name, image in images.items():
        np.testing.assert_array_equal(assembled(rows, name, image.shape), image)
    plain = fits.read_tiles(spark, f"{path}/batch_1").collect()
    for column in ("valid", "saturated"):
        np.testing.assert_array_equal(assembled(rows, "a.fits", (1, HEIGHT, WIDTH), column), assembled(plain, "a.fits", (1, HEIGHT, WIDTH), column))
    assert {r.path.split("/")[-1] for r in rows} == {"a.fits", "b.FIT"}


def spent(df):
    return df.agg(F.sum("read_bytes")).first()[0]


def test_bytes_fall_with_rows_channels_and_columns(spark, folder):
    path, images = folder
    read = lambda *a, **k: fits_bands.read_bands(spark, path, *a, **k)
    whole = spent(read())
    pixels = HEIGHT * WIDTH * (2 + 2) + 3 * HEIGHT * WIDTH * 8
    assert pixels <= whole <= pixels + 10 * fits.BLOCK
    few = ["path", "c", "y0", "x0", "h", "w", "data", "read_bytes"]
    band = read(few, rows=(100, 150), channel=0)
    assert spent(band) <= 50 * WIDTH * (2 + 8) + 8 * fits.BLOCK
    got = band.where("path LIKE '%b.FIT'").collect()
    np.testing.assert_array_equal(assembled(got, "b.FIT", (3, HEIGHT, WIDTH))[0, 100:150], images["b.FIT"][0, 100:150])
    assert spent(read([c for c in few if c != "data"])) <= 8 * fits.BLOCK
    assert spent(read(["path", "valid", "read_bytes"])) <= HEIGHT * WIDTH + 10 * fits.BLOCK
    heads = fits_bands.read_headers(spark, path)
    assert spent(heads) <= 8 * fits.BLOCK and {(h.height, h.width, h.channels, h.bitpix) for h in heads.collect()} == {(HEIGHT, WIDTH, 1, 16), (HEIGHT, WIDTH, 3, -64)}
    assert {r.micros for r in fits.times(heads).collect()} == {None, 1767323045000000}


def test_filters_are_pushed_to_bands_channels_and_files(spark, folder):
    path, images = folder
    tiles = fits_bands.read_bands(spark, path)
    name = tiles.where("c = 2").select("path").first()[0]
    some = tiles.where((F.col("path") == name) & (F.col("c") == 1) & (F.col("y0") >= 256) & (F.col("y0") < 512))
    rows = some.collect()
    assert {(r.c, r.y0) for r in rows} == {(1, 256)}
    np.testing.assert_array_equal(assembled(rows, "b.FIT", (3, HEIGHT, WIDTH))[1, 256:512], images["b.FIT"][1, 256:512])
    assert sum(r.read_bytes for r in rows) <= 256 * WIDTH * 8 + 4 * fits.BLOCK
    assert tiles.where("c = 1 AND c = 2").count() == 0 and tiles.where("y0 = 512 AND c = 0").count() == 2 * 3


def test_files_that_break_off_are_named(spark, tmp_path):
    (tmp_path / "short.fits").write_bytes(fits.encode(np.zeros((300, 300)))[:50_000])
    with pytest.raises(Exception, match="short.fits"):
        fits_bands.read_bands(spark, str(tmp_path)).collect()


def test_an_empty_folder(spark, tmp_path):
    assert fits_bands.read_bands(spark, str(tmp_path)).collect() == fits_bands.read_headers(spark, str(tmp_path)).collect() == []
