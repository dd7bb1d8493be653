"""FITS images as DataFrames: headers alone, or tiles of pixels.

Files are listed and read by Spark's ``binaryFile`` source; a task parses the
files it is given. Only the header is parsed for metadata, and Spark's reader
gives file names and sizes without contents where those are all that is asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.session import ship_package

BLOCK, CARD = 2880, 80
PIXEL_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
TILE = 256

HEADERS = "path string, hdu int, height int, width int, channels int, bitpix int, cards map<string,string>"
TILES = "path string, c int, y0 int, x0 int, h int, w int, data array<double>, valid array<boolean>, saturated array<boolean>"

# The names of units beside the image.
VALID_NAMES = ("VALID_MASK", "VALIDMASK")
SATURATED_NAME = "SAT_MASK"
BESIDE = (*VALID_NAMES, SATURATED_NAME, "DISAGREE", "HDR_META")


def card_value(text: str) -> str:
    """The value field of a card, without quotes and comment."""
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while (end := text.find("'", end)) >= 0 and text[end : end + 2] == "''":
            end += 2
        return text[1 : end if end > 0 else None].replace("''", "'").rstrip()
    return text.split("/", 1)[0].strip()


def header(content: memoryview, start: int) -> tuple[dict[str, str], int]:
    """The cards from ``start`` on, and where the data begin."""
    cards: dict[str, str] = {}
    at = start
    while at + CARD <= len(content):
        card = bytes(content[at : at + CARD]).decode("ascii", "replace")
        at += CARD
        key = card[:8].strip()
        if key == "END":
            return cards, start + -(-(at - start) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            cards.setdefault(key, card_value(card[10:]))
    raise ValueError("the header has no END card")


def shape(cards: dict[str, str]) -> list[int]:
    return [int(cards[f"NAXIS{i}"]) for i in range(int(cards.get("NAXIS", "0")), 0, -1)]


def units(content: bytes | pa.Buffer) -> Iterator[tuple[int, str, dict[str, str], int]]:
    """(number, name, cards, start of data) of the units that are images of two or three axes, masks too."""
    view, at, number = memoryview(content), 0, 0
    while at + CARD <= len(view):
        cards, data = header(view, at)
        axes = shape(cards)
        size = int(np.prod(axes)) * abs(int(cards.get("BITPIX", "8"))) // 8 if axes else 0
        size = (size + int(cards.get("PCOUNT", "0"))) * int(cards.get("GCOUNT", "1"))
        if len(axes) in (2, 3) and cards.get("XTENSION", "IMAGE") == "IMAGE":
            yield number, cards.get("EXTNAME", "").upper(), cards, data
        at, number = data + -(-size // BLOCK) * BLOCK, number + 1


def images(content: bytes | pa.Buffer) -> Iterator[tuple[int, dict[str, str], int]]:
    """(number, cards, start of data) of the units that are images and no masks."""
    return ((number, cards, data) for number, name, cards, data in units(content) if name not in BESIDE)


def _raw(content: bytes | pa.Buffer, cards: dict[str, str], data: int) -> np.ndarray:
    """The stored values as channels by height by width; a view of the content, no copy."""
    axes = shape(cards)
    return np.frombuffer(content, PIXEL_TYPES[int(cards["BITPIX"])], int(np.prod(axes)), data).reshape(axes if len(axes) == 3 else [1, *axes])


def pixels(content: bytes | pa.Buffer, cards: dict[str, str], data: int, rows: slice = slice(None), channels: slice = slice(None)) -> np.ndarray:
    """Physical values of some rows and channels; the blank value is NaN. Others are not decoded."""
    raw = _raw(content, cards, data)[channels, rows]
    values = raw.astype(np.float64)
    if "BLANK" in cards and int(cards["BITPIX"]) > 0:
        values[raw == int(cards["BLANK"])] = np.nan
    return values * float(cards.get("BSCALE", "1").replace("D", "E")) + float(cards.get("BZERO", "0").replace("D", "E"))


def masks(content: bytes | pa.Buffer, height: int, width: int, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(valid, saturated) of some rows. A pixel is valid if all masks and their channels say so, and saturated if any does;
    without masks all are valid and none saturated. A mask of another size is an error."""
    valid = np.ones((height, width), bool)[rows]
    saturated = np.zeros_like(valid)
    for _, name, cards, data in units(content):
        if name in VALID_NAMES or name == SATURATED_NAME:
            if shape(cards)[-2:] != [height, width]:
                raise ValueError(f"{name} of {shape(cards)} beside an image of {height} by {width}")
            stored = _raw(content, cards, data)[:, rows] != 0
            if name == SATURATED_NAME:
                saturated |= stored.any(axis=0)
            else:
                valid &= stored.all(axis=0)
    return valid, saturated


def _unit(stored: np.ndarray, bits: int, cards: dict[str, object], first: bool) -> bytes:
    """One unit, of values as they are stored."""
    axes = list(stored.shape)[::-1]
    start = {"SIMPLE": True} if first else {"XTENSION": "IMAGE"}
    extra = {} if first else {"PCOUNT": 0, "GCOUNT": 1}
    all_ = {**start, "BITPIX": bits, "NAXIS": len(axes), **{f"NAXIS{i + 1}": n for i, n in enumerate(axes)}, **extra, **cards}

    def written(value: object) -> str:
        if isinstance(value, bool):
            return f"{'T' if value else 'F':>20}"
        return f"'{str(value).replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else f"{value!s:>20}"

    head = "".join(f"{f'{k:<8}= {written(v)}':<{CARD}}" for k, v in all_.items()) + f"{'END':<{CARD}}"
    head += " " * (-len(head) % BLOCK)
    body = stored.astype(PIXEL_TYPES[bits]).tobytes()
    return head.encode("ascii") + body + b"\0" * (-len(body) % BLOCK)


def encode(values: np.ndarray, cards: dict[str, object] | None = None, valid: np.ndarray | None = None, saturated: np.ndarray | None = None) -> bytes:
    """A FITS file with one image, of two or three axes, and its masks. 16-bit codes are stored as such, all else as 64-bit floats."""
    cards = cards or {}
    if values.dtype == np.uint16:
        out = _unit(values.astype(np.int32) - 32768, 16, {**cards, "BSCALE": 1.0, "BZERO": 32768.0}, True)
    else:
        out = _unit(values, -64, cards, True)
    for name, mask in ((VALID_NAMES[0], valid), (SATURATED_NAME, saturated)):
        if mask is not None:
            out += _unit(mask.astype(np.uint8), 8, {"EXTNAME": name}, False)
    return out


def list_files(spark: SparkSession, path: str, pattern: str = "*.{fits,fit,fts,FITS,FIT}") -> DataFrame:
    """(path, batch, name, length, modificationTime) of the files; no contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("batch"), F.element_at(parts, -1).alias("name"), "length", "modificationTime")


def _contents(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    ship_package(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            found = next(images(content.as_buffer()), None)
            if found:
                number, cards, _ = found
                axes = [1, *shape(cards)][-3:]
                one = [[path], [number], [axes[1]], [axes[2]], [axes[0]], [int(cards["BITPIX"])]]
                kinds = [pa.string(), *[pa.int32()] * 5]
                arrays = [pa.array(v, k) for v, k in zip(one, kinds, strict=True)] + [pa.array([list(cards.items())], pa.map_(pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "hdu", "height", "width", "channels", "bitpix", "cards"])


def read_headers(spark: SparkSession, path: str, pattern: str = "*.fits") -> DataFrame:
    """HEADERS of the first image in each file."""
    return _contents(spark, path, pattern).mapInArrow(_headers, HEADERS)


def _tiles(first: int, last: int | None, channel: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = pa.list_(pa.bool_())
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            content = content.as_buffer()
            found = next(images(content), None)
            if not found:
                continue
            depth, height, width = [1, *shape(found[1])][-3:]
            end = height if last is None else min(last, height)
            for y in range(first, end, TILE):
                rows = slice(y, min(y + TILE, end))
                valid, saturated = masks(content, height, width, rows)
                for c in range(depth) if channel is None else [channel] * (channel < depth):
                    values = pixels(content, found[1], found[2], rows, slice(c, c + 1))[0]
                    for x in range(0, width, TILE):
                        across = slice(x, x + TILE)
                        tile = values[:, across]
                        ints = [pa.array([v], pa.int32()) for v in (c, y, x, *tile.shape)]
                        arrays = [pa.array([tile.reshape(-1)], pa.list_(pa.float64())), *(pa.array([m[:, across].reshape(-1)], flags) for m in (valid, saturated))]
                        yield pa.RecordBatch.from_arrays([pa.array([path]), *ints, *arrays], names=["path", "c", "y0", "x0", "h", "w", "data", "valid", "saturated"])


def read_tiles(spark: SparkSession, path: str, pattern: str = "*.fits", rows: tuple[int, int | None] = (0, None), channel: int | None = None) -> DataFrame:
    """TILES of the first image in each file, at most TILE pixels wide and high, with its masks.

    ``rows`` (first, end) and ``channel`` (from 0) take a part of each image, and the rest is not decoded; a file without that
    part gives no rows. Tiles begin at the first row asked for."""
    return _contents(spark, path, pattern).mapInArrow(partial(_tiles, *rows, channel), TILES)


def long_table(tiles: DataFrame) -> DataFrame:
    """One row per pixel: path, c, y, x, v, ok (valid, and a number) and saturated."""
    flat = tiles.select("path", "c", "y0", "x0", "w", F.posexplode(F.arrays_zip("data", "valid", "saturated")).alias("i", "p"))
    place = [(F.col("y0") + F.expr("i div w")).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x")]
    return flat.select("path", "c", *place, F.col("p.data").alias("v"), (F.col("p.valid") & ~F.isnan("p.data")).alias("ok"), F.col("p.saturated").alias("saturated"))


def times(headers: DataFrame) -> DataFrame:
    """(path, micros, state, zone) from DATE-OBS, else DATEOBS."""
    from tesselith.functions.text import timestamp_state

    stamp = F.coalesce(F.try_element_at("cards", F.lit("DATE-OBS")), F.try_element_at("cards", F.lit("DATEOBS")))
    micros, state, zone = timestamp_state(stamp)
    return headers.select("path", micros.alias("micros"), state.alias("state"), zone.alias("zone"))
