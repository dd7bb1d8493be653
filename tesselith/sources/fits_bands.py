"""FITS images as a Spark data source that reads no more bytes than the query needs.

    spark.dataSource.register(FitsBands)
    spark.read.format("fits_bands").option("rows", "100:300").option("channel", 0).load(folder)

A partition is a band of rows of one file; headers are read in blocks of 2,880 bytes, what lies between them is passed over,
and of the pixels only the ranges of the rows and channels asked for are fetched. Which columns are read is told by
the schema: without ``data`` no pixels are fetched, without ``valid`` and ``saturated`` no masks; with neither, a file costs its headers
(``read_bands`` does this by a list of columns). Filters on ``c``, ``y0`` and ``path`` that Spark pushes down pass over channels, bands and
files before anything of them is fetched; Spark applies them again to the rows.

Options: ``rows`` (first:end, end may be left out), ``channel``, ``band`` (rows of a partition's tiles, TILE at most), ``band_bytes`` (the size of
file for which a partition is made; a task learns the image's size from its header, so that no header is read by the driver),
``suffixes``. Paths are those of Arrow's file systems: local folders, HDFS, S3, GCS.

Rows: as ``fits.TILES``, and ``read_bytes``: what the tile cost, with its share of header and masks. Headers (option ``table`` = headers): as ``fits.HEADERS``
and ``read_bytes``. Defined results: a file without an image gives no rows; one that breaks off is an error that names it; an empty folder gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tesselith.session import ship_package
from tesselith.sources import fits

TILES = f"{fits.TILES}, read_bytes bigint"
HEADERS = f"{fits.HEADERS}, read_bytes bigint"
BAND_BYTES = 64 << 20


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


class Ranged:
    """A file read by ranges, and how many bytes that took."""

    def __init__(self, path: str) -> None:
        files, inner = filesystem(path)
        self.path, self.file, self.taken = path, files.open_input_file(inner), 0
        self.length = self.file.size()

    def at(self, start: int, size: int) -> bytes:
        got = self.file.read_at(size, start)
        self.taken += len(got)
        if len(got) < size:
            raise ValueError(f"{self.path} ends within a header or an image")
        return got

    def header(self, start: int) -> tuple[dict[str, str], int]:
        """The cards of the header at ``start``, block by block to its end, and where its data begin."""
        blocks = b""
        while start + len(blocks) < self.length:
            blocks += self.at(start + len(blocks), fits.BLOCK)
            cards = [blocks[i : i + fits.CARD] for i in range(len(blocks) - fits.BLOCK, len(blocks), fits.CARD)]
            if any(c[:8].strip() == b"END" for c in cards):
                return fits.header(memoryview(blocks), 0)[0], start + len(blocks)
        raise ValueError(f"{self.path}: a header has no END card")

    def units(self) -> Iterator[tuple[int, str, dict[str, str], int]]:
        """As ``fits.units``, with no byte of the data."""
        at, number = 0, 0
        while at + fits.BLOCK <= self.length:
            cards, data = self.header(at)
            axes = fits.shape(cards)
            size = int(np.prod(axes)) * abs(int(cards.get("BITPIX", "8"))) // 8 if axes else 0
            size = (size + int(cards.get("PCOUNT", "0"))) * int(cards.get("GCOUNT", "1"))
            if len(axes) in (2, 3) and cards.get("XTENSION", "IMAGE") == "IMAGE":
                yield number, cards.get("EXTNAME", "").upper(), cards, data
            at, number = data + -(-size // fits.BLOCK) * fits.BLOCK, number + 1

    def rows(self, cards: dict[str, str], data: int, channel: int, rows: slice) -> np.ndarray:
        """The stored values of some rows of one channel."""
        height, width = fits.shape(cards)[-2:]
        kind = np.dtype(fits.PIXEL_TYPES[int(cards["BITPIX"])])
        start = data + (channel * height + rows.start) * width * kind.itemsize
        return np.frombuffer(self.at(start, (rows.stop - rows.start) * width * kind.itemsize), kind).reshape(-1, width)


def physical(raw: np.ndarray, cards: dict[str, str]) -> np.ndarray:
    """Stored values to physical ones; the blank value is NaN."""
    values = raw.astype(np.float64)
    if "BLANK" in cards and int(cards["BITPIX"]) > 0:
        values[raw == int(cards["BLANK"])] = np.nan
    return values * float(cards.get("BSCALE", "1").replace("D", "E")) + float(cards.get("BZERO", "0").replace("D", "E"))


@dataclass
class Band(InputPartition):
    """The k-th of n bands of a file."""

    path: str
    k: int
    n: int


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.fieldNames()
        self.headers = "cards" in self.names or "bitpix" in self.names
        self.path = options["path"]
        first, _, end = options.get("rows", "0:").partition(":")
        self.first, self.end = int(first or 0), int(end) if end else None
        self.channel = int(options["channel"]) if "channel" in options else None
        self.band = min(int(options.get("band", fits.TILE)), fits.TILE)
        self.band_bytes = int(options.get("band_bytes", BAND_BYTES))
        self.suffixes = tuple(s.strip().lower() for s in options.get("suffixes", ".fits,.fit,.fts").split(","))
        self.only: str | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Narrow rows, channel and path; all filters go back, for a band's tiles may hold more than was asked for."""
        for f in filters:
            name, value = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None, getattr(f, "value", None)
            # A tile that begins at y0 lies in a band that begins there, since bands are laid from the first row on.
            if name == "y0" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == "y0" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, value + (not isinstance(f, LessThan)))
            if name == "c" and isinstance(f, EqualTo):
                self.channel = value if self.channel in (None, value) else -1
            if name == "path" and isinstance(f, EqualTo):
                self.only = value
            yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, inner = filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(inner, recursive=True)) if files.get_file_info(inner).type == fs.FileType.Directory else [files.get_file_info(inner)]
        head = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        out: list[InputPartition] = []
        for info in sorted((i for i in found if i.type == fs.FileType.File and i.path.lower().endswith(self.suffixes)), key=lambda i: i.path):
            path = head + info.path
            if self.only in (None, path):
                n = 1 if self.headers or not {"data", "valid", "saturated"} & set(self.names) else max(1, -(-info.size // self.band_bytes))
                out += [Band(path, k, n) for k in range(n)]
        return out or [Band("", 0, 0)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        if partition.path:
            file = Ranged(partition.path)
            units = list(file.units()) if {"valid", "saturated"} & set(self.names) else file.units()
            image = next(((number, cards, data) for number, name, cards, data in units if name not in fits.BESIDE), None)
            if image:
                depth, height, width = [1, *fits.shape(image[1])][-3:]
                if self.headers:
                    yield self._batch({"path": partition.path, "hdu": image[0], "height": height, "width": width, "channels": depth, "bitpix": int(image[1]["BITPIX"]), "cards": list(image[1].items()), "read_bytes": file.taken})
                else:
                    yield from self._tiles(partition, file, units, image, depth, height, width)

    def _tiles(self, partition: Band, file: Ranged, units, image, depth: int, height: int, width: int) -> Iterator[pa.RecordBatch]:
        end = height if self.end is None else min(self.end, height)
        starts = list(range(self.first, end, self.band))
        share = -(-len(starts) // partition.n)
        for y in starts[partition.k * share : (partition.k + 1) * share]:
            if not self.low <= y < self.high:
                continue
            rows = slice(y, min(y + self.band, end))
            valid = saturated = None
            if {"valid", "saturated"} & set(self.names):
                valid, saturated = self._masks(file, units, height, width, rows)
            for c in range(depth) if self.channel is None else [self.channel] * (0 <= self.channel < depth):
                values = physical(file.rows(image[1], image[2], c, rows), image[1]) if "data" in self.names else None
                for x in range(0, width, fits.TILE):
                    part = lambda a: None if a is None else a[:, x : x + fits.TILE].reshape(-1)  # noqa: B023, E731
                    yield self._batch({"path": partition.path, "c": c, "y0": y, "x0": x, "h": rows.stop - y, "w": min(fits.TILE, width - x), "data": part(values), "valid": part(valid), "saturated": part(saturated), "read_bytes": file.taken})
                    file.taken = 0

    def _masks(self, file: Ranged, units, height: int, width: int, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """As ``fits.masks``, of some rows alone; a mask that isn't asked for isn't fetched."""
        valid = np.ones((rows.stop - rows.start, width), bool)
        saturated = np.zeros_like(valid)
        for _, name, cards, data in units:
            wanted = ("saturated" if name == fits.SATURATED_NAME else "valid") in self.names
            if wanted and (name in fits.VALID_NAMES or name == fits.SATURATED_NAME):
                axes = [1, *fits.shape(cards)][-3:]
                if axes[1:] != [height, width]:
                    raise ValueError(f"{name} of {axes[1:]} beside an image of {height} by {width}")
                stored = np.stack([file.rows(cards, data, c, rows) != 0 for c in range(axes[0])])
                if name == fits.SATURATED_NAME:
                    saturated |= stored.any(axis=0)
                else:
                    valid &= stored.all(axis=0)
        return valid, saturated

    def _batch(self, row: dict) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "data": pa.list_(pa.float64()), "valid": pa.list_(pa.bool_()), "saturated": pa.list_(pa.bool_()), "cards": pa.map_(pa.string(), pa.string()), "read_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds.get(n, pa.int32())) for n in self.names], names=self.names)


class FitsBands(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_bands"

    def schema(self) -> str:
        return HEADERS if self.options.get("table") == "headers" else TILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(schema, dict(self.options))


def _source(spark: SparkSession):
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsBands)
    return spark.read.format("fits_bands")


def read_bands(spark: SparkSession, path: str, columns: list[str] | None = None, rows: tuple[int, int | None] = (0, None), channel: int | None = None, **options: object) -> DataFrame:
    """Tiles of the images below ``path``: the ``columns`` of TILES, of some rows and a channel."""
    fields = dict(f.strip().split(" ", 1) for f in TILES.split(", "))
    names = list(fields) if columns is None else columns
    reader = _source(spark).schema(", ".join(f"{n} {fields[n]}" for n in names)).option("rows", f"{rows[0]}:{'' if rows[1] is None else rows[1]}")
    if channel is not None:
        reader = reader.option("channel", channel)
    return reader.options(**options).load(path)


def read_headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """HEADERS of the first image of each file; no pixels are fetched."""
    return _source(spark).options(table="headers", **options).load(path)
