"""Stacks as FITS files: 16-bit codes, masks and provenance, published together.

    image_rows(pixels, ["batch"], 8, 8, cards).write.format("fits_images").mode("append").save(folder)

A row is an image (``IMAGE``). Tasks write whole files into a folder beside their place that no reader looks into; when all have ended, the driver moves
them to their names, and where a task fails nothing is moved. So a file is there whole or not at all. Mode ``append`` refuses names that exist already, ``overwrite``
replaces them (and leaves other files alone). Paths are those of Arrow's file systems.

Defined results: a null code counts as 0 and a null flag as false; rows of equal names are an error before anything is moved; an empty table writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tesselith.session import ship_package
from tesselith.sources import fits
from tesselith.sources.fits_bands import filesystem

IMAGE = "name string, height int, width int, code array<int>, valid array<boolean>, saturated array<boolean>, cards map<string,string>"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FitsWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.draft = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, inner = filesystem(self.path)
        folder, names = f"{inner}/{self.draft}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not names:
                files.create_dir(folder, recursive=True)
            shape = (row["height"], row["width"])
            code = np.array([c or 0 for c in row["code"]], np.uint16).reshape(shape)
            valid, saturated = (np.array([bool(f) for f in row[m]], bool).reshape(shape) for m in ("valid", "saturated"))
            with files.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(fits.encode(code, {k: v for k, v in (row["cards"] or {}).items() if v is not None}, valid, saturated))
            names.append(f"{folder}/{row['name']}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, inner = filesystem(self.path)
        moves = {}
        for draft in (n for m in messages if m for n in m.names):
            name = f"{inner}/{draft.rsplit('/', 1)[1]}"
            if name in moves:
                self.abort(messages)
                raise ValueError(f"two images are named {name}")
            moves[name] = draft
        from pyarrow import fs

        there = [i.path for i in files.get_file_info(list(moves)) if i.type != fs.FileType.NotFound] if moves else []
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{there[0]} exists already")
        for name, draft in moves.items():
            files.move(draft, name)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, inner = filesystem(self.path)
        if files.get_file_info(f"{inner}/{self.draft}").type == fs.FileType.Directory:
            files.delete_dir(f"{inner}/{self.draft}")


class FitsImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_images"

    def schema(self) -> str:
        return IMAGE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FitsWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FitsImages)


def image_rows(pixels: DataFrame, keys: list[str], name: Column, height: int, width: int, cards: dict[str, Column]) -> DataFrame:
    """IMAGE rows of pixels (keys, pos, code, valid, saturated), one for each group of keys; positions without a row have code 0 and aren't valid.

    ``name`` and ``cards`` (of at most eight letters) are made of keys. An image is put together in one task, and is as large as a camera's frame."""
    present = F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), F.struct("code", "valid", "saturated"))))
    whole = pixels.where(F.col("pos").between(0, height * width - 1)).groupBy(*keys).agg(present.alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda i: F.try_element_at("p", i))
    made = whole.select(*keys, at.alias("p"))
    flag = lambda n: F.transform("p", lambda x: F.coalesce(x[n], F.lit(False)))
    entries = F.create_map(*(c for k, v in cards.items() for c in (F.lit(k), v.cast("string")))) if cards else F.expr("cast(map() as map<string,string>)")
    return made.select(
        name.alias("name"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.transform("p", lambda x: F.coalesce(x["code"], F.lit(0)).cast("int")).alias("code"), flag("valid").alias("valid"), flag("saturated").alias("saturated"), entries.alias("cards")
    )
