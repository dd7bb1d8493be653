"""Tables published in revisions, by optimistic concurrency.

A revision is one small file below ``_revisions``, numbered from 1, that names the tables in force and the revision
that it follows. Tables are written first, below ``_tables`` in folders that no one else writes to; then the revision's file is
created whole under the next number, which only one writer can do. So readers see all tables of the old revision or all
of the new one, and of two writers that began from the same revision the second one gets a ``Conflict`` and has changed
nothing: it reads again what is in force, and decides anew.

A file comes into being under its name by a link (local file systems) or a rename that doesn't replace (HDFS and
others that keep Hadoop's contract). An object store needs a committer that gives this promise.

Tables that a revision doesn't write stay in force as they are. Defined results: a root without revisions has head None
and is followed by naming None as the parent; readers of a table that isn't there get a KeyError; old revisions can be read as
long as their files are kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

REVISIONS, TABLES = "_revisions", "_tables"


class Conflict(RuntimeError):
    """Another writer has published a revision after the one that this writer began from."""


@dataclass(frozen=True)
class Revision:
    version: int
    name: str
    parent: int | None
    #: Folders by table, relative to the root.
    tables: Mapping[str, str]
    #: What the writer noted.
    detail: Mapping[str, object] = field(default_factory=dict)


def _hadoop(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    path, files = _hadoop(spark, f"{root}/{REVISIONS}")
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def revision(spark: SparkSession, root: str, version: int) -> Revision:
    path, files = _hadoop(spark, f"{root}/{REVISIONS}/{version:020d}.json")
    stream = files.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Revision(**json.loads(text))


def head(spark: SparkSession, root: str) -> Revision | None:
    """The revision in force."""
    versions = _versions(spark, root)
    return revision(spark, root, versions[-1]) if versions else None


def _create(spark: SparkSession, root: str, version: int, content: bytes) -> bool:
    """Make the revision's file with this content, unless there is one; whether it was made."""
    target, files = _hadoop(spark, f"{root}/{REVISIONS}/{version:020d}.json")
    draft, _ = _hadoop(spark, f"{root}/{REVISIONS}/.{uuid.uuid4().hex}.draft")
    files.mkdirs(draft.getParent())
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    try:
        if files.getScheme() == "file":
            java, local = spark._jvm.java.nio.file, lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                java.Files.createLink(local(files.makeQualified(target)), local(files.makeQualified(draft)))
                return True
            except Exception as error:
                if "FileAlreadyExistsException" in str(error):
                    return False
                raise
        return not files.exists(target) and bool(files.rename(draft, target))
    finally:
        if files.exists(draft):
            files.delete(draft, False)


def commit(spark: SparkSession, root: str, parent: int | None, tables: Mapping[str, str], name: str, detail: Mapping[str, object] | None = None) -> Revision:
    """Put ``tables`` (folders relative to the root) in force after the revision ``parent``, or raise Conflict."""
    at = head(spark, root)
    if (at.version if at else None) != parent:
        raise Conflict(f"revision {parent} was expected in force, but {at.version if at else None} is")
    made = Revision((parent or 0) + 1, name, parent, {**(at.tables if at else {}), **tables}, dict(detail or {}))
    content = json.dumps(made.__dict__, sort_keys=True, default=str).encode()
    if not _create(spark, root, made.version, content):
        raise Conflict(f"revision {made.version} has been published by another writer")
    return made


def publish(spark: SparkSession, root: str, parent: int | None, frames: Mapping[str, DataFrame], name: str, detail: Mapping[str, object] | None = None, partition: str | None = None) -> Revision:
    """Write tables and put them in force together. ``parent``: the version that they were made from. On a conflict what was written is deleted."""
    folder = f"{TABLES}/{uuid.uuid4().hex}"
    try:
        for table, rows in frames.items():
            writer = rows.write.mode("errorifexists")
            (writer.partitionBy(partition) if partition else writer).parquet(f"{root}/{folder}/{table}")
        return commit(spark, root, parent, {table: f"{folder}/{table}" for table in frames}, name, detail)
    except Exception:
        path, files = _hadoop(spark, f"{root}/{folder}")
        files.delete(path, True)
        raise


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as the revision in force, or an older one, has it."""
    at = head(spark, root) if version is None else revision(spark, root, version)
    if at is None or table not in at.tables:
        raise KeyError(table)
    return spark.read.parquet(f"{root}/{at.tables[table]}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, parent, name, tables, detail) of all revisions; ``detail`` as JSON."""
    rows = [(r.version, r.parent, r.name, dict(r.tables), json.dumps(dict(r.detail), sort_keys=True)) for r in (revision(spark, root, v) for v in _versions(spark, root))]
    return spark.createDataFrame(rows, "version int, parent int, name string, tables map<string,string>, detail string")
