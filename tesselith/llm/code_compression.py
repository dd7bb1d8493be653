"""Product codes of vectors, their nearest codebook entries found by a GNAT over the entries.

A vector of integers is cut into equal parts, and each part gets the index of the
nearest of its codebook's entries. The entries of a codebook stand in a GNAT (a
geometric near-neighbour access tree): a node has split points, each entry belongs
to the nearest split point, and for each split point and each of the node's
children the range of distances from the one to the entries of the other is kept.
A query that is nearer to its best entry so far than a child's range allows, seen
from any split point, passes the whole child over. Distances are square roots, so
bounds are rounded outwards and a child goes only when it is strictly too far:
what can tie stays, and ties are settled by integers, in favour of the lower index.
Queries go through the tree in blocks, a child with those that it may serve.

Codebooks are fitted to all rows: tasks send the sums of the parts they gave to
each entry, at most one row for an entry, and the driver holds the entries alone.

Defined results: rows whose vector is null or not whole (see ``vectors``), and
those whose length isn't divisible by the number of parts, are dropped. Entries are
held to 2**26 after scaling. Of equal vec_ids the smaller vector comes first; null
ids come last. Fewer rows than entries give as many entries as there are rows. A
sum that doesn't fit in a long is null. An empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm import vectors
from tesselith.session import ship_package
from tesselith.staging import stage

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SPLITS = 8
#: Entries that a node compares one by one.
LEAF = 4
QUERIES_AT_ONCE = 4096

SUMS = "part int, entry int, at int, total decimal(38,0), n bigint"
CODED = "code string, error bigint"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of one to all of the other, in long integers."""
    away = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", away, away)


def _below(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(np.nextafter(square.astype(np.float64), -np.inf).clip(0)), -np.inf)


def _above(square: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(np.nextafter(square.astype(np.float64), np.inf)), np.inf)


@dataclass
class Gnat:
    """A node over the entries ``index``, ascending: ``splits`` of them are compared first; child i has entries nearest to split i,
    between ``low[s, i]`` and ``high[s, i]`` away from split s."""

    index: np.ndarray
    splits: np.ndarray
    children: list[Gnat | None]
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def over(cls, entries: np.ndarray, index: np.ndarray | None = None) -> Gnat:
        index = np.arange(len(entries)) if index is None else index
        if len(index) <= LEAF:
            return cls(index, index, [None] * len(index), np.zeros((0, 0)), np.zeros((0, 0)))
        own = squared(entries[index], entries[index])
        chosen = [0]
        while len(chosen) < min(SPLITS, len(index)):  # the next split is the entry farthest from those before
            nearest = own[:, chosen].min(axis=1)
            nearest[chosen] = -1
            chosen.append(int(np.argmax(nearest)))
        chosen = np.sort(np.array(chosen))
        rest = np.setdiff1d(np.arange(len(index)), chosen)
        nearest = np.argmin(own[np.ix_(rest, chosen)], axis=1)
        children, low, high = [], np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)
        for i in range(len(chosen)):
            members = rest[nearest == i]
            children.append(cls.over(entries, index[members]) if len(members) else None)
            if len(members):
                ways = own[np.ix_(chosen, members)]
                low[:, i], high[:, i] = _below(ways.min(axis=1)), _above(ways.max(axis=1))
        return cls(index, index[chosen], children, low, high)

    def search(self, entries: np.ndarray, queries: np.ndarray, best: np.ndarray, at: np.ndarray, rows: np.ndarray) -> int:
        """Put into ``best`` and ``at`` what is nearer, or as near with a lower index, for ``rows`` of the queries. The number of distances taken is returned."""
        ways = squared(queries[rows], entries[self.splits])
        near = np.argmin(ways, axis=1)  # of equal ones the first, which has the lowest index here
        way, which = ways[np.arange(len(rows)), near], self.splits[near]
        better = (way < best[rows]) | ((way == best[rows]) & (which < at[rows]))
        best[rows[better]], at[rows[better]] = way[better], which[better]
        taken = ways.size
        if any(self.children):
            lower, upper = _below(ways), _above(ways)
            for i in np.argsort([-np.count_nonzero(near == i) for i in range(len(self.children))], kind="stable"):
                child = self.children[i]
                if child is not None:
                    reach = _above(best[rows])[:, None]
                    far = (np.nextafter(lower - reach, -np.inf) > self.high[:, i]) | (np.nextafter(upper + reach, np.inf) < self.low[:, i])
                    left = rows[~far.any(axis=1)]
                    if len(left):
                        taken += child.search(entries, queries, best, at, left)
        return taken


def nearest(entries: np.ndarray, tree: Gnat, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the index of the nearest entry (of equally near ones the lowest), its squared distance; and the number of distances taken."""
    best, at = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(entries))
    taken = tree.search(entries, queries, best, at, np.arange(len(queries))) if len(queries) else 0
    return at, best, taken


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows: the batch, its vectors by part, and by part the index and squared distance of the nearest entry."""
    parts, _, size = books.shape
    trees = [Gnat.over(b) for b in books]
    for whole in batches:
        for begin in range(0, whole.num_rows, QUERIES_AT_ONCE):
            batch = whole.slice(begin, QUERIES_AT_ONCE)
            x = vectors.whole_numbers(batch, parts * size, SCALE).reshape(-1, parts, size)
            found = [nearest(books[p], trees[p], np.ascontiguousarray(x[:, p])) for p in range(parts)]
            yield batch, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray) -> Callable:
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for _, x, at, _ in _blocks(batches, books):
            for p in range(parts):
                np.add.at(total[p], at[:, p], x[:, p])
                n[p] += np.bincount(at[:, p], minlength=entries)
        part, entry, place = (a.ravel() for a in np.indices(total.shape))
        used = np.repeat(n.ravel() > 0, size)
        columns = (part, entry, place, [Decimal(int(t)) for t in total.ravel()[used]], np.repeat(n.ravel(), size))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, list) else c[used], t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "at", "total", "n"])

    return run


def _codes(books: np.ndarray) -> Callable:
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, square in _blocks(batches, books):
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in at.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(square.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return run


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks of the rows with the smallest vec_ids: (part, entry, place)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r["vector"] for r in first], pa.list_(pa.float64()))], names=["vector"])
    d = len(first[0]["vector"])
    return np.ascontiguousarray(vectors.whole_numbers(batch, d, SCALE).reshape(-1, parts, d // parts).transpose(1, 0, 2))


def fit(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over all ``rows``."""
    ship_package(rows.sparkSession)
    for _ in range(rounds):
        found = rows.select("vector").mapInArrow(_sums(books), SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # no more rows than the codebooks have numbers
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, embedding: str = "embedding") -> DataFrame:
    """For each kept row: vec_id, code, error, label_error, codebooks_sha256."""
    spark = rows.sparkSession
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    whole = stage(vectors.kept(rows.select("vec_id", embedding, "label"), embedding), "vectors")
    d = vectors.length(whole)
    if not d or d % parts:
        return spark.createDataFrame([], f"vec_id {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    whole = whole.where(F.size("vector") == d)
    books = fit(whole, first_books(whole, parts, entries), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stage(whole.mapInArrow(_codes(books), f"vec_id {id_type}, label {label_type}, {CODED}"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = coded.groupBy("label").agg(F.when(total < F.lit(Decimal(1 << 63)), total).cast("bigint").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
