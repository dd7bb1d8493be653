"""Whitening of embeddings, with covariances from sums of squares alone.

cov(i, j) = (var(i + j) - var(i) - var(j)) / 2, so all that the tasks gather are
sums over the vectors of squares: one for each dimension and one for each sum of
two dimensions. Entries are integers, centred before they are squared by the
integer next to their mean; what is left of the mean is taken off exactly, in the
sums. So every variance is an exact fraction, whatever the order of the tasks, and
is rounded once. The matrix that these make up (its size depends on the dimension
alone) is decomposed by ``eigh`` on the driver; the rows never leave the tasks.

Defined results: rows whose vector is null or not whole (see ``vectors``) are
dropped, repeated rows count as often as they occur, and null ids are carried
along. Entries are held to 2**26 after scaling. Components whose variance is
nothing beside the trace (1e-13 of it) can't be scaled to one and are left out,
so equal vectors, or a single one, have no rows. A deviation that doesn't fit in a
long is null. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

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

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
NOTHING = 1e-13

SUMS = "low int, high int, total decimal(38,0)"
WHITENED = "component int, deviation bigint, whitened double"


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S of their x; ``values`` the components' variances, falling; ``directions`` as columns."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    directions: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The whole parts of the means, which are taken off in integers."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Vectors to their components, of mean 0 and variance 1."""
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - self.centre) - rest) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sums of (n * x - S) ** 2, exactly; null where a long can't hold one."""
        near = x - self.centre
        far = (int(np.abs(near).max(initial=0)) + 1) * self.n
        kind = np.int64 if far * far * len(self.sums) < 1 << 63 else object
        away = near.astype(kind) * self.n - np.array([s % self.n for s in self.sums], kind)
        return [d if d < 1 << 63 else None for d in (away * away).sum(axis=1).tolist()]


def _squares(x: np.ndarray) -> dict[tuple[int, int], int]:
    """For centred x, the sums of x_i ** 2 as (i, i) and of (x_i + x_j) ** 2 as (i, j), exactly."""
    d = x.shape[1]
    far = 2 * int(np.abs(x).max(initial=0))
    rows = max(1, (1 << 62) // max(1, far * far))
    out: dict[tuple[int, int], int] = dict.fromkeys(((i, j) for i in range(d) for j in range(i, d)), 0)
    for at in range(0, len(x), rows):
        part = np.ascontiguousarray(x[at : at + rows].T)
        for i in range(d):
            pairs = part[i:] + part[i]
            for j, total in enumerate(np.einsum("ij,ij->i", pairs, pairs).tolist(), i):
                out[i, j] += total // 4 if i == j else total
    return out


def _sums_of_squares(d: int, centre: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows:
                for pair, own in _squares(vectors.whole_numbers(batch, d, SCALE) - np.array(centre)).items():
                    total[pair] = total.get(pair, 0) + own
        if total:
            low, high = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(map(Decimal, total.values()), pa.decimal128(38, 0))], names=["low", "high", "total"])

    return run


def covariance(n: int, totals: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariances of centred integers with these sums and sums of squares: each an exact fraction over n ** 2."""
    d = len(totals)
    spread = lambda square, total: n * square - total * total  # noqa: E731  n ** 2 times a variance
    out = np.zeros((d, d))
    own = [spread(squares[i, i], totals[i]) for i in range(d)]
    for i in range(d):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (spread(squares[i, j], totals[i] + totals[j]) - own[i] - own[j]) / (2 * n**2)
    return out


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` (a column ``vector`` of doubles, each of d entries); None without rows."""
    ship_package(rows.sparkSession)
    entry = lambda x: F.floor(F.greatest(F.least(SCALE * x, F.lit(float(vectors.MOST))), F.lit(-float(vectors.MOST)))).cast("bigint")
    first = rows.select(F.posexplode("vector").alias("at", "c")).groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(entry(F.col("c"))).alias("s")).orderBy("at").collect()  # d rows
    if not first:
        return None
    n, sums = first[0]["n"], [r["s"] for r in first]
    centre = tuple((2 * s + n) // (2 * n) for s in sums)
    found = rows.select("vector").mapInArrow(_sums_of_squares(d, centre), SUMS).groupBy("low", "high").agg(F.sum("total").alias("total")).collect()  # d * (d + 1) / 2 rows
    matrix = covariance(n, [s - n * c for s, c in zip(sums, centre, strict=True)], {(r["low"], r["high"]): int(r["total"]) for r in found})
    values, directions = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    kept = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NOTHING * trace]
    return Whitening(n, tuple(s + SHIFT * n for s in sums), trace, values[kept], directions[:, kept])


def _whiten(model: Whitening) -> Callable:
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = vectors.whole_numbers(batch, d, SCALE) + SHIFT
                own = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(own)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(model.deviations(x), pa.int64()).take(pa.array(own)), pa.array(model.of(x).ravel())],
                    names=["vec_id", "component", "deviation", "whitened"],
                )

    return run


def _products(model: Whitening) -> Callable:
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                w = model.of(vectors.whole_numbers(batch, d, SCALE) + SHIFT)
                total, sums = total + w.T @ w, sums + w.sum(axis=0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([sums.tolist()])], names=["products", "sums"])

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.values)
    found = rows.select("vector").mapInArrow(_products(model), "products array<double>, sums array<double>")
    each = lambda name: {r["at"]: r["x"] for r in found.select(F.posexplode(name).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()}  # noqa: E731  k * k rows at most
    products, sums = each("products"), each("sums")
    matrix = np.array([products[i] for i in range(k * k)]).reshape(k, k) / model.n
    mean = np.array([sums[i] for i in range(k)]) / model.n
    return float(np.abs(matrix - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> DataFrame:
    """For each kept row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    whole = stage(vectors.kept(rows.select("vec_id", embedding), embedding), "vectors")
    d = vectors.length(whole)
    whole = whole.where(F.size("vector") == d)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    model = fit(whole, d, components) if d else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    error = identity_error(whole, model)
    return whole.mapInArrow(_whiten(model), f"vec_id {id_type}, {WHITENED}").select(
        "vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error")
    )
