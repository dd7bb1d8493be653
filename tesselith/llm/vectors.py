"""Vectors of a table as Arrow batches of integers, for operators on embeddings.

Kept are rows whose vector is not null and holds only finite entries. The vectors
of one table have one length, that of most kept rows (of equally many, the greater
one); rows of another length are dropped as well, and so are empty vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest size of an entry once it is an integer; greater ones are brought down to it.
MOST = 1 << 26


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def kept(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The rows whose vectors are whole, with the vector as doubles in the column ``vector``, instead of ``embedding``."""
    whole = rows.where(F.col(embedding).isNotNull() & F.forall(embedding, _finite) & (F.size(embedding) > 0))
    return whole.withColumn("vector", F.col(embedding).cast("array<double>")).drop(*({embedding} - {"vector"}))


def length(rows: DataFrame) -> int:
    """The length of most vectors; 0 of none."""
    counts = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return counts["length"] if counts else 0


def whole_numbers(batch: pa.RecordBatch, length: int, scale: int) -> np.ndarray:
    """floor(scale * entry) of the vectors, all of ``length``, as a table of long integers."""
    values = np.asarray(batch.column("vector").flatten(), np.float64).reshape(-1, length)
    return np.floor(np.clip(scale * values, -MOST, MOST)).astype(np.int64)
