"""Sessions, gaps and drift in sequences of frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_MINUTES = 15.0
LEAST_HISTORY, MOST_HISTORY = 5, 10


def gap_sessions(rows: DataFrame, batch: list[str], time: str, order: list[str], minutes: float = GAP_MINUTES) -> DataFrame:
    """``session`` from 1 on: a new one where the gap is over the limit, not where it is equal; rows without time
    make one last, untimed session, 0. ``time`` is a timestamp."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    timed = rows.where(F.col(time).isNotNull()).withColumn("_at", micros)
    w = Window.partitionBy(*batch).orderBy("_at", *order)
    opens = F.coalesce(F.col("_at") - F.lag("_at").over(w) > round(minutes * 60e6), F.lit(True)).cast("int")
    grouped = timed.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w)).drop("_opens")
    return grouped.unionByName(rows.where(F.col(time).isNull()).withColumn("_at", F.lit(None).cast("bigint")).withColumn("session", F.lit(0).cast("bigint")))


def session_summary(sessions: DataFrame, batch: list[str], metrics: list[str]) -> DataFrame:
    """One row per session with its time, the gap before it, counts and medians."""
    per = sessions.groupBy(*batch, "session").agg(
        F.min("_at").alias("start"), F.max("_at").alias("end"), F.count(F.lit(1)).alias("n"), *(F.median(m).alias(f"median_{m}") for m in metrics)
    )
    w = Window.partitionBy(*batch).orderBy("session")
    timed = per.where("session > 0").withColumn("gap_before_seconds", (F.col("start") - F.lag("end").over(w)) / 1e6)
    whole = timed.unionByName(per.where("session = 0").withColumn("gap_before_seconds", F.lit(None).cast("double")))
    return whole.withColumn("duration_seconds", (F.col("end") - F.col("start")) / 1e6)


def rolling_median(rows: DataFrame, batch: list[str], order: list[Column], value: str, before: int = 8, least: int = 4) -> DataFrame:
    """``rolling``: the median of the values before a row, null where there are too few."""
    w = Window.partitionBy(*batch).orderBy(*order).rowsBetween(-before, -1)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))


def chain_segments(rows: DataFrame, batch: list[str], order: list[Column], accepted: Column) -> DataFrame:
    """The number of runs of accepted rows in each batch."""
    w = Window.partitionBy(*batch).orderBy(*order)
    marked = rows.withColumn("_in", accepted)
    starts = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return marked.withColumn("_starts", starts).groupBy(*batch).agg(F.count_if("_starts").alias("segments"), F.count_if("_in").alias("accepted"), F.count_if(~F.col("_in")).alias("rejected"))


class Drift:
    """Segments of a sequence of scores: a score over ``factor`` times the median of the last ones opens a new
    segment and a new history, which begins with it. A score that is no number leaves the history as it is."""

    def __init__(self, factor: float) -> None:
        self.factor, self.segment, self.history = factor, 1, []

    def step(self, score: float | None) -> int:
        if score is None or score != score or score in (float("inf"), float("-inf")):
            return self.segment
        if len(self.history) >= LEAST_HISTORY:
            recent = sorted(self.history)
            half = len(recent) // 2
            middle = recent[half] if len(recent) % 2 else (recent[half - 1] + recent[half]) / 2
            if score > middle * self.factor:
                self.segment, self.history = self.segment + 1, []
        self.history = [*self.history, score][-MOST_HISTORY:]
        return self.segment


def drift_batches(rows: DataFrame, batch: str, order: list[str], score: str, factor: float) -> DataFrame:
    """``segment`` for each row. Rows stream through in order: Spark sorts each batch on the way, so only the last
    scores of the batch at hand are held, and a long sequence needs no more memory than a short one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, drift = None, Drift(factor)
        for part in parts:
            segments = []
            for key, value in zip(part[batch], part[score], strict=True):
                if key != at:
                    at, drift = key, Drift(factor)
                segments.append(drift.step(None if value is None else float(value)))
            yield part.assign(segment=segments)

    dealt = rows.repartition(batch).sortWithinPartitions(batch, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", segment bigint"
    return dealt.mapInPandas(run, schema)
