"""Sessions and drift of sequences that are still arriving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesselith.operators.temporal import GAP_MINUTES, Drift


def streaming_sessions(rows: DataFrame, batch: str, time: str, late: str = "10 minutes", minutes: float = GAP_MINUTES) -> DataFrame:
    """Sessions of a stream, given out when the watermark has passed them; equal gaps join, as in batch mode."""
    gap = f"{int(minutes * 60)} seconds 1 microsecond"
    return rows.withWatermark(time, late).groupBy(batch, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n")).select(batch, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def streaming_drift(rows: DataFrame, batch: str, order: str, score: str, factor: float) -> DataFrame:
    """``segment`` for each row of a stream whose rows of a batch arrive in order from trigger to trigger.

    The state of a batch is its segment and the last scores, so it doesn't grow with the stream."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drift = Drift(factor)
        if state.exists:
            drift.segment, history = state.get
            drift.history = list(history)
        own = pd.concat(list(parts)).sort_values(order)
        segments = [drift.step(None if v is None else float(v)) for v in own[score]]
        state.update((drift.segment, drift.history))
        yield pd.DataFrame({batch: key[0], order: own[order], "segment": segments})

    schema = f"{batch} {kinds[batch]}, {order} {kinds[order]}, segment bigint"
    return rows.groupBy(batch).applyInPandasWithState(run, schema, "segment bigint, history array<double>", "append", GroupStateTimeout.NoTimeout)
