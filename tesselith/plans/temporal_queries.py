"""Queries of sessions, gaps and drift, over the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselith.operators import ranking as R
from tesselith.operators import temporal as T
from tesselith.plans.inputs import view, with_views
from tesselith.plans.registry import query

_SESSIONS = """t AS (SELECT *, CASE WHEN NOT untimed THEN epoch_us(ts) END AS tm FROM sequence),
    o AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY batch ORDER BY tm, id) <= 900000000 THEN 0 ELSE 1 END AS opens FROM t WHERE tm IS NOT NULL),
    s AS (SELECT id, batch, tm, value, sum(opens) OVER (PARTITION BY batch ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS session FROM o
          UNION ALL SELECT id, batch, NULL, value, 0 FROM t WHERE tm IS NULL)"""


def _sessions(spark, sf_dir):
    rows = view(spark, sf_dir, "sequence").withColumn("at", F.when(~F.col("untimed"), F.col("ts").cast("timestamp")))
    return T.gap_sessions(rows.drop("ts", "props", "kind", "untimed"), ["batch"], "at", ["id"])


@query("gap_sessions", with_views(f"WITH {_SESSIONS} SELECT id, batch, CAST(session AS BIGINT) AS session FROM s", "sequence"))
def gap_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).select("id", "batch", "session")


@query("union_timed", with_views(f"WITH {_SESSIONS} SELECT id, batch, session > 0 AS timed, tm AS micros FROM s", "sequence"))
def union_timed(spark, sf_dir):
    return _sessions(spark, sf_dir).select("id", "batch", (F.col("session") > 0).alias("timed"), F.col("_at").alias("micros"))


@query(
    "group_gaps",
    with_views(
        f"""WITH {_SESSIONS}, g AS (SELECT batch, session, min(tm) AS a, max(tm) AS z, count(*) AS n, median(value) AS m FROM s GROUP BY ALL)
        SELECT batch, CAST(session AS BIGINT) AS session, n, round(m, 6) AS median_value, (z - a) / 1e6 AS duration_seconds,
        CASE WHEN session > 0 THEN (a - lag(z) OVER (PARTITION BY batch, session > 0 ORDER BY session)) / 1e6 END AS gap_before_seconds FROM g""",
        "sequence",
    ),
)
def group_gaps(spark, sf_dir):
    return T.session_summary(_sessions(spark, sf_dir), ["batch"], ["value"]).select("batch", "session", "n", F.round("median_value", 6).alias("median_value"), "duration_seconds", "gap_before_seconds")


@query(
    "session_window",
    with_views(
        """WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY batch ORDER BY ts, id) <= 900000000 THEN 0 ELSE 1 END AS opens FROM sequence),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY batch ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT batch, epoch_us(min(ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY batch, k""",
        "sequence",
    ),
)
def session_window(spark, sf_dir):
    """Spark's own session windows; a gap of a whole 15 minutes still joins two."""
    rows = view(spark, sf_dir, "sequence").withColumn("at", F.col("ts").cast("timestamp"))
    # An event's session lasts up to, not including, the gap's end, so one microsecond more joins equal gaps.
    windows = rows.groupBy("batch", F.session_window("at", "15 minutes 1 microsecond")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return windows.select("batch", F.unix_micros("session_window.start").alias("start"), "n", "total")


@query(
    "seeing_baseline",
    with_views(
        f"""WITH {_SESSIONS}, m AS (SELECT batch, median(value) AS m FROM s WHERE session > 0 GROUP BY batch), d AS (SELECT batch, 1.4826e0 * median(abs(value - m)) AS d FROM s JOIN m USING (batch) WHERE session > 0 GROUP BY batch),
        g AS (SELECT batch, session, median(value) AS v FROM s WHERE session > 0 GROUP BY ALL)
        SELECT batch, CAST(session AS BIGINT) AS session, round(v, 6) AS median_value, round(m - 3 * d, 6) AS threshold, CASE WHEN d > 0 THEN v < m - 3 * d ELSE false END AS review FROM g JOIN m USING (batch) JOIN d USING (batch)""",
        "sequence",
    ),
)
def seeing_baseline(spark, sf_dir):
    timed = _sessions(spark, sf_dir).where("session > 0")
    base = R.robust(timed, ["value"], ["batch"])
    per = timed.groupBy("batch", "session").agg(F.median("value").alias("v"))
    threshold = F.col("value_median") - 3 * F.col("value_sigma")
    return per.join(base, "batch").select("batch", "session", F.round("v", 6).alias("median_value"), F.round(threshold, 6).alias("threshold"), ((F.col("value_sigma") > 0) & (F.col("v") < threshold)).alias("review"))


@query(
    "rolling_median",
    with_views(
        """SELECT id, round(CASE WHEN count(value) OVER w >= 4 THEN quantile_cont(value, 0.5) OVER w END, 6) AS rolling FROM sequence WINDOW w AS (PARTITION BY batch ORDER BY ts, id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
        "sequence",
    ),
)
def rolling_median(spark, sf_dir):
    return T.rolling_median(view(spark, sf_dir, "sequence"), ["batch"], [F.col("ts"), F.col("id")], "value").select("id", F.round("rolling", 6).alias("rolling"))


@query(
    "chain_segments",
    with_views(
        """WITH o AS (SELECT batch, value > 20 AS yes, lag(value > 20) OVER (PARTITION BY batch ORDER BY ts, id) AS was FROM sequence)
        SELECT batch, count(*) FILTER (yes AND NOT coalesce(was, false)) AS segments, count(*) FILTER (yes) AS accepted, count(*) FILTER (NOT yes) AS rejected FROM o GROUP BY batch""",
        "sequence",
    ),
)
def chain_segments(spark, sf_dir):
    return T.chain_segments(view(spark, sf_dir, "sequence"), ["batch"], [F.col("ts"), F.col("id")], F.col("value") > 20)


@query(
    "drift_batches",
    with_views(
        """WITH RECURSIVE o AS (SELECT id, batch, value, row_number() OVER (PARTITION BY batch ORDER BY ts, id) AS k FROM sequence),
        r AS (SELECT id, batch, k, CAST(1 AS BIGINT) AS segment, [value] AS h FROM o WHERE k = 1
            UNION ALL SELECT o.id, o.batch, o.k, r.segment + CASE WHEN len(h) >= 5 AND value > 2 * list_median(h) THEN 1 ELSE 0 END,
            CASE WHEN len(h) >= 5 AND value > 2 * list_median(h) THEN [value] ELSE list_append(h, value)[-10:] END FROM r JOIN o ON o.batch = r.batch AND o.k = r.k + 1)
        SELECT id, segment FROM r""",
        "sequence",
    ),
)
def drift_batches(spark, sf_dir):
    rows = view(spark, sf_dir, "sequence").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("id", "batch", "at", "value")
    return T.drift_batches(rows, "batch", ["at", "id"], "value", 2.0).select("id", "segment")
