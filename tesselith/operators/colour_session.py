"""One colour correction for each session of frames, kept in a store and made again only when its frames change.

A session's model is the median, cell by cell, of the small similarities that at most ``MOST_SAMPLES`` of its frames give, evenly spread over
the sequence; it stands only where enough frames have one and they agree. Models are a table of published revisions: a session whose
fingerprint (its files, their sizes and times, and the revision of their transforms) is in the table isn't trained again, by this run or a later one.

Defined results: a session with too few frames that can be matched, or whose frames disagree, has rows that aren't accepted, with the
reason, and isn't tried again either until its frames change; repeated rows of a frame count once in the sample and each in the
fingerprint; frames without a session belong to none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.operators.detection import register_colours
from tesselith.operators.ranking import even_sample
from tesselith.sources import revisions
from tesselith.staging import stage

TABLE = "colour_models"
MOST_SAMPLES, LEAST_SAMPLES = 12, 3
#: What cells may spread by, and what the median confidence must be.
MOST_SPREAD, LEAST_CONFIDENCE = 0.35, 0.15
CELLS = ("a", "b", "c", "d", "tx", "ty")


def fingerprints(frames: DataFrame, revision: str) -> DataFrame:
    """(session, fingerprint) of frames (session, path, length, modified): the same for the same files in any order."""
    one = F.xxhash64("path", "length", "modified", F.lit(revision))
    parts = frames.where("session IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(one.cast("decimal(38,0)")).alias("s"))
    return parts.select("session", F.sha2(F.concat_ws(":", "n", "x", F.col("s").cast("string"), F.lit(revision)), 256).alias("fingerprint"))


def train(frames: DataFrame, height: int, width: int, max_shift: float = 2.0) -> DataFrame:
    """(session, colour, accepted, reason, samples, a .. ty, confidence, spread) of frames (session, path, frame, red, green, blue)."""
    keys = frames.where("session IS NOT NULL").select("session", "path", "frame").dropDuplicates(["session", "path"])
    chosen = even_sample(keys, ["session"], ["path"], MOST_SAMPLES).select("session", "path", "frame")
    own = frames.join(chosen.select("session", "path"), ["session", "path"], "left_semi").dropDuplicates(["session", "path"])
    fits = register_colours(own, height, width, max_shift).where("method <> 'none'")
    fits = stage(chosen.select("session", "frame").join(fits, "frame"), "fits")
    middle = fits.groupBy("session", "colour").agg(F.count(F.lit(1)).alias("samples"), F.median("confidence").alias("confidence"), *(F.median(c).alias(c) for c in CELLS))
    away = fits.join(middle.select("session", "colour", *(F.col(c).alias(f"m_{c}") for c in CELLS)), ["session", "colour"])
    spreads = away.groupBy("session", "colour").agg(F.greatest(*(F.median(F.abs(F.col(c) - F.col(f"m_{c}"))) for c in CELLS)).alias("spread"))
    every = chosen.select("session").distinct().withColumn("colour", F.explode(F.array(F.lit("red"), F.lit("blue"))))
    rows = every.join(middle.join(spreads, ["session", "colour"]), ["session", "colour"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    few = F.col("samples") < LEAST_SAMPLES
    apart = (F.col("spread") > MOST_SPREAD) | (F.col("confidence") < LEAST_CONFIDENCE)
    rows = rows.withColumn("reason", F.when(few, "insufficient_samples").when(apart, "inconsistent_samples"))
    # Both colours or none.
    whole = rows.groupBy("session").agg(F.bool_and(F.col("reason").isNull()).alias("accepted"))
    return rows.join(whole, "session").select("session", "colour", "accepted", "reason", "samples", *CELLS, "confidence", "spread")


def session_models(spark: SparkSession, root: str, frames: DataFrame, height: int, width: int, revision: str, max_shift: float = 2.0) -> tuple[DataFrame, int]:
    """The models of all sessions of ``frames`` (session, path, length, modified, frame, red, green, blue) with their fingerprints, and how many sessions were trained.

    New models are published under ``root``; a writer that another one has overtaken gets a ``revisions.Conflict``."""
    prints = stage(fingerprints(frames, revision), "fingerprints")
    at = revisions.head(spark, root)
    known = revisions.read(spark, root, TABLE, at.version) if at and TABLE in at.tables else None
    stale = prints if known is None else prints.join(known.select("session", "fingerprint").distinct(), ["session", "fingerprint"], "left_anti")
    trained = stale.count()
    if trained:
        fresh = train(frames.join(stale.select("session"), "session", "left_semi"), height, width, max_shift).join(stale, "session")
        kept = fresh if known is None else known.join(stale.select("session"), "session", "left_anti").unionByName(fresh)
        at = revisions.publish(spark, root, at.version if at else None, {TABLE: kept}, f"colours-{revision}")
    if at is None:
        return spark.createDataFrame([], f"session string, fingerprint string, colour string, accepted boolean, reason string, samples bigint, {', '.join(f'{c} double' for c in CELLS)}, confidence double, spread double"), 0
    return revisions.read(spark, root, TABLE, at.version).join(prints, ["session", "fingerprint"]), trained
