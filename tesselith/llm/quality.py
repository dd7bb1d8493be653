"""A quality classifier by Bradley-Terry ranking.

A document's score is linear in features of its text: counts of words, lines,
digits, symbols and capitals (A to Z and Latin-1's), which need no vocabulary. Training draws pairs of a
better and a worse document and fits the weights by logistic loss on the
difference of their features, as the Bradley-Terry model has it: the chance that
one beats another is the logistic function of the difference of their scores.
The fit may take a sample of the labelled documents; the threshold is the quantile
of the scores of all of them that are not held out, which leaves their share of
worse documents below it. A score is shifted so that the threshold is 0.7.

Defined results: null and empty texts have all features 0 and a score like any
other text; without labels of both kinds all weights are 0 and every score is
0.7; labels that are neither 0 nor 1, and labels of unknown documents, are
ignored; a repeated row gets its own result row; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.llm import words as W
from tesselith.session import ship_package
from tesselith.staging import stage

FEATURES = (
    "log_words",
    "distinct_words",
    "repeated_words",
    "symbols",
    "symbol_runs",
    "capitals",
    "digits",
    "word_length",
    "short_words",
    "repeated_lines",
    "line_words",
)
#: Labelled rows that the fit uses at most (those with the least hash), of each label.
MOST_LABELLED = 20_000
#: Pairs for each document of the label that has more in the sample.
PAIRS = 4
BINS = 1024
THRESHOLD = 0.7
REGULARISATION = 1e-3

_CLASS = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 symbol
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2


def features(column: pa.Array) -> np.ndarray:
    """FEATURES of whole texts, one row for each."""
    data, offsets = W.buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    hashes, at = W.hashes(column)
    starts, ends, _ = W.bounds(data, offsets)
    kind = _CLASS[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per_text_of_words(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    solid = np.maximum(per_text(kind > 0), 1)
    letters = np.maximum(per_text(kind == 1), 1)
    symbol = kind == 3
    run = symbol.copy()
    run[1:] &= symbol[:-1]
    upper = ((data >= 65) & (data <= 90)).copy()
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    lengths = ends - starts
    words = np.maximum(np.diff(at), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    distinct = np.array([len(np.unique(hashes[at[d] : at[d + 1]])) for d in range(n)], float)
    out[:, 0] = np.log1p(np.diff(at))
    out[:, 1] = distinct / words**0.9  # the share of distinct words falls with length
    out[:, 2] = per_text_of_words(same) / words
    out[:, 3] = np.sqrt(per_text(symbol) / solid)
    out[:, 4] = np.sqrt(per_text(run) / solid)
    out[:, 5] = per_text(upper) / letters
    out[:, 6] = per_text(kind == 2) / solid
    out[:, 7] = np.minimum(per_text_of_words(lengths) / words, 20) / 10
    out[:, 8] = per_text_of_words(lengths <= 3) / words
    for d, text in enumerate(column.to_pylist()):
        lines = [x for x in (text or "").split("\n") if x]
        if lines:
            out[d, 9] = 1 - len(set(lines)) / len(lines)
            out[d, 10] = np.log1p(words[d] / len(lines))
    out[np.diff(at) == 0] = 0
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch):
            rows = features(part.column("text"))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))], names=["doc_id", "features"])


def featurise(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of (doc_id, text)."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_featurise, "doc_id bigint, features array<double>")


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    threshold: float

    def score(self, features: F.Column) -> F.Column:
        raw = F.aggregate(F.zip_with(features, F.array(*(F.lit(float(w)) for w in self.weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), raw - self.threshold + shift))))


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a document's label is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def quantile(values: DataFrame, share: float) -> float:
    """The exact quantile of the column ``v``, between two values in proportion, as F.percentile has it.

    Each round counts the values of some bins, and goes on with the one that holds the value of the rank sought; no
    task gets more than BINS rows of a count."""
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    position = share * (whole["n"] - 1)
    rank, low, high, below = int(position), whole["low"], whole["high"], 0
    while low < high:
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * BINS))
        rows = values.where(F.col("v").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(rows.collect(), key=lambda r: r["bin"]):  # at most BINS rows
            if rank < below + row["n"]:
                low, high = row["low"], row["high"]
                break
            below += row["n"]
    after = values.agg(F.count_if(F.col("v") <= low).alias("n"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("next")).first()
    following = low if rank + 1 < after["n"] or after["next"] is None else after["next"]
    return low + (position - rank) * (following - low)


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``rows`` (doc_id, features) with ``labels`` (doc_id, quality), by preference pairs."""
    known = rows.join(labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1)"), "doc_id").select("doc_id", "features", "label")
    # Within a label, the rows with the least hashes: a sort with a limit, which no single task does alone.
    sampled = [known.where(F.col("label") == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED) for side in (0, 1)]
    both = stage(sampled[0].unionByName(sampled[1]), "labelled")
    counts = {r["label"]: r["n"] for r in both.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model((0.0,) * len(FEATURES), 0.0)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - 1)  # at most MOST_LABELLED rows of a label
    # Each row of the label with more rows gets PAIRS of the other one's, in turn, so that every row is in some pair.
    names = {0: "worse", 1: "better"}
    more = 1 if counts[1] >= counts[0] else 0
    less = ranked.where(F.col("label") == 1 - more).select("rank", F.col("features").alias(names[1 - more]))
    turns = ranked.where(F.col("label") == more).select(F.col("features").alias(names[more]), F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1))).alias("turn"), F.col("rank").alias("of"))
    turns = turns.withColumn("rank", F.pmod(F.col("of") * PAIRS + F.col("turn"), F.lit(counts[1 - more])))
    difference = F.zip_with("better", "worse", lambda a, b: a - b)
    # Each pair once as a win and once, turned round, as a loss, for a loss function that knows two outcomes.
    turned = F.explode(F.array(F.lit(1.0), F.lit(0.0))).alias("won")
    pairs = turns.join(less, "rank").select(difference.alias("d"), turned)
    pairs = pairs.select(array_to_vector(F.when(F.col("won") == 1, F.col("d")).otherwise(F.transform("d", lambda x: -x))).alias("features"), F.col("won").alias("label"))
    pairs = stage(pairs, "pairs")
    fitted = LogisticRegression(fitIntercept=False, regParam=REGULARISATION, maxIter=50, standardization=True).fit(pairs)
    weights = tuple(float(w) for w in fitted.coefficients)
    raw = F.aggregate(F.zip_with("features", F.array(*(F.lit(w) for w in weights)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    every = stage(known.select("label", raw.alias("v")), "training_scores")
    share = every.agg(F.avg(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).alias("share")).first()["share"]
    return Model(weights, float(quantile(every, share)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, features) for each row of ``docs``."""
    rows = stage(featurise(docs), "features")
    model = train(rows.where("doc_id is not null").where(~held_out()), labels)
    scored = rows.withColumn("score", model.score(F.col("features")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD - 1e-12).cast("int").alias("predicted"), "features")
