"""Language identification as inference of a mixture.

Each language is a distribution over hashed letter trigrams, counted over all
training texts. A document is a mixture of languages; expectation-maximisation
estimates the proportions from its trigrams' likelihoods, first over all
languages, then over the likeliest one, two, ... of them, and the set with the
best penalised likelihood is taken; a text is done when its best possible
likelihood can't pay the penalty of a further language. The language predicted is the one with the
largest proportion.

Defined results: a text that is null or has no letter is ``und`` with score 0;
empty training data make every text ``und``; a repeated row gets its own row;
an empty table gives an empty result; languages with equal proportions are
taken in alphabetical order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm import words as W
from tesselith.session import ship_package

UNKNOWN = "und"
BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 8
#: A further language must raise the log-likelihood by this times log(trigrams).
PENALTY = 3.0
#: So many languages fit a model that is sent to every task (128 KB each).
MAX_LANGUAGES = 256

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letters"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text and the bucket of each trigram, and whether each text has a letter.

    Trigrams lie within a word and the single blanks around it; each text begins and ends with a blank."""
    joined = "".join(f" {t} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    code = np.where(_letters()[code], code, np.uint32(0))
    has = np.zeros(len(texts), bool)
    has[text[code > 0]] = True
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (text[1:] != text[:-1])
    code, text = code[keep], text[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    middle = np.flatnonzero((code[1:-1] > 0) & (text[2:] == text[:-2])) + 1
    key = (code[middle - 1].astype(np.uint64) << W.U(42)) ^ (code[middle].astype(np.uint64) << W.U(21)) ^ code[middle + 1]
    return text[middle].astype(np.int64), (W.mix(key) % W.U(BUCKETS)).astype(np.int64), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in W.pieces(batch):
            langs = part.column("lang").to_pylist()
            text, bucket, _ = trigrams(part.column("text").to_pylist())
            for lang in set(langs):
                own = np.fromiter((x == lang for x in langs), bool, len(langs))
                if lang not in counts:
                    if len(counts) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(bucket[own[text]], minlength=BUCKETS)
    for lang, all_ in counts.items():
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(all_[some])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, in order, and their trigram probabilities (BUCKETS x languages) from all rows of (text, lang)."""
    ship_package(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("lang", F.lower("text").alias("text")).mapInArrow(_count, "lang string, bucket int, n bigint")
    counts = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():  # at most MAX_LANGUAGES x BUCKETS rows
        found.setdefault(row["lang"], np.zeros(BUCKETS))[row["bucket"]] = row["n"]
        if len(found) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(found)
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    table = np.stack([found[x] for x in langs], axis=1) + SMOOTHING
    return langs, table / table.sum(axis=0)


def _em(chance: np.ndarray, count: np.ndarray, starts: np.ndarray, doc: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many rounds, and the log-likelihoods with them. Zero shares stay zero."""
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        part = chance * share[doc]
        part *= (count / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    return share, np.add.reduceat(count * np.log((chance * share[doc]).sum(axis=1)), starts)


def infer(texts: list[str], langs: list[str], table: np.ndarray) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """For each text the language, a score and all languages of the chosen set with their proportions."""
    out: list[tuple[str, float, list[tuple[str, float]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    text, bucket, _ = trigrams(texts)
    if not len(text) or not langs:
        return out
    key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
    text, bucket, count = key // BUCKETS, key % BUCKETS, count.astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    where, doc = text[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(text))))
    chance, n, size = table[bucket], np.add.reduceat(count, starts), len(langs)
    share, _ = _em(chance, count, starts, doc, np.full((len(starts), size), 1 / size), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    alone = np.add.reduceat(count[:, None] * np.log(chance), starts, axis=0)
    best = np.zeros_like(share)
    first = np.argmax(alone, axis=1)
    best[np.arange(len(starts)), first] = 1
    score = alone[np.arange(len(starts)), first]
    # The log-likelihood is concave in the shares, so its slopes bound what any set of languages can reach.
    mixed = (chance * share[doc]).sum(axis=1)
    slope = np.add.reduceat(chance * (count / mixed)[:, None], starts, axis=0).max(axis=1)
    most = np.add.reduceat(count * np.log(mixed), starts) + slope - n
    for k in range(2, size + 1):
        open_ = np.flatnonzero(most - PENALTY * (k - 1) * np.log(n + 1) + 1e-6 > score)
        if not len(open_):
            break
        rows = np.isin(doc, open_)
        lengths = np.diff(np.append(starts, len(text)))[open_]
        own_doc, own_starts = np.repeat(np.arange(len(open_)), lengths), np.cumsum(lengths) - lengths
        part, near = np.zeros((len(open_), size)), order[open_, :k]
        np.put_along_axis(part, near, np.maximum(np.take_along_axis(share[open_], near, axis=1), 1e-6), axis=1)
        part, fit = _em(chance[rows], count[rows], own_starts, own_doc, part / part.sum(axis=1, keepdims=True), ROUNDS // 2)
        fit = fit - PENALTY * (k - 1) * np.log(n[open_] + 1)
        better = fit > score[open_]
        best[open_[better]], score[open_[better]] = part[better], fit[better]
    for i, d in enumerate(where):
        ranked = [(langs[j], float(best[i, j])) for j in np.argsort(-best[i], kind="stable") if best[i, j] > 0]
        # The posterior mean of the proportion: few trigrams leave it near even.
        out[d] = (ranked[0][0], (ranked[0][1] * n[i] + 1) / (n[i] + size), ranked)
    return out


def _slices(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most so many letters (one longer text is one run)."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < most):
            size += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def predict_rows(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc, lang_pred, score, languages): the whole row beside its prediction, without a join. ``languages`` is the
    chosen set with its proportions."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,languages:array<struct<lang:string,share:double>>>")
    def language(texts):
        import pandas as pd

        langs, table = sent.value
        lists = [t or "" for t in texts]
        rows: list[tuple] = []
        # A row of the table for each different trigram of a text: with more languages, fewer texts at once.
        for start, stop in _slices(lists, W.PIECE_BYTES * 8 // max(8, len(langs))):
            rows += [(x, y, [{"lang": a, "share": b} for a, b in z]) for x, y, z in infer(lists[start:stop], langs, table)]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "languages"])

    found = docs.select(F.struct("*").alias("doc"), language(F.lower("text")).alias("found"))
    return found.select("doc", "found.*")


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, languages) for each row of ``docs``."""
    return predict_rows(docs.select(key, "text"), model).select(F.col(f"doc.{key}").alias(key), "lang_pred", "score", "languages")


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without those whose language is unknown: no text, or none with letters."""
    model = train(docs.where(~held_out()).select("text", "lang"))
    known = predict_rows(docs, model)
    return known.where(F.col("lang_pred") != UNKNOWN).select("doc.*")
