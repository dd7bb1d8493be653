"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; the words at its 0s are ignored,
so a changed word there doesn't hide a hit. The hashes of all seeds at all
places of the benchmark items are joined with those of all documents. A hit
names a document, an item and a diagonal (place in the document minus place in
the item); along the diagonal the two are compared word by word, and the best
stretch counts, where a match adds 1 and a substitution takes off PENALTY.

Before the join each task drops the document hashes whose bit is not set in a
bitmap of the benchmark's hashes. The bitmap's size is fixed, so it can be sent
to all tasks whatever the benchmark's size; a fuller bitmap only lets more
rows through to the join.

Defined results: null, empty and wordless texts or items match nothing; an item
shorter than MIN_MATCHES words must match in ITEM_SHARE of its words, and is
sought by masks for its own length, down to the whole item; a document that
holds several items has a row for each; repeated rows of a doc_id or an item_id,
with equal texts or not, give one row per doc_id and item_id; items without an
item_id are compared like others, and share the row without item_id; documents without a doc_id are compared like
others, and each has its own rows, with a null doc_id; an empty table gives an empty result; further columns are
carried along by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselith.llm import words as W
from tesselith.session import ship_package
from tesselith.staging import stage

#: Six words count in each mask; together they find all overlaps of up to 20 words that have MIN_MATCHES matches.
MASKS = (
    "11101101", "1101100011", "111000111", "1010110011", "11010000001011", "10100010111",
    "101001001011", "1001000010111", "11001100101", "11010001011", "1000100001111",
)
#: Further masks for items of so few words, which leave out the words that may differ.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011"),
    6: ("11111", "110111", "111011"),
    7: ("111111", "1101111", "1110111", "1111011"),
    8: ("1111011", "11011101"),
    9: ("110110011",),
    10: ("110101011",),
}
ALL_MASKS = (*MASKS, *sorted({m for masks in SHORT_MASKS.values() for m in masks}))
BITMAP_BITS = 1 << 24
PENALTY = 1.5
MIN_MATCHES = 12
ITEM_SHARE = 0.8


def seeds(words: np.ndarray, at: np.ndarray, numbers: set[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each mask: its number, the seed hashes, the texts and the places they are from.

    ``numbers``: the masks for all texts; else those that each text has as an item of its length."""
    lengths = np.diff(at)
    for number, mask in enumerate(ALL_MASKS):
        if numbers is not None and number not in numbers:
            continue
        taken = [k for k, bit in enumerate(mask) if bit == "1"]
        counts = np.maximum(lengths - len(mask) + 1, 0)
        if numbers is None and number >= len(MASKS):
            counts[~np.isin(lengths, [n for n, masks in SHORT_MASKS.items() if mask in masks])] = 0
        if not counts.sum():
            continue
        rolled = np.zeros(len(words) - len(mask) + 1, np.uint64)
        factors = W.mix(np.arange(1, len(mask) + 1, dtype=np.uint64) * W.U(0x8CB92BA72F3D8DD7) + W.U(number)) | W.U(1)
        for k in taken:
            rolled += words[k : len(words) - len(mask) + 1 + k] * factors[k]
        text = np.repeat(np.arange(len(lengths)), counts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield number, W.mix(rolled[at[:-1][text] + place]), text, place


def _seed_rows(bitmap: Callable[[], np.ndarray] | None, key: str, numbers: set[int] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else bitmap()
        for batch in batches:
            for part in W.pieces(batch):
                words, at = W.hashes(part.column("text"))
                for number, found, text, place in seeds(words, at, numbers):
                    if held is not None:
                        bit = found % W.U(BITMAP_BITS)
                        some = np.flatnonzero((held[(bit >> W.U(6)).astype(np.int64)] >> (bit & W.U(63))) & W.U(1))
                        found, text, place = found[some], text[some], place[some]
                    if len(found):
                        ids = part.column(key).take(pa.array(text))
                        mask = pa.array(np.full(len(found), number, np.int32))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), pa.array(found.view(np.int64)), mask], names=[key, "place", "seed", "mask"])

    return run


def seed_hashes(texts: DataFrame, key: str, bitmap: Callable[[], np.ndarray] | None = None, numbers: set[int] | None = None) -> DataFrame:
    """(key, place, seed, mask) of (key, text)."""
    return texts.select(key, W.plain(F.col("text")).alias("text")).mapInArrow(_seed_rows(bitmap, key, numbers), f"{key} bigint, place int, seed bigint, mask int")


def seed_bitmap(tests: DataFrame) -> np.ndarray:
    """The bitmap of the seeds in ``tests``: BITMAP_BITS / 64 words, at most as many rows."""
    bit = F.pmod(F.col("seed"), F.lit(BITMAP_BITS))
    rows = tests.select((bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("bit"))
    words = np.zeros(BITMAP_BITS // 64, np.int64)
    for row in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        words[row["word"]] = row["bits"]
    return words.view(np.uint64)


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the stretch of an alignment with the highest score."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -PENALTY))])
    gain = score - np.minimum.accumulate(score)
    end = int(np.argmax(gain))
    start = int(np.argmin(score[: end + 1]))
    return start, end, int(same[start:end].sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.pieces(batch):
            words, at = W.hashes(part.column("text"))
            items, item_at = W.hashes(part.column("item_text"))
            rows = []
            for r, diagonals in enumerate(part.column("diagonals").to_pylist()):
                own, item = words[at[r] : at[r + 1]], items[item_at[r] : item_at[r + 1]]
                needed = min(MIN_MATCHES, int(np.ceil(ITEM_SHARE * len(item))))
                best = None
                for shift in sorted(diagonals):
                    first, last = max(0, -shift), min(len(item), len(own) - shift)
                    if last - first < needed:
                        continue
                    start, end, matches = best_stretch(own[first + shift : last + shift] == item[first:last])
                    if matches >= needed and (best is None or matches > best[0]):
                        best = (matches, end - start, first + start + shift, first + start, len(item))
                if best:
                    rows.append((r, *best))
            if rows:
                kept = list(zip(*rows, strict=True))
                take = pa.array(kept[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("item_id").take(take), *(pa.array(c, pa.int32()) for c in kept[1:])],
                    names=["doc_id", "item_id", "matched_words", "overlap_words", "doc_word", "item_word", "item_words"],
                )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, matched_words, overlap_words (with
    substitutions), doc_word and item_word (where it starts), item_words."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    found = _overlaps(named, benchmark)
    without = _without_id(docs)
    if without.isEmpty():
        return found
    # Equal texts overlap alike, so those without an id go by a hash of their text, each once.
    own = _overlaps(without.select(F.col("key").alias("doc_id"), "text").distinct(), benchmark)
    return found.unionByName(without.select("key").join(own.withColumnRenamed("doc_id", "key"), "key").select(F.lit(None).cast("bigint").alias("doc_id"), *own.columns[1:]))


def _without_id(docs: DataFrame) -> DataFrame:
    """(key, text) of the rows without a doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id is null").select(F.xxhash64(text).alias("key"), text.alias("text"))


def _overlaps(own: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The overlaps of (doc_id, text), where no doc_id is null."""
    spark = own.sparkSession
    ship_package(spark)
    # A table: its joins can be broadcast by size, or split where an item is in very many documents.
    # An item is a text with its item_id: several texts of one item_id are all compared.
    named = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = stage(named.withColumn("item", F.monotonically_increasing_id()), "items")
    tests = stage(seed_hashes(items, "item"), "tests")
    sent = spark.sparkContext.broadcast(seed_bitmap(tests))
    used = {row["mask"] for row in tests.select("mask").distinct().collect()}  # at most one for each of ALL_MASKS
    hits = stage(seed_hashes(own, "doc_id", lambda: sent.value, used).drop("mask"), "hits")
    joined = hits.join(tests.select("item", "seed", F.col("place").alias("item_place")), "seed")
    diagonals = joined.select("doc_id", "item", (F.col("place") - F.col("item_place")).alias("diagonal"))
    # Distinct first: within a task, the hits along one diagonal become one row before the shuffle.
    candidates = stage(diagonals.distinct().groupBy("doc_id", "item").agg(F.collect_list("diagonal").alias("diagonals")), "candidates")
    texts = own.select("doc_id", W.plain(F.col("text")).alias("text"))
    both = texts.join(candidates, "doc_id").join(items.select("item", "item_id", W.plain(F.col("text")).alias("item_text")), "item")
    found = both.select("doc_id", "item_id", "text", "item_text", "diagonals").mapInArrow(
        _verify, "doc_id bigint, item_id bigint, matched_words int, overlap_words int, doc_word int, item_word int, item_words int"
    )
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*found.columns[2:])).alias("best")).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    gone = stage(_overlaps(named, benchmark).select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    without = _without_id(docs)
    if without.isEmpty():
        return kept
    own = stage(_overlaps(without.select(F.col("key").alias("doc_id"), "text").distinct(), benchmark).select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    key = F.when(kept["doc_id"].isNull(), F.xxhash64(F.coalesce(kept["text"], F.lit(""))))
    return kept.join(own, key == own["gone"], "left_anti")
