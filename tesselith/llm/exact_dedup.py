"""Exact deduplication by two passes over a Bloom filter, DataFrame functions only.

Pass one counts, per bit of a blocked Bloom filter, how many rows set it, and
keeps the bits that two or more rows set. Pass two probes the filter: a row
whose bits were not all set twice is the only one with its text and passes
straight through. Only the rest, the possibly repeated rows, is shuffled by
digest, where the decision is exact.

Defined results: a null text counts as empty; empty texts are equal to each
other; of equal texts the row with the largest doc_id stays, and where that row
itself is repeated, one of its copies; an empty table gives an empty result;
further columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.staging import stage

#: Bits of the filter per row, while the filter is below its largest size.
BITS_PER_ROW = 16
#: The filter never has more 64-bit words than this (64 MB of rows), so that it can be
#: broadcast. Beyond about 2**26 rows it fills up and more rows take the exact path.
MAX_WORDS = 1 << 22


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def filter_words(rows: int) -> int:
    """Words of the filter for so many rows: a power of two within the bound."""
    words = 64
    while words * 64 < rows * BITS_PER_ROW and words < MAX_WORDS:
        words *= 2
    return words


def word_and_bits(digest_col: Column, words: int) -> tuple[Column, Column]:
    """The word of a digest, and the two bits (as positions) that it sets there."""
    word = F.conv(F.substring(digest_col, 1, 12), 16, 10).cast("bigint") % words
    first = F.conv(F.substring(digest_col, 13, 4), 16, 10).cast("int") % 64
    step = 1 + F.conv(F.substring(digest_col, 17, 4), 16, 10).cast("int") % 63
    return word, F.array(first, (first + step) % 64)


def one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def repeated_bits(digests: DataFrame, words: int) -> DataFrame:
    """Pass one: (word, bits) with the bits that at least two rows set.

    The counts are summed within each task before the shuffle, so a text that a
    third of all rows share sends one row per task."""
    word, bits = word_and_bits(F.col("digest"), words)
    return (
        digests.select(word.alias("word"), F.explode(bits).alias("bit"))
        .groupBy("word", "bit")
        .count()
        .where("count > 1")
        .groupBy("word")
        .agg(F.bit_or(one_bit(F.col("bit"))).alias("bits"))
    )


def probe(rows: DataFrame, bits: DataFrame, words: int) -> DataFrame:
    """Pass two: adds ``maybe_repeated``; never false for a row with an equal."""
    word, own = word_and_bits(F.col("digest"), words)
    mask = one_bit(own[0]).bitwiseOR(one_bit(own[1]))
    probed = rows.withColumns({"word": word, "mask": mask}).join(F.broadcast(bits), "word", "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return probed.withColumn("maybe_repeated", hit).drop("word", "mask", "bits")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = stage(
        docs.select("doc_id", digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    words = filter_words(digests.count())
    bits = stage(repeated_bits(digests, words), "repeated_bits")
    probed = probe(digests, bits, words)
    single = probed.where(~F.col("maybe_repeated"))
    maybe = stage(probed.where("maybe_repeated").drop("maybe_repeated"), "maybe_repeated")
    groups = stage(
        maybe.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    # Both sides are tables, so adaptive execution may split a digest that very many rows have.
    decided = maybe.join(groups, "digest").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    passed = single.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    return passed.unionByName(decided)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all its columns; texts that are surely single aren't shuffled."""
    rows = docs.select(F.struct("*").alias("doc"), digest(F.col("text")).alias("digest"))
    digests = stage(docs.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
    words = filter_words(digests.count())
    bits = stage(repeated_bits(digests, words), "repeated_bits")
    keep = stage(
        probe(digests, bits, words)
        .where("maybe_repeated")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")),
        "keep",
    )
    probed = probe(rows, bits, words)
    single = probed.where(~F.col("maybe_repeated"))
    kept = (
        probed.where("maybe_repeated")
        .withColumn("keep_id", F.col("doc.doc_id"))
        .join(keep.withColumnRenamed("digest", "of").select("of", F.col("keep_id").alias("stays")), (F.col("digest") == F.col("of")) & F.col("keep_id").eqNullSafe(F.col("stays")), "left_semi")
        .groupBy("digest")
        .agg(F.first("doc").alias("doc"))
    )
    return single.select("doc.*").unionByName(kept.select("doc.*"))
