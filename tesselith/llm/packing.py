"""Best-fit packing planned over the histogram of lengths.

A task turns texts into token ids and cuts them into pieces; from there only
lengths matter. The plan packs counts of equal lengths, longest first, into the
fullest sequences that still have room, and so has a number of rows that
depends on the sequence length alone (no more than PLAN_ROWS for 2,048). Each piece then takes the slot of
its rank among the pieces of its length.

Ranks need no task to see all pieces of a length: pieces are dealt into buckets
of about equal size whatever their lengths, ranked within bucket and length,
and shifted by the number of such pieces in the buckets before.

Defined results: a null or empty text is the separator alone, one piece of
length 1; only documents longer than a sequence are cut; a repeated row is
packed again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import array
import bisect
import os
import sys
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselith.session import ship_package
from tesselith.staging import stage

SEQUENCE_TOKENS = 2048
SEPARATOR = 0
#: A group's room at least halves with each slot it gets (11 times for 2,048), and a length adds at most four groups.
PLAN_ROWS = 4 * 2048 * 11
#: Words whose ids a Python worker remembers, in about 60 MB; beyond, it starts anew.
CACHE_WORDS = 300_000
BUCKET_ROWS = 4096
MAX_BUCKETS = 1 << 16

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _load(tokenizer: str | None):
    from tokenizers import Tokenizer

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(tokenizer)


#: Byte-level vocabularies write a byte that can't be printed as a character from code point 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Words that show whether a tokenizer lower-cases words and feeds their bytes straight to its model.
_PROBES = ("the", "Über", "ÇA", "straße", "wordpieces", "Aÿ", "X")


class WordIds(dict):
    """Little-endian 32-bit ids of words, for a tokenizer that works within words and drops spaces.

    Blanks and line feeds always separate words there, so a text's ids are those of its words in turn, and
    each different word is encoded once. A word of Latin-1 letters has the ids of its lower case, which the
    tokenizer's model gives by itself, and with a full stop or comma behind it those of the two in turn."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.direct = all(self.encode(w) == self.encode_letters(w.lower()) for w in _PROBES)
        self.start()

    def start(self) -> None:
        self.clear()
        self[""] = b""
        self["."], self[","] = self.encode("."), self.encode(",")

    @staticmethod
    def as_bytes(ids: list[int]) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        return self.as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode_letters(self, word: str) -> bytes:
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return self.as_bytes([t.id for t in self.model.tokenize(chars)])

    def __missing__(self, word: str) -> bytes:
        end = word[-1] if word[-1] in ".," else ""
        stem = word[:-1] if end else word
        if not (self.direct and stem.isalpha() and max(stem) <= "\xff"):
            self[word] = coded = self.encode(word)
            return coded
        low = stem.lower()
        coded = self.get(low)
        if coded is None:
            self[low] = coded = self.encode_letters(low)
        if low != word:
            self[word] = coded = coded + self[end]
        return coded

    def of(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.start()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str | None, WordIds] = {}


def _word_ids(tokenizer: str | None) -> WordIds:
    """One for each Python worker, so that tasks after the first find most words known."""
    if tokenizer not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[tokenizer] = WordIds(_load(tokenizer))
    return _loaded[tokenizer]


def _pieces(tokenizer: str | None, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(tokenizer)
        end = SEPARATOR.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple[int, int, int, int, int]] = []
                for row, text in enumerate(part.column("text").to_pylist()):
                    coded = ids.of(text) + end
                    for piece, start in enumerate(range(0, len(coded), 4 * size)):
                        own = coded[start : start + 4 * size]
                        out.append((row, piece, start // 4, len(own) // 4, zlib.crc32(own)))
                row, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, which end with the separator."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pieces(tokenizer, size), PIECES)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, low, high, sequence, offset, per): the pieces of that length with ranks low to high - 1
    go to the sequences from ``sequence`` on, ``per`` to each, one behind the other from ``offset``."""
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {size: []}  # by room: (first sequence, sequences)
    rooms: list[int] = []  # the rooms in open_ that have sequences, ascending
    made = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not open_.get(room):
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, first, count = size, made, -(-left // (size // length))
                made += count
            per = room // length
            full = min(count, left // per)
            if full:
                slots.append((length, rank, rank + full * per, first, size - room, per))
                put(room - per * length, first, full)
                left -= full * per
                rank += full * per
            if full < count and left:  # one sequence takes the few that remain
                slots.append((length, rank, rank + left, first + full, size - room, left))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, count - full)
    return slots


def pack(docs: DataFrame, size: int = SEQUENCE_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """The pieces with their places: PIECES, then sequence_id and offset."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, size, tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = cut.count()
    buckets = max(1, min(MAX_BUCKETS, -(-total // BUCKET_ROWS)))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = stage(dealt.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stage(counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts")
    within = Window.partitionBy("bucket", "length").orderBy("row")
    # Dealt by bucket alone, which the window accepts: tasks are even however uneven the lengths are.
    ranked = dealt.repartition("bucket").withColumn("within", F.row_number().over(within) - 1)
    ranked = ranked.join(shifts, ["bucket", "length"]).withColumn("rank", F.col("within") + F.col("shift"))
    slots = spark.createDataFrame(plan(histogram, size), "of bigint, low bigint, high bigint, first bigint, begin bigint, per bigint")
    place = F.col("rank") - F.col("low")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + F.floor(place / F.col("per"))).alias("sequence_id"),
        (F.col("begin") + place % F.col("per") * F.col("length")).alias("offset"),
    )
