"""Removal of long repeated byte strings, by a Burrows-Wheeler transform built column by column.

Every string of ``WINDOW`` bytes (a window) that starts at two places or more is
to be found, within a document and across documents. A transform of all texts at
once would take as many rounds as the longest text has bytes, so texts are first
cut where their content says so:

* Each window has an anchor, the ``ANCHOR`` bytes in it with the least hash (of
  equal hashes the leftmost). Consecutive windows with one anchor make a segment
  of at most 2 * WINDOW - ANCHOR bytes. Equal windows have equal anchors at equal
  distances, so they meet in the group of one anchor, aligned on it.
* Anchors that occur once are left behind; of equal segments one goes on.
* Tasks take whole groups and build the transform of their segments from the last
  column to the first: a round inserts one symbol of each segment. The order of the
  suffixes and their common prefixes with the suffix before are read from files,
  and behind them go the column's symbols in that order (the transform's column),
  and the new order and prefixes for the next round. Since only suffixes of one column can hold equal windows, a round merges
  with the suffixes of its own column and never rewrites the others. Files are
  read and written in sequence, belong to one attempt of a task, like a shuffle's
  spill, and are gone when it ends.
* A group of more than ``MOST_SEGMENTS`` different segments (a passage in very many
  contexts) is cut again, into blocks of ever fewer windows that are grouped by
  what all windows of the block have in common. With one window a block, equal
  blocks are equal windows, so no group is left.

Defined results: a null text counts as empty; texts shorter than a window lose
nothing; a repeated row is a document of its own, and so all its windows are
repeated; a removed run may cut a character, since texts are bytes here; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselith.llm import words
from tesselith.session import ship_package
from tesselith.staging import stage

WINDOW = 400
ANCHOR = 100
#: Different segments of a group that one task may hold.
MOST_SEGMENTS = 4096
#: Windows of a block at each further cut of a group that has more.
BLOCKS = (64, 16, 4, 1)
#: Bytes of segments whose transform is built at once (a group is never divided).
COLLECTION_BYTES = 4 << 20
PARTITION_BYTES = 8 << 20
#: Windows of a text whose anchors are sought at once.
PIECE_WINDOWS = 1 << 20

U = np.uint64
_PLACE = U((1 << 24) - 1)
_SEGMENT_BYTES = words.mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1B54A32D192ED03))

SEGMENTS = "row bigint, first bigint, to_anchor int, windows int, anchor bigint, segment bigint"
STRINGS = "anchor bigint, segment bigint, copies bigint, kinds bigint, column int, windows int, string binary"
BLOCK_ROWS = "anchor bigint, segment bigint, copies bigint, column int, at int, windows int, string binary, core bigint, content bigint"
FOUND = "anchor bigint, segment bigint, low int, high int"


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, size), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, size)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The segments of the texts ``data[offsets[i]:offsets[i + 1]]``: number of the text, first window, bytes from there to the anchor, windows, hashes of anchor and segment."""
    if len(data) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64))
    up, down = words._power(len(data) + 1)
    hashed = []
    for table in (words._BYTE, _SEGMENT_BYTES):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
        hashed.append(total)
    grams = len(data) - anchor + 1
    value = words.mix((hashed[0][anchor:] - hashed[0][:grams]) * down[:grams])
    least = _sliding_least((value & ~_PLACE) | np.arange(grams, dtype=np.uint64), window - anchor + 1)
    place = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - window + 1, 0))
    counts = np.bincount(text, minlength=len(offsets) - 1)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[text]
    place = place[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(start)))
    first, end = start[at], start[at] + size + window - 1
    own = words.mix((hashed[1][end] - hashed[1][first]) * down[first] + size.astype(np.uint64))
    return text[at], first - offsets[text[at]], (place[at] - first).astype(np.int32), size.astype(np.int32), value[place[at]].view(np.int64), own.view(np.int64)


def _segment_rows(window: int, anchor: int) -> Callable:
    def rows(of: pa.Array, data: np.ndarray, offsets: np.ndarray, shift: int = 0) -> pa.RecordBatch:
        text, first, *rest = segments(data, offsets, window, anchor)
        return pa.RecordBatch.from_arrays([of.take(pa.array(text)), *map(pa.array, (first + shift, *rest))], names=["row", "first", "to_anchor", "windows", "anchor", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.pieces(batch):
                of = piece.column("row")
                data, offsets = words.buffers(piece.column("text"))
                if piece.num_rows > 1 or len(data) < PIECE_WINDOWS + window:
                    yield rows(of, data, offsets)
                    continue
                for low in range(0, len(data) - window + 1, PIECE_WINDOWS):  # one very long text
                    part = data[low : low + PIECE_WINDOWS + window - 1]
                    yield rows(of, part, np.array([0, len(part)]), low)

    return run


def _cut_strings(window: int) -> Callable:
    """Texts with the segments wanted from each, to rows of STRINGS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in words.pieces(whole):
                data, offsets = words.buffers(batch.column("text"))
                wanted = batch.column("wanted")
                text = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(wanted)))
                item = wanted.flatten()
                first, to_anchor, windows = (np.asarray(item.field(k)) for k in ("first", "to_anchor", "windows"))
                begin = offsets[text] + first
                strings = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + windows + window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [item.field("anchor"), item.field("segment"), item.field("copies"), item.field("kinds"), pa.array(-to_anchor.astype(np.int32)), item.field("windows"), pa.array(strings, pa.binary())],
                    names=["anchor", "segment", "copies", "kinds", "column", "windows", "string"],
                )

    return run


def columns(strings: list[bytes], left: np.ndarray, group: np.ndarray, folder: Path) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Build the transform: for each column from the last, (column, order, common), where ``order`` has the strings that reach the
    column by group and suffix from there, and ``common`` the length of the prefix each shares with the one before.

    String i covers the columns from ``left[i]`` on; ``group`` ascends. Of the files in ``folder``, ``symbols`` has the texts by
    column, the others what each round has put behind the rounds before: ``order`` and ``common``, and in ``transform`` the
    symbols before the sorted suffixes of the column. A suffix that ends is less than any that goes on, and shares no end with another."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    right = left + length
    low, high = int(left.min()), int(right.max())
    table = np.zeros((high - low, len(strings)), np.uint8)
    data = np.frombuffer(b"".join(strings), np.uint8)
    of = np.repeat(np.arange(len(strings)), length)
    table[np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length) + (left - low)[of], of] = data
    table[::-1].tofile(folder / "symbols")
    del table, data, of
    group = group.astype(np.uint16)
    begins = np.argsort(-right, kind="stable")
    begun = np.searchsorted(-right[begins], -np.arange(high, low, -1), "right")
    opened = lambda name, mode="w+b": (folder / name).open(mode, buffering=1 << 16)
    with opened("symbols", "rb") as symbols, opened("transform") as transform, opened("order") as orders, opened("common") as prefixes:
        rows, before_orders, before_prefixes = 0, 0, 0
        for k, column in enumerate(range(high - 1, low - 1, -1)):
            orders.seek(before_orders)
            prefixes.seek(before_prefixes)
            order, common = np.frombuffer(orders.read(4 * rows), np.int32), np.frombuffer(prefixes.read(2 * rows), np.int16)
            fresh = np.sort(begins[begun[k - 1] if k else 0 : begun[k]]).astype(np.int32)
            if len(fresh):  # their suffixes are empty so far and come first in their groups
                order, common = np.concatenate([fresh, order]), np.concatenate([np.zeros(len(fresh), np.int16), common])
                by_group = np.argsort(group[order], kind="stable")
                order, common = order[by_group], common[by_group]
            symbol = np.frombuffer(symbols.read(len(strings)), np.uint8)[order]
            live = np.flatnonzero(left[order] <= column)
            transform.write(symbol[live].tobytes())
            live = live[np.argsort(symbol[live], kind="stable")]
            place = live[np.argsort(group[order[live]], kind="stable")]
            longer = np.zeros(len(place), np.int16)
            before, here = place[:-1], place[1:]
            alike = np.flatnonzero((symbol[before] == symbol[here]) & (group[order[before]] == group[order[here]]))
            if len(alike):  # the least common prefix on the way from one to the other, and the new symbol
                ways = np.stack([before[alike] + 1, here[alike] + 1], axis=1).ravel()
                longer[alike + 1] = np.minimum.reduceat(np.append(common, np.int16(0)), ways)[::2] + 1
            order = order[place]
            rows, before_orders, before_prefixes = len(order), orders.tell(), prefixes.tell()
            orders.write(order.tobytes())
            prefixes.write(longer.tobytes())
            yield column, order, longer


def repeated_windows(strings: list[bytes], left: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Of each string, which windows (by their number in it) another string of its group has at the same column."""
    marks = np.zeros((len(strings), max(map(len, strings)) - window + 1), bool)
    with tempfile.TemporaryDirectory(prefix="columns-") as folder:
        for column, order, common in columns(strings, left, group, Path(folder)):
            pairs = np.flatnonzero(common >= window)
            for own in (order[pairs], order[pairs - 1]):
                marks[own, column - left[own]] = True
    return marks


def _transform(window: int) -> Callable:
    """Strings, sorted by group, to rows of FOUND; groups are taken together up to COLLECTION_BYTES."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        group, anchor, segment, column, at, strings = zip(*rows, strict=True)
        changed = np.diff(np.array(group), prepend=group[0]) != 0
        marks = repeated_windows(list(strings), np.array(column, np.int64), np.cumsum(changed), window)
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        own, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1]
        at = np.array(at)[own]
        out = (np.array(anchor)[own], np.array(segment)[own], (at + low).astype(np.int32), (at + high).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["anchor", "segment", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("grouped", "anchor", "segment", "column", "at", "string")), strict=True):
                if size >= COLLECTION_BYTES and row[0] != rows[-1][0]:
                    yield found(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-1])
        if rows:
            yield found(rows)

    return run


def _cut_blocks(window: int, size: int) -> Callable:
    """Strings to blocks of ``size`` windows or what there is of them. ``core`` tells what all windows of a whole block have in common, and its place."""

    def digest(data: bytes, *place: int) -> int:
        return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=struct.pack(f"{len(place)}q", *place)).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, segment, copies, column, at, windows, string in zip(*(batch.column(k).to_pylist() for k in BLOCK_COLUMNS), strict=True):
                for block in range(column // size, (column + windows - 1) // size + 1):
                    low, high = max(column, block * size), min(column + windows, (block + 1) * size)
                    core = string[block * size + size - 1 - column : block * size + window - column]
                    own = string[low - column : high - column + window - 1]
                    out.append((anchor, segment, copies, low, at + low - column, high - low, own, digest(core, anchor, block), digest(own, anchor, low)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), BLOCK_TYPES, strict=True)], names=[*BLOCK_COLUMNS, "core", "content"])

    return run


BLOCK_COLUMNS = ("anchor", "segment", "copies", "column", "at", "windows", "string")
BLOCK_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())


def _built(strings: DataFrame, grouped: str, window: int) -> DataFrame:
    """FOUND for the windows that strings of one group share, by their transform."""
    spark = strings.sparkSession
    total = strings.agg(F.sum(F.length("string"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))
    rows = strings.select(F.col(grouped).alias("grouped"), "anchor", "segment", "column", "at", "string")
    return rows.repartition(tasks, "grouped").sortWithinPartitions("grouped").mapInArrow(_transform(window), FOUND)


def _with_others(kinds: DataFrame, group: str) -> DataFrame:
    """The rows of ``kinds`` whose group has others, and how many it has, ``kinds``. The counts are a table, so that the rows of a large group can be divided."""
    counts = stage(kinds.groupBy(group).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "counts")
    return kinds.join(counts, group)


def _found_in_large_groups(strings: DataFrame, window: int, most: int) -> list[DataFrame]:
    """FOUND for groups that no task should hold: cut into blocks until all groups are small."""
    found = []
    for size in (b for b in BLOCKS if b <= window // 2):
        blocks = stage(strings.select(*BLOCK_COLUMNS).mapInArrow(_cut_blocks(window, size), BLOCK_ROWS), "blocks")
        kinds = stage(blocks.groupBy("core", "content").agg(F.sum("copies").alias("all_copies"), F.min(F.struct("segment", "at")).alias("chosen")), "contents")
        found.append(blocks.join(kinds.where("all_copies > 1"), ["core", "content"]).select("anchor", "segment", F.col("at").alias("low"), (F.col("at") + F.col("windows")).alias("high")))
        chosen = blocks.drop("copies").join(_with_others(kinds, "core"), ["core", "content"])
        chosen = stage(chosen.where((F.col("segment") == F.col("chosen.segment")) & (F.col("at") == F.col("chosen.at"))).withColumnRenamed("all_copies", "copies").drop("chosen"), "chosen")
        found.append(_built(chosen.where(F.col("kinds") <= most), "core", window))
        strings = chosen.where(F.col("kinds") > most)
        if strings.isEmpty():
            break
    return found


def _merge(window: int) -> Callable:
    """(row, found) with ranges of repeated windows, to (row, removed): the runs of bytes that these cover, in order."""
    runs_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = []
            for found in batch.column("found"):
                low, high = (np.asarray(found.values.field(k)) for k in ("low", "high"))
                by_low = np.argsort(low)
                low, high = low[by_low], np.maximum.accumulate(high[by_low]) + window - 1
                opens = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                removed.append([{"low": a, "high": b} for a, b in zip(low[opens].tolist(), high[np.append(opens[1:], len(low)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, runs_type)], names=["row", "removed"])

    return run


def without(data: Column, removed: Column) -> Column:
    """The bytes that aren't in the runs. Pieces are joined as strings of one character a byte, and not one by one."""
    ends = F.transform(removed, lambda run: run["high"])
    starts = F.concat(F.array(F.lit(0).cast("bigint")), ends)
    stops = F.concat(F.transform(removed, lambda run: run["low"]), F.array(F.length(data).cast("bigint")))
    piece = lambda p: F.decode(F.substring(data, (p["starts"] + 1).cast("int"), (p["stops"] - p["starts"]).cast("int")), "ISO-8859-1")
    joined = F.array_join(F.transform(F.arrays_zip(starts.alias("starts"), stops.alias("stops")), piece), "")
    return F.when(F.size(removed) == 0, data).otherwise(F.encode(joined, "ISO-8859-1"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST_SEGMENTS) -> DataFrame:
    """For each row of ``docs``: doc_id, bytes (of the text), removed (runs of bytes from low to high - 1) and kept (the bytes that stay)."""
    ship_package(docs.sparkSession)
    texts = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), "texts")
    rows = stage(texts.where(F.octet_length("text") >= window).select("row", "text").mapInArrow(_segment_rows(window, anchor), SEGMENTS), "segments")
    # A table: a join of two tables is one whose large keys can be divided.
    again = stage(rows.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
    rows = stage(rows.join(again, "anchor"), "shared_anchors")
    kinds = stage(rows.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "to_anchor", "windows")).alias("chosen")), "contents")
    wanted = _with_others(kinds, "anchor").select("chosen.row", F.struct("anchor", "segment", "copies", "kinds", "chosen.first", "chosen.to_anchor", "chosen.windows").alias("one"))
    # One row's segments are a part of its text.
    wanted = wanted.groupBy("row").agg(F.collect_list("one").alias("wanted"))
    strings = stage(texts.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_cut_strings(window), STRINGS).withColumn("at", F.lit(0)), "strings")
    found = [
        kinds.where("copies > 1").select("anchor", "segment", F.lit(0).alias("low"), F.col("chosen.windows").alias("high")),
        _built(strings.where(F.col("kinds") <= most), "anchor", window),
    ]
    large = strings.where(F.col("kinds") > most)
    if not large.isEmpty():
        found += _found_in_large_groups(large, window, most)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = stage(every, "found")
    places = rows.join(every, ["anchor", "segment"]).select("row", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    # One row's ranges are a part of its text.
    runs = places.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("found")).mapInArrow(_merge(window), "row bigint, removed array<struct<low:bigint,high:bigint>>")
    none = F.expr("cast(array() as array<struct<low:bigint,high:bigint>>)")
    whole = texts.join(runs, "row", "left").select("doc_id", F.col("text").cast("binary").alias("bytes"), F.coalesce("removed", none).alias("removed"))
    return whole.withColumn("kept", without(F.col("bytes"), F.col("removed")))
