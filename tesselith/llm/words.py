"""Words and word hashes of whole Arrow columns at once, for use inside tasks.

A word is a maximal run of letters, digits, underscores and marks of any script,
and each Chinese or Japanese character is a word of its own. ``plain`` brings
texts into lower case and puts blanks in the place of other characters and around
ideographs, so that within tasks all bytes from 128 on belong to words. Whole texts
are read, in pieces of a bounded number of bytes so that the temporary arrays
stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once (one longer text is one piece).
PIECE_BYTES = 1 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def plain(text: Column) -> Column:
    """The text in lower case, its characters beyond ASCII as words have them."""
    lower = F.lower(text)
    blank = F.regexp_replace(lower, r"[^\x00-\x7F\p{L}\p{N}\p{M}]", " ")
    apart = F.regexp_replace(blank, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}])", " $1 ")
    return F.when(lower.rlike(r"[^\x00-\x7F]"), apart).otherwise(lower)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 in and out."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        n = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about PIECE_BYTES of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text starts and ends in them (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and for each text the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[data]
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~inside[:-1]
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:n])
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)] - 1
    last[cut] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it (one more at the end)."""
    data, offsets = buffers(column)
    starts, ends, at = bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), at


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within each text, and their places like ``at``.

    A text of fewer words has one shingle of all of them; one without words has none."""
    lengths = np.diff(at)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    place = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(place[-1], np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled += words[k : len(words) - size + 1 + k] * factors[k]
        full = np.repeat(lengths >= size, counts)
        first = np.repeat(at[:-1] - place[:-1], counts) + np.arange(place[-1])
        out[full] = rolled[first[full]]
    for d in np.flatnonzero((lengths > 0) & (lengths < size)):
        own = words[at[d] : at[d + 1]]
        out[place[d]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + U(len(own))
    return mix(out), place
