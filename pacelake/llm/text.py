"""Vectorised text helpers: whole Arrow columns of UTF-8 become numpy tables of words and lines.

`range_hashes` tells ranges apart by sums of mixed words of eight bytes; nothing is known to collide in it, and a seed
makes it another function. `Hashes` are polynomials modulo 2^64 over mixed byte values, taken from prefix sums, so
the hash of any range costs two lookups; texts are known that collide in these, so they only choose or sort, and
whoever uses them compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_folder  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step handles, unless a single document is longer.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche step: each input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * STEP_BYTES:
            _powers[base] = have
    return have[:n]


class Hashes:
    """Hashes of byte ranges of one block of text."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power(_BASE, n), out=self.sums[1:])
        self.back = _power(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of all ranges of `size` bytes, by their start."""
        raw = (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]
        return mix(raw + np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: words of eight bytes (the last one filled up with zeros) are mixed with a key of their place and summed."""
    words = (ends - starts + 7) // 8
    first = np.cumsum(words) - words
    place = np.arange(int(words.sum())) - np.repeat(first, words)
    at = np.repeat(starts, words) + 8 * place
    padded = np.append(data, np.zeros(8, np.uint8))
    value = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[at]
    left = np.repeat(ends, words) - at
    value = value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - left.clip(max=8))).astype(np.uint64))
    key = mix((place + 1).astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    total = np.append(np.uint64(0), np.cumsum(mix(mix(value ^ key) + key)))
    return mix(total[first + words] - total[first] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether the `size` bytes from each place of `a` are those from the place of `b`; about `step` bytes at once."""
    same, ends = np.ones(len(a), bool), np.cumsum(size)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, step):
        i, j = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, lo + step, side="left") + 1
        i, j = int(i), min(int(j), len(a))
        before = ends[i:j] - size[i:j]
        x, y = np.maximum(lo - before, 0), np.minimum(lo + step - before, size[i:j])
        n = y - x
        row = np.repeat(np.arange(i, j), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x, n)
        same[row[data[a[row] + inside] != data[b[row] + inside]]] = False
    return same


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each range, equal only for equal bytes, and how many there are; ranges don't overlap and stand in order."""
    size = ends - starts
    cover = np.zeros(len(data) + 1, np.int8)
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    body = np.ascontiguousarray(data[np.cumsum(cover[:-1], dtype=np.int8) > 0])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(body)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, null as empty, and where each text starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(column, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `step` bytes: first row, end row, bytes, starts within them."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; no word crosses from one text to the next."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, rows_of(at, starts)


def rows_of(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, positions, side="right") - 1


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of per-byte values in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet into a new shared folder, and read from there: later passes read only the columns they need."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> "F.Column":
    """Documents whose crc32 of the id as text leaves 2 modulo 4 are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for a checkpointed table at `rows` rows each: as many as the cluster runs at once at least, as the session's shuffles have at most."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)))
