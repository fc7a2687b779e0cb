"""Packing documents into windows as they come, by the sum of squares of fill levels.

A task reads its documents once, in the order in which they are stored. A level array counts its open windows by the
tokens they hold. A document goes to the level (or a new window) for which the sum of the squared counts of partly
filled windows is smallest afterwards; ties go to the fullest. So no level piles up, and windows that fit what is still to
come stay at hand. Full windows are written out at once; documents of a window or more give full windows of their own first.

Documents are cut in two cases only: when they are longer than a window, and when a task is at its end (or has
`max_open` open windows, which bounds its memory whatever the lengths). Then the fullest windows are topped up with
pieces of the emptiest, cut where they must be, and the one window that is left is cut into windows of powers of two, from
`least` tokens on; these need no padding. What is under `least` tokens is the only window of a task that is padded.

Nothing is shuffled, and a lost task gives the same rows again, as its files do not change; sequence ids hold the number
of the task and of the window in it. Null text counts as empty (one end token). Rows with equal or null ids are
separate documents. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _word_ids

CAPACITY, END_ID = 4096, 2
#: Open windows of one task at most (16 KB each), and the shortest window that is cut off at its end.
MAX_OPEN, LEAST = 4096, 16

#: A piece: (document, first token, ids as bytes, tokens of its document).
Piece = tuple[int, int, bytes, int]


class Levels:
    """Open windows by fill level, and the choice among them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def best(self, size: int) -> int:
        """The level (0: a new window) at which `size` more tokens leave the smallest sum of squares; ties to the fullest.

        A window that moves from h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2, one that is filled by 1 - 2 N[h],
        a new one by 2 N[size] + 1.
        """
        top = self.capacity - size
        change = np.empty(top + 1, np.int64)
        change[:top] = 2 * (self.count[size : self.capacity] - self.count[:top]) + 2
        change[top] = 1 - 2 * self.count[top]
        change[1:][self.count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.count[size] + 1 if top else 0
        return top - int(np.argmin(change[::-1]))

    def put(self, piece: Piece) -> list[Piece] | None:
        """Places a piece; returns the window if that has filled it."""
        size = len(piece[2]) // 4
        at = self.best(size)
        window = self.take(at) if at else []
        window.append(piece)
        if at + size == self.capacity:
            return window
        self.windows.setdefault(at + size, []).append(window)
        self.count[at + size] += 1
        self.open += 1
        return None

    def take(self, level: int) -> list[Piece]:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def drain(self) -> list[list[Piece]]:
        """All open windows, fullest first."""
        return [self.take(level) for level in np.flatnonzero(self.count)[::-1] for _ in range(int(self.count[level]))]


def _split(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * tokens], total), (doc, start + tokens, ids[4 * tokens :], total)


def _fill(rest: list[Piece], tokens: int) -> list[Piece]:
    """Takes `tokens` tokens off the end of `rest`, a piece cut where it must be."""
    out: list[Piece] = []
    while tokens:
        piece = rest.pop()
        size = len(piece[2]) // 4
        if size > tokens:
            piece, after = _split(piece, tokens)
            rest.append(after)
            size = tokens
        out.append(piece)
        tokens -= size
    return out


def finish(windows: list[list[Piece]], capacity: int, least: int = LEAST) -> Iterator[list[Piece]]:
    """Open windows, fullest first, as full ones, then windows of powers of two, then what is under `least` tokens."""
    held = lambda w: sum(len(p[2]) for p in w) // 4
    total, first, last = sum(map(held, windows)), 0, len(windows) - 1
    rest: list[Piece] = []  # pieces of the emptiest windows
    free = 0
    for _ in range(total // capacity):
        window = windows[first] if first <= last else []
        first += 1
        room = capacity - held(window)
        while free < room:
            rest += windows[last]
            free += held(windows[last])
            last -= 1
        free -= room
        yield window + _fill(rest, room)
    for window in windows[first : last + 1]:
        rest += window
    left = total % capacity
    size = capacity
    while left >= least and size > 1:
        size //= 2
        if left & size and size >= least:
            yield _fill(rest, size)
            left -= size
    if left:
        yield _fill(rest, left)


def windows_of(documents: Iterator[tuple[int, bytes]], capacity: int, max_open: int = MAX_OPEN, least: int = LEAST) -> Iterator[list[Piece]]:
    """Windows of (document, ids) pairs that come one by one."""
    levels, width = Levels(capacity), 4 * capacity
    for doc, ids in documents:
        total = len(ids) // 4
        whole = total // capacity * width
        for start in range(0, whole, width):
            yield [(doc, start // 4, ids[start : start + width], total)]
        if whole < len(ids):
            full = levels.put((doc, whole // 4, ids[whole:], total))
            if full:
                yield full
            elif levels.open >= max_open:
                yield from finish(levels.drain(), capacity, least)
    yield from finish(levels.drain(), capacity, least)


_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_online(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, max_open: int = MAX_OPEN, least: int = LEAST) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `capacity` is a power of two."""

    def run(batches):
        ids_of, end = _word_ids(tokenizer).of, np.uint32(end_id).tobytes()

        def documents():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        yield doc, ids_of(body) + end

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in _COLUMNS], list(_COLUMNS))

        base, out = TaskContext.get().partitionId() << 36, {c: [] for c in _COLUMNS}
        for k, window in enumerate(windows_of(documents(), capacity, max_open, least)):
            offset = 0
            for doc, start, ids, total in window:
                for name, x in zip(_COLUMNS, (doc, start, len(ids) // 4, zlib.crc32(ids), total, base + k, offset), strict=True):
                    out[name].append(x)
                offset += len(ids) // 4
            if len(out["doc_id"]) >= 8192:
                yield emit()
                out = {c: [] for c in _COLUMNS}
        yield emit()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))


def op11_online_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_online(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_online_packing": op11_online_packing}
ORACLES: dict[str, str] = {}
