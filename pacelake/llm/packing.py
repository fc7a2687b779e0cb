"""Packing token pieces into fixed-length sequences by linear grouping and best fit.

Documents are tokenised whole; longer ones are cut into pieces of the capacity. Piece lengths are few (at most
the capacity), so all planning works on a histogram of lengths, whatever the number of documents:

1. Pieces of full length are sequences of their own.
2. Large pieces, sorted by length, fall into groups of equal cardinality, of 8 pieces at least; each length is rounded
   up to its group's largest. Configurations of these few sizes are optimised by column generation (the linear relaxation
   of cutting stock); whole multiples are used, what is left is placed by best fit.
3. Actual pieces take the slots of their group, which frees the room that rounding had added.
4. Small pieces go, longest first, to the tightest room that still holds them; new sequences open only when
   none does.

A piece finds its slot from its rank by length: counts of small cells plus a row number in the cell. The number of
cells follows the counts, so a frequent length, or room, is spread over more of them. Null text counts as empty (one
end token). Texts that hold a token added to the vocabulary go through the tokenizer whole, as it treats these itself. Rows with equal or null ids are separate documents. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

CAPACITY, GROUPS, SMALL = 2048, 128, 128
#: Cells of each value at least, and rows of one cell on average beyond that.
CELLS, CELL_ROWS = 64, 50_000
#: Words and letter runs whose ids a worker remembers.
CACHE_WORDS, CACHE_RUNS = 400_000, 600_000
#: How the vocabulary's tokenizer splits lower-case text without white space into runs.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
#: Printable characters below U+0250, where lower case and composition hold no surprises.
PLAIN = re.compile("[\x21-\x7e\u00a1-\u012f\u0131-\u024f]*")
PLAIN_TEXT = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u024f]*")


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds:
    """Ids of whole texts as bytes, word by word, from a remembered dictionary.

    The tokenizer lower-cases, splits words into runs and merges within a run only, so a word's ids don't depend on
    its neighbours. Plain words are split here and their runs merged by the tokenizer's model; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        added = self.whole.get_added_tokens_decoder().values()
        self.exact = [t.content for t in added if t.content and not t.normalized]
        self.folded = [t.content.lower() for t in added if t.content and t.normalized]  # looked for in normalized text
        self.merge, self.runs = self.whole.model.tokenize, regex.compile(RUNS).findall
        self.shown = _byte_characters()
        self.words: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        ids = self.known.get(run)
        if ids is None:
            text = run if run.isascii() else "".join([self.shown[b] for b in run.encode()])
            ids = self.known[run] = array("I", [t.id for t in self.merge(text)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            low = word.lower()
            if low.isascii() and low[:-1].isalpha():  # letters, with one mark at the end at most
                ids = self._run(low) if low[-1].isalpha() else self._run(low[:-1]) + self._run(low[-1])
            else:
                ids = b"".join([self._run(r) for r in self.runs(low)])
        else:
            ids = np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        self.words[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.exact) or self.folded and any(x in text.lower() for x in self.folded):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        if len(self.known) > CACHE_RUNS:
            self.known = {}
        if text.isascii() or PLAIN_TEXT.fullmatch(text):
            text = text.lower()
        words, get = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), self.words.get
        out = [get(w) for w in words]
        if None in out:
            out = [self._word(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]
        return b"".join(out)


@lru_cache(1)
def _word_ids(tokenizer: str) -> WordIds:
    """One dictionary a worker, kept from task to task."""
    return WordIds(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32). `tokenizer` is the path of a tokenizer that treats words between white space apart."""

    def run(batches):
        ids_of = _word_ids(tokenizer).of
        end, width = np.uint32(end_id).tobytes(), 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = defaultdict(list)
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = ids_of(text) + end
                    for k, start in enumerate(range(0, len(ids), width)):
                        body = ids[start : start + width]
                        for name, x in zip(("row", "piece", "start", "length", "ids_crc32"), (row, k, start // 4, len(body) // 4, zlib.crc32(body)), strict=True):
                            out[name].append(x)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()), **{k: pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")}})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to put in one sequence for the greatest worth."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, (s, y) in enumerate(zip(sizes, worth, strict=True)):
        if y <= 0:
            continue
        for at in range(s, capacity + 1, s):
            end = min(at + s, capacity + 1)
            new = value[at - s : end - s] + y
            better = new > value[at:end] + 1e-12
            value[at:end] = np.where(better, new, value[at:end])
            last[at:end] = np.where(better, i, last[at:end])
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        out[last[c]] += 1
        c -= sizes[last[c]]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, gain: float = 1e-3, steps: int = 10) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) that cover `demand` exactly: column generation until a new
    configuration would gain less than `gain` of a sequence (or `steps` rounds a size), rounded down, the rest by best fit."""
    m, need = len(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(steps * m):
        worth = inverse.sum(0)
        column = _best_pattern(sizes, worth, capacity)
        if worth @ column <= 1 + gain:
            break
        x, d = inverse @ need, inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        k = int(np.argmin(ratio))
        basis[:, k] = column
        pivot = inverse[k] / d[k]
        inverse -= np.outer(d, pivot)  # the inverse follows the exchanged column
        inverse[k] = pivot
    times = np.floor(np.linalg.solve(basis, need) + 1e-9).clip(0).astype(np.int64)
    out, left = [], np.array(demand, np.int64)
    for k in range(m):
        column = basis[:, k].astype(np.int64)
        t = int(min(times[k], *(left[i] // column[i] for i in np.flatnonzero(column)))) if column.any() else 0
        if t:
            out.append((t, column))
            left -= t * column
    rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
    rest: list[np.ndarray] = []
    for i in np.argsort([-s for s in sizes], kind="stable"):
        for _ in range(int(left[i])):
            at = bisect.bisect_left(rooms, (sizes[i], -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
            else:
                room, k = capacity, len(rest)
                rest.append(np.zeros(m, np.int64))
            rest[k][i] += 1
            bisect.insort(rooms, (room - sizes[i], k))
    return out + [(1, r) for r in rest]


class LargePlan:
    """Slots of large pieces by rank: rank 0 is the longest piece."""

    def __init__(self, counts: np.ndarray, small: int, groups: int):
        capacity = len(counts) - 1
        full = int(counts[capacity])
        lengths = np.arange(capacity - 1, small, -1)
        ends = np.cumsum(counts[lengths])
        n = int(ends[-1]) if len(ends) else 0
        groups = min(groups, max(1, n // 8))  # smaller groups gain nothing
        bounds = np.unique([g * n // groups for g in range(groups)])
        rounded = lengths[np.searchsorted(ends, bounds, side="right")] if n else np.zeros(0, int)
        first = np.append(True, rounded[1:] != rounded[:-1]) if n else np.zeros(0, bool)
        bounds, rounded = (bounds[first], rounded[first]) if n else (np.zeros(0, np.int64), rounded)
        demand = np.diff(np.append(bounds, n)) if n else np.zeros(0, int)
        used = configurations([int(s) for s in rounded], [int(d) for d in demand], capacity) if n else []
        rows, sequence, taken = [], full, np.zeros(len(rounded), np.int64)
        for times, column in used:
            for g in np.flatnonzero(column):
                rows.append((full + bounds[g] + taken[g], column[g], sequence))
                taken[g] += times * column[g]
            sequence += times
        rows.sort()
        self.full, self.end, self.sequences = full, full + n, sequence
        self.start, self.each, self.base = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3

    def sequence_of(self, rank: np.ndarray) -> np.ndarray:
        out = rank.copy()  # full pieces: one each
        big = rank >= self.full
        k = np.searchsorted(self.start, rank[big], side="right") - 1
        out[big] = self.base[k] + (rank[big] - self.start[k]) // self.each[k]
        return out


class SmallPlan:
    """Best fit of small lengths into rooms, all told by counts: a slot is (room it started with, which of these sequences)."""

    def __init__(self, rooms: dict[int, int], counts: np.ndarray, small: int):
        capacity = len(counts) - 1
        open_rooms: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now -> (room at start, first, number)
        for room, n in rooms.items():
            open_rooms[room].append((room, 0, n))
        order, fresh, rows = sorted(open_rooms), 0, []
        for s in range(small, 0, -1):
            left, slot = int(counts[s]), 0
            while left:
                at = bisect.bisect_left(order, s)
                if at == len(order):
                    n = -(-left // (capacity // s))
                    self._put(open_rooms, order, capacity, (-1, fresh, n))
                    fresh += n
                    continue
                room = order[at]
                origin, first, n = open_rooms[room].pop()
                if not open_rooms[room]:
                    order.pop(at)
                each = room // s
                q = min(n, left // each)
                if q:
                    rows.append((s, slot, each, origin, first))
                    slot, left = slot + q * each, left - q * each
                    self._put(open_rooms, order, room - each * s, (origin, first, q))
                elif left:
                    rows.append((s, slot, left, origin, first))
                    self._put(open_rooms, order, room - left * s, (origin, first, 1))
                    slot, left, q = slot + left, 0, 1
                if n > q:
                    self._put(open_rooms, order, room, (origin, first + q, n - q))
        rows.sort()
        self.new = fresh
        self.key = np.array([(r[0] << 48) + r[1] for r in rows], np.int64)
        self.slot, self.each, self.origin, self.first = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))

    @staticmethod
    def _put(open_rooms, order, room, entry):
        if room > 0:
            if not open_rooms[room]:
                bisect.insort(order, room)
            open_rooms[room].append(entry)

    def place_of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.origin[k], self.first[k] + (rank - self.slot[k]) // self.each[k]


def _ranked(df: DataFrame, value: str, most: int, order: list) -> DataFrame:
    """`df` with `_rank`, the place of each row among those of its value, of which none has more than `most` rows: cell counts before
    it and a row number in its cell."""
    cells = CELLS << (int(most) // (CELLS * CELL_ROWS)).bit_length()
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = df.groupBy(F.col(value).alias("_v"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_v").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_v", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = df.join(counts, (F.col(value) == F.col("_v")) & (F.col("_bucket") == F.col("_b")))
    place = F.row_number().over(Window.partitionBy("_v", "_b").orderBy(*order))
    return out.withColumn("_rank", F.col("_before") + place - 1).drop("_bucket", "_v", "_b", "_before")


def _mapped(df: DataFrame, names: list[str], kinds: list[str], out: dict[str, str], f) -> DataFrame:
    """Columns of `df` as they are, and those that `f` makes from the named ones as numpy arrays."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x) for x in f(*(b.column(n).to_numpy() for n in names)))], [*b.schema.names, *out])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"{k} {t}" for k, t in out.items()]))


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """`found` (doc_id, piece, length, ...) with sequence_id and offset. The driver sees histograms of at most `capacity` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():
        counts[length] = n
    longer = counts[::-1].cumsum()[::-1] - counts  # pieces that are longer
    large = LargePlan(counts, small, groups)
    ranked = _ranked(found, "length", counts.max(), ["doc_id", "piece", "ids_crc32"])
    big = _mapped(ranked.where(F.col("length") > small), ["length", "_rank"], [], {"sequence_id": "long"}, lambda length, rank: [large.sequence_of(longer[length] + rank)]).drop("_rank")
    if not counts[1 : small + 1].any():
        return _with_offsets(big)
    big = tx.cut(big)
    room = big.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0")
    rooms = {r: n for r, n in room.groupBy("room").count().collect()}
    plan = SmallPlan(rooms, counts, small)
    tiny = _mapped(ranked.where(F.col("length") <= small), ["length", "_rank"], [], {"_room": "long", "_nth": "long"}, plan.place_of).drop("_rank")
    fresh = tiny.where("_room < 0").withColumn("sequence_id", F.col("_nth") + F.lit(large.sequences)).drop("_room", "_nth")
    places = _ranked(room, "room", max(rooms.values(), default=0), ["sequence_id"]).select(F.col("room").alias("_r"), F.col("_rank").alias("_k"), "sequence_id")
    filled = tiny.where("_room >= 0").join(places, (F.col("_room") == F.col("_r")) & (F.col("_nth") == F.col("_k"))).drop("_room", "_nth", "_r", "_k")
    return _with_offsets(big.unionByName(filled).unionByName(fresh))


def _with_offsets(df: DataFrame) -> DataFrame:
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("offset", F.sum("length").over(inside) - F.col("length"))


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(tx.cut(pieces(docs, tokenizer, doc_id, text, capacity)), capacity, groups, small)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
