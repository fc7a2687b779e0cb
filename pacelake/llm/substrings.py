"""Exact substring dedup over a corpus with suffix arrays.

Every byte that lies in a string of `length` bytes which also starts in a document with a smaller id is removed.

1. Documents are packed into blocks of about a megabyte, compressed, so text moves little.
2. Each window of `length` bytes has an anchor, the least hash of its `PIECE`-byte pieces; neighbouring windows share
   it in a run. Equal windows have equal anchors, so only runs whose anchor occurs in two documents matter.
   Blocks send the anchors they hold, once each, and learn which of them occur again.
3. The text of such runs goes, once a block, to the shard of its anchor. Run texts are told apart by their bytes;
   hashes only bring equal ones together. Where an anchor has one text only, all its windows belong to the smallest id
   with that text. The other texts are searched with suffix arrays, one for each part of a shard of `PART_BYTES`
   (Larsson-Sadakane refinement) and common prefixes after Kasai; parts are merged by binary search into one sorted
   table of windows, kept as positions, with the smallest id that holds each.
4. Blocks get back, for each place of a run text, the stretches that smaller ids cover, and remove them.

An anchor that more than `hot` blocks hold, or whose runs have more than `hot_bytes` bytes (blanks or dashes of any length
are one run), would bring all its texts to one shard. Its runs are sent window by window
instead, to the shard of the window's own hash, so they spread over all shards; a hot window costs an entry a block.

Matches never cross documents. Null texts are empty; rows without id neither lose text nor take it from others; rows
with equal ids don't count against each other; texts shorter than `length` stay. An empty table gives an empty
result; extra columns are ignored. The blocks are kept in a bucketed table, whose files lie in the shared folder, while this
runs; the result is written to the checkpoint folder and the table and its files dropped, also when a step fails.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

LENGTH, PIECE = 50, 24
BLOCK_BYTES, PART_BYTES = 1 << 20, 2 << 20
#: Anchors that one shard takes, by which the number of shards follows the corpus.
SHARD_ANCHORS = 400_000
#: Bits of an anchor that are sent, besides those that name its shard.
SENT_BITS = 40
#: Blocks that may hold an anchor, and bytes its runs may have, before they are sent by window; bytes in one block from which they are told.
HOT_BLOCKS, HOT_BYTES, TOLD_BYTES = 5_000, 32 << 20, 2_048


# ---- suffix arrays ---------------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least: ranks of 8 bytes, then doubling on unsorted groups only."""
    n = len(data)
    words = _words(data)
    order = n - 1 - np.argsort(words[::-1], kind="stable")  # of equal numbers the last first: those cut off by the end are the lesser
    head = np.ones(n, bool)
    head[1:] = (words[order][1:] != words[order][:-1]) | (order[:-1] > n - 8)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while h < depth:
        loose = ~head
        loose[:-1] |= ~head[1:]
        at = np.flatnonzero(loose)
        if not len(at):
            break
        suffix = order[at]
        follow = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        key = rank[suffix] << 32 | follow  # a part holds fewer than 2^31 bytes
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        order[at], head[at] = suffix, new
        rank[suffix] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place in `order`, the bytes (up to `cap`) its suffix shares with the one before.

    Kasai's bound, a suffix shares at least one byte less than the suffix one position to its left, gives every
    eighth position's figure to the seven after it as a start.
    """
    n, step = len(order), 8
    words = np.concatenate([_words(data), np.zeros(cap + step, np.uint64)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)

    def extend(i: np.ndarray) -> None:
        i = i[(before[i] >= 0) & (shared[i] < cap)]
        while len(i):
            j, k = before[i], shared[i]
            room = n - np.maximum(i, j) - k
            x = words[i + k] ^ words[j + k]
            same = sum((x < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8)) + (x == 0)
            shared[i] += np.minimum(same, np.maximum(room, 0))
            i = i[(same == 8) & (room > 8) & (shared[i] < cap)]

    sampled = np.arange(0, n, step)
    extend(sampled)
    for r in range(1, step):
        i = np.arange(r, n, step)
        shared[i] = np.where(before[i] >= 0, np.maximum(shared[i - 1] - 1, 0) * (before[i] == before[i - 1] + 1), 0)
        extend(i)
    return np.minimum(shared, cap)[order]


def same_bytes(words: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether `size` bytes from `p` and from `q` on are equal, by the 8 bytes that `words` holds of each position."""
    same = np.ones(len(p), bool)
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        live = np.flatnonzero(same & (size > k))
        spare = np.uint64(8) * (8 - np.minimum(size[live] - k, 8)).astype(np.uint64)
        same[live] = (words[p[live] + k] ^ words[q[live] + k]) >> spare == 0
    return same


def _find(words: np.ndarray, sorted_: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search among windows in order, all given by position: place of the first one that isn't less, and whether it is equal."""
    spare = np.uint64(8 * (-length % 8))

    def column(at: np.ndarray, k: int) -> np.ndarray:
        return words[at + k] >> spare << spare if k + 8 > length else words[at + k]

    low, high, equal = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sorted_)), np.zeros(len(wanted), bool)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k in range(0, length, 8):
            live = np.flatnonzero(same)
            if not len(live):
                break
            x, y = column(sorted_[middle[live]], k), column(wanted[open_[live]], k)
            less[live], same[live] = x < y, x == y
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
        equal[open_[same]] = True  # once met, the search narrows down to it
    return low, equal


# ---- anchors ---------------------------------------------------------------------------------------


def runs(data: np.ndarray, at: np.ndarray, usable: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor (`bits` for the shard and SENT_BITS), first window, number of windows, row, hash of the run's text."""
    n = len(data)
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    if n < length:
        return none
    hashes = tx.Hashes(data)
    low = hashes.rolling(PIECE)
    span, width = length - PIECE + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    low &= np.uint64((1 << (bits + SENT_BITS)) - 1)
    ok = np.zeros(n + 1, np.int8)
    whole = np.flatnonzero((np.diff(at) >= length) & usable)
    np.add.at(ok, at[whole], 1)
    np.add.at(ok, at[whole + 1] - length + 1, -1)
    ok = np.cumsum(ok, dtype=np.int8)[: len(low)] > 0
    first = ok.copy()
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | edge[1 : len(low)]
    start = np.flatnonzero(first)
    if not len(start):
        return none
    # A run ends before the next one's first window, or where its document has no further window.
    row = tx.rows_of(at, start)
    count = np.minimum(np.append(start[1:], n), at[row + 1] - length + 1) - start
    return low[start], start, count, row, hashes.of(start, start + count + length - 1)


def _by_window(data: np.ndarray, found: tuple[np.ndarray, ...], hot: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, ...]:
    """Runs with those under `hot` anchors cut into single windows, whose anchor is their own hash."""
    split = np.isin(found[0], hot) if len(hot) else np.zeros(0, bool)
    if not split.any():
        return found
    _, start, count, row, _ = (x[split] for x in found)
    place = start.repeat(count) + _within(count)
    own = tx.Hashes(data).of(place, place + length)
    windows = (tx.mix(own) & np.uint64((1 << (bits + SENT_BITS)) - 1), place, np.ones(len(place), np.int64), row.repeat(count), own)
    return tuple(np.concatenate([x[~split], y]) for x, y in zip(found, windows, strict=True))


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of `counts` in turn."""
    return np.arange(int(counts.sum())) - _begins(counts).repeat(counts)


def _groups(words: np.ndarray, anchor: np.ndarray, text: np.ndarray, start: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, text and id, and where in it a new text begins: equal in anchor and hash, and compared byte by byte."""
    order = np.lexsort((docs, text, anchor))
    new = np.ones(len(order), bool)
    if len(order):
        p, q = order[1:], order[:-1]
        new[1:] = (anchor[p] != anchor[q]) | (text[p] != text[q]) | (size[p] != size[q])
        k = np.flatnonzero(~new[1:])
        new[1 + k] = ~same_bytes(words, start[p[k]], start[q[k]], size[p[k]])
    return order, new


def _bucket(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(SENT_BITS)).astype(np.int64)


# ---- blocks ----------------------------------------------------------------------------------------


def _pack(docs: DataFrame) -> DataFrame:
    def run(batches):
        import zstandard

        zip_, serial = zstandard.ZstdCompressor(level=1), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, at in tx.blocks(batch.column(1), BLOCK_BYTES):
                some = ids.slice(i, j - i)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([part << 32 | serial]), "ids": pa.array([some.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
                    "known": pa.array([some.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), "at": pa.array([at.astype(np.int64).tobytes()], pa.binary()),
                    "body": pa.array([zip_.compress(data.tobytes())], pa.binary()), "n_bytes": pa.array([len(data)]),
                })
                serial += 1

    return docs.mapInArrow(run, "block long, ids binary, known binary, at binary, body binary, n_bytes long")


def _open(batch, i: int):
    import zstandard

    col = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    size = batch.column("n_bytes")[i].as_py()
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("body")[i].as_buffer(), max_output_size=max(size, 1)) if size else b"", np.uint8)
    return data, col("at", np.int64), col("ids", np.int64), col("known", bool)


def _split(bucket: np.ndarray):
    """Ranges of equal values of a sorted array."""
    if not len(bucket):
        return iter(())
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return zip(bucket[cut].tolist(), cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=True)


def _low40(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from40(raw, shard: int = 0) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() | np.uint64(shard << SENT_BITS)


def _anchors(length: int, bits: int):
    """Of each block, its distinct anchors by shard, and which of them two of its documents hold."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, at, ids, known = _open(batch, i)
                anchor, _, count, row, _ = runs(data, at, known, length, bits)
                order = np.lexsort((ids[row], anchor))
                a, d, size = anchor[order], ids[row][order], (count + length - 1)[order]
                new = np.ones(len(a), bool)
                new[1:] = a[1:] != a[:-1]
                start = np.flatnonzero(new)
                twice = np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start) if len(start) else np.zeros(0, bool)
                total = np.add.reduceat(size, start) if len(start) else np.zeros(0, np.int64)
                a = a[new]
                large = np.where(total >= TOLD_BYTES, total, 0).clip(max=(1 << 32) - 1)
                parts = list(_split(_bucket(a)))
                told = [np.stack([np.flatnonzero(large[x:y]), large[x:y][large[x:y] > 0]]).astype(np.uint32).tobytes() for _, x, y in parts]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([p[0] for p in parts], pa.int64()), "block": pa.array([batch.column("block")[i].as_py()] * len(parts), pa.int64()), "anchors": pa.array([_low40(a[p[1] : p[2]]) for p in parts], pa.binary()), "twice": pa.array([np.packbits(twice[p[1] : p[2]]).tobytes() for p in parts], pa.binary()), "large": pa.array(told, pa.binary())})

    return run


def _again(hot: int, hot_bytes: int):
    """Of each block, the anchors that occur in two documents somewhere, and those that more than `hot` blocks hold or whose runs may have
    more than `hot_bytes` bytes."""

    def run(key, table):
        lists = [_from40(x) for x in table.column("anchors").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8))[: len(a)].astype(bool) for t, a in zip(table.column("twice").to_pylist(), lists, strict=True)]
        values, inverse, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        size, lo = count * TOLD_BYTES, 0
        for a, x in zip(lists, table.column("large").to_pylist(), strict=True):
            nth, more = np.frombuffer(x, np.uint32).reshape(2, -1).astype(np.int64)
            np.add.at(size, inverse[lo + nth], more)
            lo += len(a)
        hit, often = count > 1, (count > hot) | (size > hot_bytes)
        hit[inverse[np.concatenate(twice)]] = True
        out, lo = [], 0
        for block, a in zip(table.column("block").to_pylist(), lists, strict=True):
            kind = inverse[lo : lo + len(a)]
            lo += len(a)
            keep = a[hit[kind]]
            if len(keep):
                out.append((block, _low40(keep), _low40(a[often[kind]])))
        shard = table.column("shard").to_pylist()[0]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "shard": pa.array([shard] * len(out), pa.int64()), "hits": pa.array([o[1] for o in out], pa.binary()), "hot": pa.array([o[2] for o in out], pa.binary())})

    return run


#: What is sent of each run text, and of each place where the block holds it.
OF_TEXT, OF_PLACE = {"sizes": np.int32, "times": np.int32}, {"starts": np.int32, "docs": np.int64}


def _texts(length: int, bits: int):
    """Of each block, the distinct run texts under anchors that occur again, by shard: anchor, size, bytes, and places with their ids."""

    def run(batches):
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                data, at, ids, known = _open(batch, i)
                found, asked = runs(data, at, known, length, bits), batch.column("hits")[i].as_py()
                wanted = np.isin(found[0], np.concatenate([_from40(x["hits"], x["shard"]) for x in asked]))
                hot = np.concatenate([_from40(x["hot"], x["shard"]) for x in asked])
                anchor, start, count, row, text = _by_window(data, tuple(x[wanted] for x in found), hot, length, bits)
                size, doc = count + length - 1, ids[row]
                order, new = _groups(_words(data), anchor, text, start, size, doc)
                first = np.append(np.flatnonzero(new), len(order))
                k, body = order[first[:-1]], data.tobytes()
                begin, sizes, starts, docs = start[k].tolist(), size[k].astype(np.int32), start[order].astype(np.int32), doc[order]
                times, ends = np.diff(first).astype(np.int32), (start[k] + size[k]).tolist()
                rows = [(shard, _low40(anchor[k[x:y]]), sizes[x:y].tobytes(), times[x:y].tobytes(), starts[first[x] : first[y]].tobytes(), docs[first[x] : first[y]].tobytes(), zip_.compress(b"".join([body[p:q] for p, q in zip(begin[x:y], ends[x:y], strict=True)]))) for shard, x, y in _split(_bucket(anchor[k]))]
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_pydict({"shard": pa.array(columns[0], pa.int64()), "block": pa.array([batch.column("block")[i].as_py()] * len(rows), pa.int64()), **{n: pa.array(c, pa.binary()) for n, c in zip(("anchors", *OF_TEXT, *OF_PLACE, "body"), columns[1:], strict=True)}})

    return run


def window_owners(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int, part_bytes: int = PART_BYTES) -> np.ndarray:
    """For every window of texts laid end to end the smallest of `docs` (one a text) with that window: suffix arrays by part, merged by binary search."""
    sizes, words, begin = sizes.astype(np.int64), _words(data), _begins(sizes.astype(np.int64))
    heads, owner, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for _, lo, hi in _split(np.cumsum(sizes) // part_bytes):
        base, n = int(begin[lo]), sizes[lo:hi] - length + 1
        part = data[base : base + int(sizes[lo:hi].sum())]
        place = (begin[lo:hi] - base).repeat(n) + _within(n)
        doc = docs[lo:hi].repeat(n)
        order = suffix_array(part, length)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(common_prefixes(part, order, length) < length)
        # Groups of equal windows, numbered in their order without those that hold no window.
        used, inverse = np.zeros(len(part) + 1, np.int64), group[place]
        used[inverse] = 1
        inverse = (np.cumsum(used) - 1)[inverse]
        least, mine = np.full(int(used.sum()), np.iinfo(np.int64).max), np.zeros(int(used.sum()), np.int64)
        np.minimum.at(least, inverse, doc)
        mine[inverse] = place + base
        at, known = _find(words, heads, mine, length)
        owner[at[known]] = np.minimum(owner[at[known]], least[known])
        heads, owner = np.insert(heads, at[~known], mine[~known]), np.insert(owner, at[~known], least[~known])
        found.append((mine, inverse))
    if len(found) == 1:
        return owner[found[0][1]]
    return np.concatenate([owner[_find(words, heads, mine, length)[0]][inverse] for mine, inverse in found]) if found else np.zeros(0, np.int64)


def _search(length: int):
    """Of each block, the stretches (begin, end) of bytes that smaller ids cover, from the run texts of one shard."""

    def run(key, table):
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        cells = {n: [np.frombuffer(x, k) for x in table.column(n).to_pylist()] for n, k in (OF_TEXT | OF_PLACE).items()}
        anchors = np.concatenate([_from40(x) for x in table.column("anchors").to_pylist()])
        data = np.frombuffer(b"".join([unzip.decompress(x, max_output_size=int(s.sum())) for x, s in zip(table.column("body").to_pylist(), cells["sizes"], strict=True)]), np.uint8)
        of = np.repeat(np.arange(table.num_rows), [len(x) for x in cells["docs"]])
        sizes, times, starts, docs = (np.concatenate(cells[n]).astype(np.int64) for n in (*OF_TEXT, *OF_PLACE))
        begin = _begins(sizes)
        hashes = np.concatenate([tx.Hashes(data[begin[x] : begin[y - 1] + sizes[y - 1]]).of(begin[x:y] - begin[x], begin[x:y] - begin[x] + sizes[x:y]) for _, x, y in _split(begin // tx.STEP_BYTES)])
        # Texts of all blocks, by anchor, with the smallest id of each.
        order, new = _groups(_words(data), anchors, hashes, begin, sizes, docs[_begins(times)])
        text = np.empty(len(order), np.int64)
        text[order] = np.cumsum(new) - 1
        heads = order[new]
        least, windows = docs[_begins(times)[heads]], sizes[heads] - length + 1
        many = np.diff(np.append(np.flatnonzero(np.append(True, anchors[heads][1:] != anchors[heads][:-1])), len(heads)))
        shared = np.flatnonzero(np.repeat(many, many) > 1)
        h = heads[shared]
        owners = window_owners(data[begin[h].repeat(sizes[h]) + _within(sizes[h])], sizes[h], least[shared], length, PART_BYTES)
        # Stretches of windows with one owner; texts alone under their anchor have one each.
        place, of_text = _within(windows[shared]), shared.repeat(windows[shared])
        first = np.flatnonzero(np.append(True, (owners[1:] != owners[:-1]) | (place[1:] == 0))) if len(owners) else np.zeros(0, np.int64)
        last = np.append(place[first[1:] - 1], place[-1:]) + 1
        alone = np.setdiff1d(np.arange(len(heads)), shared, assume_unique=True)
        t, a, b, g = (np.concatenate(x) for x in ((of_text[first], alone), (place[first], np.zeros(len(alone), np.int64)), (last, windows[alone]), (owners[first], least[alone])))
        by = np.argsort(t, kind="stable")
        t, a, b, g = t[by], a[by], b[by], g[by]
        text = text.repeat(times)  # now of each place
        n = np.bincount(t, minlength=len(heads))[text]
        each, k = np.repeat(np.arange(len(text)), n), np.searchsorted(t, text).repeat(n) + _within(n)
        use = g[k] < docs[each]
        each, k = each[use], k[use]
        out = np.stack([starts[each] + a[k], starts[each] + b[k] + length - 1], 1).astype(np.int32)
        blocks = table.column("block").to_pylist()
        sent = [(blocks[c], out[x:y].tobytes()) for c, x, y in _split(of[each])]
        return pa.table({"block": pa.array([x[0] for x in sent], pa.int64()), "reply": pa.array([x[1] for x in sent], pa.binary())})

    return run


def _counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), at))


def _remove(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            data, at, ids, known = _open(batch, i)
            cover = np.zeros(len(data) + 1, np.int32)
            for reply in batch.column("replies")[i].as_py() or []:
                stretch = np.frombuffer(reply, np.int32).reshape(-1, 2)
                np.add.at(cover, stretch[:, 0], 1)
                np.add.at(cover, stretch[:, 1], -1)
            gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            first = gone.copy()
            first[1:] &= ~gone[:-1] | edge[1 : len(data)]
            raw, removed = data.tobytes(), _counted(gone, at)
            kept = [data[x:y][~gone[x:y]].tobytes() if r else raw[x:y] for x, y, r in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=~known), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed), "n_spans": pa.array(_counted(first, at)), "kept": pa.array(kept, pa.binary()),
            })


def _digest(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column(4)], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False, hot: int = HOT_BLOCKS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; `kept` holds the remaining bytes, or with `digest` kept_sha256 their hash."""
    spark = docs.sparkSession
    name, folder = f"pacelake_blocks_{uuid.uuid4().hex}", tx.shared_folder(spark)
    try:
        blocks = _stored(_pack(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))), name, folder)
        size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
        bits = max(4, math.ceil(math.log2(size / (length - PIECE) * 2 / SHARD_ANCHORS + 1)))
        sent = blocks.mapInArrow(_anchors(length, bits), "shard long, block long, anchors binary, twice binary, large binary")
        again = sent.groupBy("shard").applyInArrow(_again(hot, hot_bytes), "block long, shard long, hits binary, hot binary").groupBy("block").agg(F.collect_list(F.struct("shard", "hits", "hot")).alias("hits"))
        cells = ", ".join(f"{c} binary" for c in ("anchors", *OF_TEXT, *OF_PLACE, "body"))
        texts = blocks.join(again, "block").select(*blocks.columns, "hits").mapInArrow(_texts(length, bits), f"shard long, block long, {cells}")
        replies = texts.groupBy("shard").applyInArrow(_search(length), "block long, reply binary").groupBy("block").agg(F.collect_list("reply").alias("replies"))
        joined = blocks.join(tx.cut(replies), "block", "left").select(*blocks.columns, "replies")
        if digest:
            return tx.cut(joined.mapInArrow(lambda batches: _digest(_remove(batches)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
        return tx.cut(joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))
    finally:
        spark.sql(f"drop table if exists {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _stored(blocks: DataFrame, name: str, folder: str) -> DataFrame:
    """The blocks as a table in a shared folder, bucketed by block: joins on the block then move the other side only."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartition(parts, "block").write.format("parquet").option("compression", "none").option("path", folder).bucketBy(parts, "block").saveAsTable(name)
    return blocks.sparkSession.table(name)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
