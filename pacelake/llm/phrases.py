"""Phrases mined from truncated suffix trees, built group by group after a vertical partition of their prefixes.

The corpus is a string of words; every word starts a suffix, cut off at the end of its piece and after `depth` = 3 words.

1. Vertical partition (one pass). Each task counts words and pairs of words in cells of their hashes; ranges of
   cells are summed by themselves. A cell under `min_count` holds no frequent prefix, so suffixes are cut before the
   first infrequent one; the cells that are left are grouped, in order, into groups of at most 2 * `budget` suffixes. A
   cell of words above the budget is split by longer prefixes: by pairs, and where pairs are above it too, by triples.
   The driver sees two bit maps (of a size set by WORD_BITS and PAIR_BITS) and the limits of groups (one for each
   `budget` suffixes). Cells only choose: counts come from the words themselves.
2. Subtrees (second pass). Blocks of text send each group its suffixes, equal ones once with a count. A group, whose
   memory is bounded by the budget, sorts them: a run of equal suffixes is a leaf, a run of equal prefixes a node, and
   a node's frequency is the total of its leaves. Nodes above a split prefix are partial in each group and summed.
3. Scores. A phrase asks for the frequencies of its parts by key; Spark splits parts that many phrases share.

Null text counts as empty, null lang as `und`. Repeated rows count as often as they stand; null and equal ids play
no role. Without rows, or without a phrase of `min_count`, the result is empty. Extra columns are ignored. A text of
any length is one block at least; some 60 bytes of memory for each byte of a text that is longer than STEP_BYTES.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

MIN_COUNT, TOP, COVERED = 10, 2000, 50
#: Suffixes of one group (it may have twice as many), bits of the cells of words and of pairs, ranges of cells.
BUDGET, WORD_BITS, PAIR_BITS, SLICES = 1 << 19, 22, 24, 256
#: Bytes of text that one block holds, unless a single text is longer.
STEP_BYTES = 8 << 20
#: Bytes that end a piece, and those that end a word only.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

BREAK = np.zeros(256, bool)
BREAK[list(PIECE_ENDS)] = True
GAP = BREAK.copy()
GAP[list(WORD_ENDS)] = True


class Block:
    """The words of a run of texts of one language: local ids, the vocabulary, and where a suffix may go on."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: str):
        data = tx.LOWER[data]
        inside = ~GAP[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1 : len(data)]
        starts = np.flatnonzero(first)
        ends = BREAK[data] | edge[1:]  # of a piece, at the byte or behind it
        size = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        offsets = np.append(0, np.cumsum(size))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
        self.ids, self.words, self.lang = coded.indices.to_numpy().astype(np.int64), coded.dictionary, lang
        #: Whether the next word belongs to the same piece; the last word has none.
        self.more = np.append(~np.logical_or.reduceat(ends, starts)[:-1], False) if len(starts) else np.zeros(0, bool)
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest()))
        at_word = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        body = np.frombuffer(self.words.buffers()[2], np.uint8) if len(self.words) else np.zeros(0, np.uint8)
        self.hash = tx.mix(tx.Hashes(body).of(at_word[:-1], at_word[1:]) ^ salt)

    def pair_hash(self) -> np.ndarray:
        """Of each word and the next one, whatever that is."""
        h = self.hash[self.ids]
        return tx.mix(h * np.uint64(3) + np.append(h[1:], h[:1]))


def blocks_of(batches):
    """Blocks of (text, lang) batches; a block has one language."""
    for batch in batches:
        langs = batch.column(1)
        for lang in pc.unique(langs).to_pylist():
            for _, _, data, at in tx.blocks(batch.column(0).filter(pc.equal(langs, lang)), STEP_BYTES):
                block = Block(data, at, lang)
                if len(block.ids):
                    yield block


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of `values` between bounds as byte strings."""
    values = np.ascontiguousarray(values)
    at = np.asarray(bounds, np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)]).cast(pa.binary())


def _unpacked(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bit(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    cell = cell.astype(np.int64)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


_CELLS = "level int, slice int, lang string, n long, cells binary, counts binary"
_PLAN = "level int, slice int, lang string, n long, bits binary, starts binary, hot binary, hot_n binary"


def partition(texts: DataFrame, min_count: int, budget: int, word_bits: int, pair_bits: int, slices: int) -> DataFrame:
    """The vertical partition of (text, lang): a row a level and range of cells with its frequent cells as bits, the first cells
    of its groups and its cells above the budget; and rows of level 0 with numbers of words of a language."""
    bits = {1: word_bits, 2: pair_bits}

    def count(batches):
        seen = {k: np.zeros(1 << b, np.uint32) for k, b in bits.items()}
        total: dict[str, int] = {}
        for block in blocks_of(batches):
            total[block.lang] = total.get(block.lang, 0) + len(block.ids)
            np.add.at(seen[1], (block.hash >> np.uint64(64 - word_bits)).astype(np.int64), np.bincount(block.ids, minlength=len(block.hash)).astype(np.uint32))
            np.add.at(seen[2], (block.pair_hash()[block.more] >> np.uint64(64 - pair_bits)).astype(np.int64), np.uint32(1))
        names = ["level", "slice", "lang", "n", "cells", "counts"]
        if total:
            nothing = pa.nulls(len(total), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array(list(total)), pa.array(list(total.values()), pa.int64()), nothing, nothing], names)
        for level, counts in seen.items():
            cells = np.flatnonzero(counts).astype(np.uint32)
            if len(cells):
                bounds = np.searchsorted(cells, np.arange(slices + 1) * (len(counts) // slices))
                head = [pa.array(np.full(slices, level, np.int32)), pa.array(np.arange(slices, dtype=np.int32)), pa.nulls(slices, pa.string()), pa.nulls(slices, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, _packed(cells, bounds), _packed(counts[cells], bounds)], names)

    def fold(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        names = ["level", "slice", "lang", "n", "bits", "starts", "hot", "hot_n"]
        for batch in batches:
            for level, part, lang, n, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if level == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([lang], pa.string()), pa.array([n], pa.int64()), *[pa.nulls(1, pa.binary())] * 4], names)
                    continue
                width = (1 << bits[level]) // slices
                own = sums.setdefault((level, part), np.zeros(width, np.int64))
                own[np.frombuffer(cells, np.uint32) - np.uint32(part * width)] += np.frombuffer(counts, np.uint32)
        for (level, part), own in sums.items():
            frequent = own >= min_count
            hot = np.flatnonzero(own > (budget if level == 1 else max(1, budget // 2)))
            size = np.where(frequent, own, 0)
            size[hot] = 0
            group = (np.cumsum(size) - size) // budget
            starts = np.append(0, np.flatnonzero(np.diff(group)) + 1) + part * len(own)
            row = [np.packbits(frequent), starts.astype(np.int64), (hot + part * len(own)).astype(np.int64), own[hot]]
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names)

    return texts.mapInArrow(count, _CELLS).repartition(F.col("level"), F.col("slice")).mapInArrow(fold, _PLAN)


class Plan:
    """What the vertical partition has found, as the second pass needs it."""

    def __init__(self, rows, word_bits: int, pair_bits: int, slices: int, budget: int):
        self.bits, self.budget, self.word_bits, self.pair_bits = {}, budget, word_bits, pair_bits
        for level, bits in ((1, word_bits), (2, pair_bits)):
            width = (1 << bits) // slices // 8
            self.bits[level] = np.zeros((1 << bits) // 8, np.uint8)
            for r in rows:
                if r.level == level:
                    self.bits[level][r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.bits, np.uint8)
        of = lambda level, name: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[name], np.int64) for r in sorted(rows, key=lambda r: r.slice) if r.level == level)])
        self.starts = np.union1d([0], of(1, "starts"))
        self.hot, self.hot_n, self.hot2, self.hot2_n = of(1, "hot"), of(1, "hot_n"), of(2, "hot"), of(2, "hot_n")

    def group_of(self, h: np.ndarray, pair: np.ndarray, triple: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each suffix, and how many words its prefix there has."""
        cell = (h >> np.uint64(64 - self.word_bits)).astype(np.int64)
        group, level = np.searchsorted(self.starts, cell, side="right").astype(np.int64), np.ones(len(cell), np.int8)
        k = _found(self.hot, cell)
        for i in (np.flatnonzero(k >= 0),):
            parts = (2 * self.hot_n[k[i]] // self.budget + 1).astype(np.uint64)
            sub = np.where(depth[i] > 1, tx.mix(pair[i]) % parts, np.uint64(0))
            group[i], level[i] = (tx.mix(cell[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub + np.uint64(1)) >> np.uint64(1)).astype(np.int64), 2
        cell2 = (pair >> np.uint64(64 - self.pair_bits)).astype(np.int64)
        k2 = np.where((k >= 0) & (depth > 1), _found(self.hot2, cell2), -1)
        for i in (np.flatnonzero(k2 >= 0),):
            parts = (2 * self.hot2_n[k2[i]] // self.budget + 1).astype(np.uint64)
            sub = np.where(depth[i] > 2, tx.mix(triple[i]) % parts, np.uint64(0))
            group[i], level[i] = (tx.mix(tx.mix(cell2[i].astype(np.uint64) + np.uint64(1 << 40)) + sub) >> np.uint64(1)).astype(np.int64), 3
        return group, level


def _found(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands in sorted values, or -1."""
    if not len(values):
        return np.full(len(x), -1)
    at = np.searchsorted(values, x).clip(max=len(values) - 1)
    return np.where(values[at] == x, at, -1)


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers under 2^31, and how often each stands."""
    key = columns[0].astype(np.int64)
    for k, x in enumerate(columns[1:]):
        if k:  # a second factor may pass 64 bits: ranks instead
            key = np.unique(key, return_inverse=True)[1]
        key = (key << 31) | x
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(key)))


_FRAGMENT = "gid long, level int, lang string, words binary, lengths binary, k1 binary, k2 binary, k3 binary, counts binary"


def _fragments(block: Block, plan: Plan):
    """A row for each group with the block's suffixes in it: their words, and (first, second, third, count) of each distinct one."""
    ids, more, h = block.ids, block.more, block.hash
    fine = _bit(plan.bits[1], h >> np.uint64(64 - plan.word_bits))[ids]
    pair = block.pair_hash()
    two = more & fine & np.append(fine[1:], False) & _bit(plan.bits[2], pair >> np.uint64(64 - plan.pair_bits))
    three = two & np.append(two[1:], False)
    parts = []
    for depth, chosen in ((1, fine & ~two), (2, two & ~three), (3, three)):
        i = np.flatnonzero(chosen)
        values, n = _distinct(*(ids[i + k] for k in range(depth)))
        parts.append((np.stack([*values, *[np.full(len(n), -1)] * (3 - depth)]), n, np.full(len(n), depth)))
    keys, n, depth = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    if not len(n):
        return
    a, b, c = keys
    pair_of = tx.mix(h[a] * np.uint64(3) + h[b])
    gid, level = plan.group_of(h[a], pair_of, tx.mix(pair_of * np.uint64(5) + h[c]), depth)
    order = np.lexsort((level, gid))
    gid, level, keys, n = gid[order], level[order], keys[:, order], n[order]
    cuts = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (level[1:] != level[:-1])))
    bounds = np.append(cuts, len(n))
    run = np.repeat(np.arange(len(cuts)), np.diff(bounds))
    met = ((run << 31) | keys)[keys >= 0]  # (run, word), words of a run get numbers of their own
    used = np.unique(met)
    local = np.full(keys.shape, -1, np.int32)
    first = np.searchsorted(used, np.arange(len(cuts) + 1) << 31)
    local[keys >= 0] = np.searchsorted(used, met) - first[met >> 31]
    words = block.words.take(pa.array(used & ((1 << 31) - 1)))
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    body = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if len(words) else np.zeros(0, np.uint8)
    yield pa.RecordBatch.from_arrays(
        [pa.array(gid[cuts]), pa.array(level[cuts].astype(np.int32)), pa.array([block.lang] * len(cuts), pa.string()), _packed(body, at[first] - at[0]), _packed(np.diff(at).astype(np.uint32), first), *(_packed(k, bounds) for k in local), _packed(n.astype(np.uint32), bounds)],
        ["gid", "level", "lang", "words", "lengths", "k1", "k2", "k3", "counts"],
    )


_NODE = "lang string, k int, w1 string, w2 string, w3 string, f long, whole boolean"


def _subtree(min_count: int):
    """A group's fragments to the nodes of its subtrees."""

    def build(key, table):
        level = key[1].as_py()
        words, lengths = b"".join(table.column("words").to_pylist()), _unpacked(table.column("lengths"), np.uint32).astype(np.int64)
        offsets = np.append(0, np.cumsum(lengths))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).dictionary_encode()
        code = np.append(coded.indices.to_numpy().astype(np.int64), -1)
        sizes = np.array([len(x) // 4 for x in table.column("k1").to_pylist()])
        base = np.append(0, np.cumsum([len(x) // 4 for x in table.column("lengths").to_pylist()]))[:-1]
        keys = np.stack([_unpacked(table.column(c), np.int32) for c in ("k1", "k2", "k3")], axis=1).astype(np.int64)
        keys = code[np.where(keys >= 0, keys + np.repeat(base, sizes)[:, None], -1)]
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang = np.repeat(langs.indices.to_numpy(), sizes).astype(np.int64)
        n = _unpacked(table.column("counts"), np.uint32).astype(np.int64)
        top, low = (lang << 31) | keys[:, 0], ((keys[:, 1] + 1) << 31) | (keys[:, 2] + 1)
        order = np.lexsort((low, top))
        top, low, keys, lang = top[order], low[order], keys[order], lang[order]
        sums = np.append(0, np.cumsum(n[order]))
        out = []
        new = np.append(True, top[1:] != top[:-1])
        for k in (1, 2, 3):
            if k > 1:  # a node ends where its own or a shorter prefix ends
                part = low >> 31 if k == 2 else low
                new = new | np.append(True, part[1:] != part[:-1])
            at = np.flatnonzero(new)
            f = np.diff(sums[np.append(at, len(top))])
            held = (keys[at, k - 1] >= 0) & ((f >= min_count) | (k < level))
            at, f = at[held], f[held]
            word = [coded.dictionary.take(pa.array(keys[at, i])).cast(pa.binary()).cast(pa.string()) if i < k else pa.nulls(len(at), pa.string()) for i in range(3)]
            out.append(pa.table([langs.dictionary.take(pa.array(lang[at])), pa.array(np.full(len(at), k, np.int32)), *word, pa.array(f), pa.array(np.full(len(at), k >= level))], ["lang", "k", "w1", "w2", "w3", "f", "whole"]))
        return pa.concat_tables(out)

    return build


def nodes(texts: DataFrame, min_count: int = MIN_COUNT, budget: int = BUDGET, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """Of (text, lang): phrases of 1 to 3 words with their frequency f where it is `min_count` or more (lang, k, w1, w2, w3, f), and (lang, n)."""
    spark = texts.sparkSession
    found = tx.cut(partition(texts, min_count, budget, word_bits, pair_bits, slices))
    plan = Plan(found.where("level > 0").select("level", "slice", "bits", "starts", "hot", "hot_n").collect(), word_bits, pair_bits, slices, budget)
    shared = spark.sparkContext.broadcast(plan)  # of a size set by word_bits, pair_bits and the number of groups

    def send(batches):
        for block in blocks_of(batches):
            yield from _fragments(block, shared.value)

    tree = tx.cut(texts.mapInArrow(send, _FRAGMENT).groupBy("gid", "level").applyInArrow(_subtree(min_count), _NODE))
    names = ["lang", "k", "w1", "w2", "w3"]
    partial = tree.where("not whole").groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return tree.where("whole").select(*names, "f").unionByName(partial), found.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n"))


def _phrase(*parts) -> "F.Column":
    return F.concat_ws(" ", *parts)


def scored(tree: DataFrame) -> DataFrame:
    """(lang, k, w1, w2, w3, phrase, a, l, r, score) of the phrases of 2 and 3 words, by the cut with the lowest score."""
    tree = tree.withColumn("phrase", _phrase("w1", "w2", "w3"))
    ask = lambda cut, side, *parts: F.struct(F.lit(2 * cut + side).alias("role"), _phrase(*parts).alias("part"))
    two = F.array(ask(1, 0, "w1"), ask(1, 1, "w2"))
    three = F.array(ask(1, 0, "w1"), ask(1, 1, "w2", "w3"), ask(2, 0, "w1", "w2"), ask(2, 1, "w3"))
    asked = tree.where("k > 1").select("lang", "k", "w1", "w2", "w3", "phrase", F.col("f").alias("a"), F.explode(F.when(F.col("k") == 2, two).otherwise(three)).alias("ask"))
    known = tree.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    met = asked.join(known, (F.col("lang") == F.col("_lang")) & (F.col("ask.part") == F.col("_part")))
    parts = [F.max(F.when(F.col("ask.role") == role, F.col("_f"))).alias(f"p{role}") for role in (2, 3, 4, 5)]
    met = met.groupBy("lang", "k", "w1", "w2", "w3", "phrase", "a").agg(*parts)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = lambda l, r: F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * wide("a") * wide("a"), wide(l) * wide(r))
    cut = lambda k: F.struct(score(f"p{2 * k}", f"p{2 * k + 1}").alias("score"), F.lit(k).alias("cut"), F.col(f"p{2 * k}").alias("l"), F.col(f"p{2 * k + 1}").alias("r"))
    best = F.when(F.col("k") == 2, cut(1)).otherwise(F.least(cut(1), cut(2)))
    return met.withColumn("best", best).select("lang", "k", "w1", "w2", "w3", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases that no longer phrase covers to `covered` percent."""
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    tree, totals = nodes(texts, min_count, **sizes)
    found = tx.cut(scored(tree))
    inside = found.where("k = 3").select(F.col("lang").alias("_lang"), F.explode(F.array(_phrase("w1", "w2"), _phrase("w2", "w3"))).alias("_part"), F.col("a").alias("_longer"))
    inside = inside.groupBy("_lang", "_part").agg(F.max("_longer").alias("_longer"))
    met = found.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left")
    left = met.where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a"))).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within parts of a language, so that no task sorts a whole one.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order))
    left = left.withColumn("_place", part).where(F.col("_place") <= top).drop("_place")
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = totals.select(F.col("lang").alias("_lang"), "n")
    return left.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, w[i : i + k - 1] as parts
  from (select lang, w, unnest(range(1, len(w) + 1)) as i from w), (values (1), (2), (3)) t(k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, min(parts) as parts, count(*) as f from g group by lang, k, phrase having count(*) >= 10),
c as (select f.lang, f.k, f.phrase, f.parts, f.f as a, c.c as cut, array_to_string(f.parts[1 : c.c], ' ') as left_part, array_to_string(f.parts[c.c + 1 : f.k], ' ') as right_part
  from f join (values (1), (2)) c(c) on c.c < f.k),
s as (select c.lang, c.k, c.phrase, c.parts, c.a, c.cut, l.f as l, r.f as r, cast((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as bigint) as score
  from c join f l on l.lang = c.lang and l.phrase = c.left_part and l.k = c.cut join f r on r.lang = c.lang and r.phrase = c.right_part and r.k = c.k - c.cut),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, array_to_string(parts[s.s : s.s + 1], ' ') as phrase, max(a) as longer from b, (values (1), (2)) s(s) where k = 3 group by all),
t as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from b left join i on i.lang = b.lang and i.phrase = b.phrase where i.longer is null or 100 * i.longer < 50 * b.a)
select t.lang, cast(rank as int) as rank, t.phrase, t.a, t.l, t.r, n.n, t.score from t join n on n.lang = t.lang where rank <= 2000
"""
QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": OP12_SQL}
