"""MinHash near-dedup with an LSH forest.

Every text becomes its set of word shingles (64-bit hashes) and, for each of `trees` trees, a label of `depth`
MinHash values. Texts with the same set, by a cryptographic digest of the whole set in order, collapse to one first. Each tree's labels are sorted over the whole
corpus by range partitions; in sorted order, the texts that share the longest label prefix with a text stand
next to it, so a text's candidates are its next `width` neighbours whose common prefix reaches `least` values:
in a crowded region these share long prefixes, in an empty one short prefixes are enough. Partition borders are
sorted once more on their own, so no neighbour is lost there. Candidates are confirmed on the full sets, first
the closest ones, then those that still lie in different components. Components come from large-star and
small-star rounds over the confirmed links.

A run, all texts of a tree that share the first `least` values, may be longer than `width` reaches. Runs that
then still hold several components are finished exactly: the text with most links of a run meets all others (a
text with many edited copies joins them here), and where components remain apart, the run is dealt into parts of
bounded size, any two parts meet in a task of their own, and all pairs of different components are compared on
the full sets. So every pair with a common prefix is tried or lies in one component already.

A pair at similarity 0.8 shares the first 3 values in one tree with probability 0.51, so it misses all 16 trees
with probability 1e-5, however crowded its region is.

Texts of fewer words than a shingle are one shingle; null texts and texts without words have an empty set and
link with nothing. Rows with a null id link with nothing, get no component and stay. Repeated rows share their
id and so their component. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components

TREES, DEPTH, LEAST, WIDTH = 16, 8, 3, 4
#: Pairs that one task confirms.
TASK_PAIRS = 5_000
#: Shingles and texts in one part of a long run, and long runs that are few enough to be sent to all tasks.
PART_ITEMS, PART_TEXTS, FEW_RUNS = 100_000, 2_000, 20_000
#: Bits for each id in a map of ids, and in a whole map: 32 MB, sent to all tasks. With fewer bits an id more texts pass it, and none is lost.
ID_BITS, MAP_BITS = 16, 1 << 28


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in turn, sorted within it, and where each text's begin (one more at the end)."""
    lower = tx.LOWER[data]
    starts, ends, rows = tx.words(lower, at)
    n = len(at) - 1
    h = tx.range_hashes(lower, starts, ends)
    counts = np.bincount(rows, minlength=n)
    key = h.copy()
    for k in range(1, size):
        key[:-k] = tx.mix(key[:-k]) + h[k:]
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    place = np.arange(len(rows)) - first[rows]
    use = place + size <= counts[rows]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:  # the whole sequence is its only shingle
        k = first[i]
        value = h[k : k + 1]
        for j in range(1, counts[i]):
            value = tx.mix(value) + h[k + j : k + j + 1]
        key[k], use[k] = (tx.mix(value) ^ np.uint64(counts[i]))[0], True
    key, rows = tx.mix(key[use]), rows[use]
    order = np.lexsort((key, rows))
    key, rows = key[order], rows[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
    return key[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=n))])


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, n, set_key, labels): set size, digest of the set, and the trees' labels end to end as big-endian 16-bit values."""
    seeds = tx.mix(np.arange(1, trees * depth + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                keys, begin = shingle_sets(data, at, size)
                count = np.diff(begin)
                full = np.flatnonzero(count)
                labels, raw = np.zeros((j - i, trees * depth), ">u2"), keys.tobytes()
                if len(full):
                    for k, seed in enumerate(seeds):
                        x = keys * seed
                        low = np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin[full])
                        labels[full, k] = (tx.mix(low) >> np.uint64(48)).astype(">u2")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i), "n": pa.array(count, pa.int64()),
                    "set_key": pa.array([hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary()), "labels": pa.array([x.tobytes() for x in labels], pa.binary()),
                })

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, set_key binary, labels binary")


def _neighbours(depth: int, least: int, width: int, percent: int, border: bool):
    """Over rows (tree, label, id, n) in sorted order: pairs of a row with its next `width` ones that agree on `least` values and whose
    sizes allow the similarity; of a run that goes on behind these, a pair one step further (step `width` + 1) with its label. With
    `border`, also the first and last rows of the partition, for the pass over borders."""
    reach = width + 1

    def run(batches):
        tail, head_left, last = None, reach, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])]).combine_chunks()
            old = 0 if tail is None else tail.num_rows
            label = np.frombuffer(b"".join(table.column("label").to_pylist()), ">u2").reshape(-1, depth)
            tree, ids, n = (table.column(c).to_numpy() for c in ("tree", "id", "n"))
            found = []
            for step in range(1, width + 1):
                if len(ids) <= step:
                    break
                low, high = np.minimum(n[:-step], n[step:]), np.maximum(n[:-step], n[step:])
                ok = (tree[:-step] == tree[step:]) & (label[:-step, :least] == label[step:, :least]).all(1) & (100 * low >= percent * high) & (ids[:-step] != ids[step:])
                ok[: max(0, old - step)] = False  # told before
                k = np.flatnonzero(ok)
                found.append((np.minimum(ids[k], ids[k + step]), np.maximum(ids[k], ids[k + step]), np.full(len(k), step), tree[k]))
            if found:
                a, b, step, t = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _pairs(a, b, step, t, None)
            if len(ids) > reach:
                k = np.flatnonzero((tree[:-reach] == tree[reach:]) & (label[:-reach, :least] == label[reach:, :least]).all(1))
                k = k[np.append(True, (tree[k[1:]] != tree[k[:-1]]) | (label[k[1:], :least] != label[k[:-1], :least]).any(1))] if len(k) else k
                yield _pairs(ids[k], ids[k + reach], np.full(len(k), reach), tree[k], table.take(k))
            if border:
                if head_left:
                    head = table.slice(old, head_left)
                    head_left -= head.num_rows
                    yield _pairs(head.column("id").to_numpy(), None, None, head.column("tree").to_numpy(), head)
            tail = table.slice(max(0, table.num_rows - reach))
            last = tail
        if border and last is not None:
            yield _pairs(last.column("id").to_numpy(), None, None, last.column("tree").to_numpy(), last)

    return run


def _pairs(a, b, step, tree, rows):
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_pydict({
        "a": pa.array(a, pa.int64()), "b": none if b is None else pa.array(b, pa.int64()), "step": pa.nulls(len(a), pa.int32()) if step is None else pa.array(step, pa.int32()), "tree": pa.array(tree, pa.int32()),
        "label": pa.nulls(len(a), pa.binary()) if rows is None else rows.column("label").combine_chunks(), "n": none if rows is None else rows.column("n").combine_chunks(),
    })


_PAIRS = "a long, b long, step int, tree int, label binary, n long"


def _in_trees(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """(tree, label, id, n): each text once a tree."""
    each = sets.select("id", "n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "labels")
    return each.select("tree", F.expr(f"substring(labels, tree * {2 * depth} + 1, {2 * depth})").alias("label"), "id", "n")


def candidates(sets: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, width: int = WIDTH, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(a, b, round): pairs of ids a < b from (id, n, labels); round 1 holds next neighbours of the first two trees, round 2 the others.
    And (tree, prefix): the runs of more than `width` + 1 texts, of which not all pairs are among these."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _in_trees(sets, trees, depth).repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    found = tx.cut(ordered.mapInArrow(_neighbours(depth, least, width, percent, True), _PAIRS))
    edges = found.where(F.col("b").isNull()).select("tree", "label", F.col("a").alias("id"), "n").distinct()
    edges = tx.cut(edges.coalesce(1).sortWithinPartitions("tree", "label", "id").mapInArrow(_neighbours(depth, least, width, percent, False), _PAIRS))
    both = found.where(F.col("b").isNotNull()).unionByName(edges)
    long_runs = both.where(F.col("step") > width).select("tree", F.expr(f"substring(label, 1, {2 * least})").alias("prefix")).distinct()
    near = both.where(F.col("step") <= width).groupBy("a", "b").agg(F.min(F.when((F.col("step") == 1) & (F.col("tree") < 2), 1).otherwise(2)).alias("round"))
    return near, long_runs


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, at in tx.blocks(batch.column(1)):
                keys, begin = shingle_sets(data, at, size)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(i, j - i), "items": pa.array([keys[begin[k] : begin[k + 1]].tobytes() for k in range(j - i)], pa.binary())})

    return docs.mapInArrow(run, "id long, items binary")


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `texts` (id, text) whose id is one of `ids`, which has none twice. Where the texts are read, a map of hashed ids keeps back most
    others, so the join on the ids themselves sends little more than what is wanted."""
    ids = tx.cut(ids)
    most = 8 * 4096  # bits of one row of the map
    bits = min(MAP_BITS, max(1, -(-ids.count() * ID_BITS // most)) * most)
    spot = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    spots = ids.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    maps = spots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    passed = texts.withColumn("spot", spot).join(F.broadcast(maps), F.bitmap_bucket_number("spot") == F.col("bucket")).withColumn("bit", F.bitmap_bit_position("spot"))
    passed = passed.where("shiftright(cast(conv(hex(substring(map, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return passed.select("id", "text").join(ids, "id")  # a semi join would be moved below the map


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) < 64 else int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar enough; only texts that occur in a pair are shingled again."""
    tasks = tx.tasks_for(pairs, TASK_PAIRS)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().coalesce(tasks)
    # Few texts are left after the join, so four of its partitions share a task.
    wide = -(-int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    sets = tx.cut(_sets(_wanted(texts, needed).coalesce(max(tasks, wide)), size))
    left, right = (sets.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}")) for c in "ab")
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b")
    return met.coalesce(tasks).mapInArrow(_confirm(percent), "a long, b long")


def _relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label` (id, component) after links (a, b) between components; an id without a row is its own component."""
    above = components(tx.cut(links)).select(F.col("id").alias("below"), F.col("component").alias("above"))
    alone = above.select(F.col("below").alias("id"), F.col("below").alias("component")).join(label, "id", "left_anti")
    return tx.cut(label.unionByName(alone).join(above, F.col("component") == F.col("below"), "left").select("id", F.coalesce("above", "component").alias("component")))


def _few(runs: DataFrame) -> DataFrame:
    """A table of runs, one row each, sent to all tasks where it is small, so no task gets a whole long run; else written, so that the join may
    split one."""
    runs = tx.cut(runs)
    return F.broadcast(runs) if runs.count() <= FEW_RUNS else runs


def _unsettled(members: DataFrame, label: DataFrame) -> DataFrame:
    """(tree, prefix, id, n, c) of the texts in runs that hold several components."""
    named = members.join(label.select("id", "component"), "id", "left").select("tree", "prefix", "id", "n", F.coalesce("component", "id").alias("c"))
    runs = named.groupBy("tree", "prefix").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").drop("low", "high")
    return tx.cut(named.join(_few(runs), ["tree", "prefix"]))


def _hub_pairs(open_: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, ca, cb): of each run the text with most links, with all texts of other components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    hubs = open_.join(degree, "id", "left").groupBy("tree", "prefix").agg(F.max_by(F.struct(F.col("id").alias("hub"), F.col("c").alias("ch"), F.col("n").alias("nh")), F.struct(F.coalesce("links", F.lit(0)), -F.col("id"))).alias("h"))
    met = open_.join(_few(hubs.select("tree", "prefix", "h.*")), ["tree", "prefix"]).where("c != ch")
    low = F.col("id") < F.col("hub")
    return met.select("n", "nh", F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), F.when(low, F.col("c")).otherwise(F.col("ch")).alias("ca"), F.when(low, F.col("ch")).otherwise(F.col("c")).alias("cb"))


def _shared(n: np.ndarray, rows: np.ndarray, code: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Which texts of `first` and `second` share one of their rarest shingles, of which a similar text must have one: flags by text and text.

    Of n shingles, n - ceil(percent n / 100) + 1 are enough, whatever order all texts agree on.
    """
    often = np.bincount(code)
    order = np.lexsort((code, often[code], rows))
    rows, code = rows[order], code[order]
    start = np.cumsum(np.bincount(rows, minlength=len(n))) - np.bincount(rows, minlength=len(n))
    use = (np.arange(len(rows)) - start[rows] < n[rows] + (-percent * n[rows]) // 100 + 1) & (often[code] > 1)
    rows, code = rows[use], code[use]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    at_x, at_y = np.cumsum(first) - 1, np.cumsum(second) - 1
    met = np.zeros((int(first.sum()), int(second.sum())), bool)
    cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)) if len(code) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        x = rows[i:j]
        met[np.ix_(at_x[x[first[x]]], at_y[x[second[x]]])] = True
    return met


def _meet(percent: int):
    """Links between components of one part of a run, or of two: (a, b) as components, by exact intersections of the pairs that sizes and rare
    shingles leave. A part has PART_TEXTS texts on average, so the flags of two are a few MB."""

    def run(key, table):
        comp, place = table.column("c").to_numpy(), table.column("place").to_numpy()
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        n = np.array([len(x) for x in items])
        first, second = place == key[2].as_py(), place == key[3].as_py()
        x, y = np.flatnonzero(first), np.flatnonzero(second)
        code = np.unique(np.concatenate(items), return_inverse=True)[1]
        rows = np.repeat(np.arange(len(n)), n)
        start = np.cumsum(n) - n
        met = _shared(n, rows, code, first, second, percent)
        mark, links = np.zeros(len(code), bool), set()
        for i in np.flatnonzero(met.any(1)):
            k = x[i]
            others = y[met[i]]
            others = others[(comp[others] != comp[k]) & (100 * np.minimum(n[others], n[k]) >= percent * np.maximum(n[others], n[k]))]
            if not len(others):
                continue
            own = code[start[k] : start[k] + n[k]]
            mark[own] = True
            at = np.cumsum(n[others]) - n[others]
            both = np.add.reduceat(mark[code[np.repeat(start[others] - at, n[others]) + np.arange(int(n[others].sum()))]], at, dtype=np.int64)
            mark[own] = False
            links.update((min(comp[k], c), max(comp[k], c)) for c in comp[others[100 * both >= percent * (n[others] + n[k] - both)]].tolist())
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _all_pairs(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components over all pairs of each run whose sizes allow them. Texts are dealt by classes of size, of which
    only neighbours can be similar, and these into parts of PART_ITEMS shingles and PART_TEXTS texts on average, or one text."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(max(100 / percent, 1.01))) + 1e-9).cast("int")
    rows = open_.select("tree", "prefix", "id", "c", "n", level.alias("level"))
    plan = rows.groupBy("tree", "prefix", "level").agg(F.greatest(F.ceil(F.sum("n") / PART_ITEMS), F.ceil(F.count("*") / PART_TEXTS)).cast("int").alias("parts"))
    plan = tx.cut(plan)
    # The classes that a text's class meets: its own, and the next ones to both sides.
    near = plan.select("tree", "prefix", F.col("level").alias("to"), F.col("parts").alias("to_parts"), F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    met = near.join(plan, ["tree", "prefix", "level"])
    name = lambda level, part: F.col(level).cast("long") * F.lit(1 << 32) + part
    sets = tx.cut(_sets(_wanted(texts, open_.select("id").distinct()).dropDuplicates(["id"]), size))
    dealt = rows.join(met, ["tree", "prefix", "level"]).select("tree", "prefix", "id", "c", name("level", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("place"), F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)).alias("other"), "to")
    dealt = dealt.withColumn("other", name("to", F.col("other")))
    sent = dealt.select("tree", "prefix", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "place", "id", "c").join(sets, "id").drop("id")
    return sent.groupBy("tree", "prefix", "i", "j").applyInArrow(_meet(percent), "a long, b long").distinct()


def _finish_runs(firsts: DataFrame, long_runs: DataFrame, label: DataFrame, links: DataFrame, texts: DataFrame, size: int, percent: int, trees: int, depth: int, least: int) -> DataFrame:
    """`label` after every pair of every long run has been tried or found in one component."""
    long_runs = _few(long_runs)
    if long_runs.isEmpty():
        return label
    rows = _in_trees(firsts, trees, depth).select("tree", F.expr(f"substring(label, 1, {2 * least})").alias("prefix"), "id", "n")
    members = tx.cut(rows.join(long_runs, ["tree", "prefix"]))
    open_ = _unsettled(members, label)
    if open_.isEmpty():
        return label
    pairs = _hub_pairs(open_, links).where(100 * F.least("n", "nh") >= percent * F.greatest("n", "nh")).select("a", "b", "ca", "cb").distinct()
    pairs = tx.cut(pairs)
    if not pairs.isEmpty():
        more = confirm(pairs, texts, size, percent).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        label = _relabel(label, more)
        open_ = _unsettled(members, label)
    return label if open_.isEmpty() else _relabel(label, _all_pairs(open_, texts, size, percent))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`; the smallest id of a component is kept."""
    signed = tx.cut(signatures(docs, doc_id, text, size, trees, depth))
    real = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    same = tx.cut(real.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    firsts = real.join(same, (real["set_key"] == same["set_key"]) & (real["doc_id"] == same["rep"]), "left_semi").select(F.col("doc_id").alias("id"), "n", "labels").dropDuplicates(["id"])
    firsts = tx.cut(firsts)
    pairs, long_runs = candidates(firsts, trees, depth, least, width, percent)
    pairs = tx.cut(pairs)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    near = tx.cut(confirm(pairs.where("round = 1"), texts, size, percent))
    label = components(near)
    la, lb = (label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    rest = pairs.where("round = 2").join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca != cb")
    rest = tx.cut(rest)
    if not rest.isEmpty():  # these links join components of the first round
        linked = tx.cut(confirm(rest, texts, size, percent))
        label = _relabel(label, linked.join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        near = near.unionByName(linked)
    label = _finish_runs(firsts, long_runs, label, near, texts, size, percent, trees, depth, least)
    names = same.join(label, same["rep"] == label["id"], "left").select(F.col("set_key").alias("_key"), F.coalesce("component", "rep").alias("component"))
    out = signed.join(names, (F.col("set_key") == F.col("_key")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2)


OP5_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as s from d),
n as (select doc_id, len(s) as n from s),
x as (select doc_id, unnest(s) as g from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_n >= 80 * (na.n + nb.n - both_n)),
r as (select doc_id as node, doc_id as seen from n union select l.b as node, r.seen from r join l on l.a = r.node),
c as (select node, min(seen) as component_id from r group by node)
select n.doc_id, cast(n.n as bigint) as n_shingles, c.component_id, c.component_id = n.doc_id as kept from n join c on c.node = n.doc_id
"""
QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {"op5_near_dedup": OP5_SQL}
