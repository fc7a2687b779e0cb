"""Hard negatives by threshold joins: an inverted index cut by suffix norms, partial scores, and thresholds that come down.

Vectors lie in blocks of bounded size; a block's index holds, for each dimension, the vectors that have it as a kept
dimension. Dimensions are taken in order of size. The last ones of a vector, whose norm times the anchors' is under
the lowest threshold of a block of anchors, are omitted: they cannot carry a score over it alone. Scores are summed
dimension by dimension over the lists; after each step, what is left of both norms bounds the rest, and vectors that
can reach no anchor's threshold leave. The few pairs that are left get their exact products.

First each anchor's positives are looked for, above a high threshold; anchors with too few go on with lower ones, at
last with none. Then each positive's window of scores is filled from above in the same way, by anchors that still have
open windows. Each join returns a few rows for each anchor and block, whatever the number of vectors over a threshold
(copies included). What is paired is the stated anchors and all vectors, in blocks.

Rows with a null label or id, or a null, empty or non-finite vector, take no part. Rows with an anchor's id are its own
row, for it; an anchor that stands more than once is mined as often. Ties go to the smaller id; repeated rows are
candidates each. A vector meets vectors of its own dimension only. Products are exact below 2^63. A positive with a
negative score has no window. Extra columns are ignored; without anchors the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .topk import integers

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Rows and bytes of a block of vectors, rows of a block of anchors, dimensions of one step.
BLOCK, BLOCK_BYTES, ANCHOR_BLOCK, STEP = 4096, 4 << 20, 128, 8
#: Thresholds of positives as shares of the greatest possible product, and of negatives as shares of the positive's score.
POSITIVE_LEVELS, NEGATIVE_LEVELS = (0.4, 0.25), (0.9,)
#: Share of pairs still open at which they are finished one by one, and how many at a time.
FEW, PRODUCTS = 0.05, 1 << 16
LARGEST = (1 << 63) - 1


def threshold_pairs(q: np.ndarray, floors: np.ndarray, x: np.ndarray, step: int = STEP, few: float = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, exact product) of all pairs whose product reaches the floor of q's row; floors are integers."""
    d = x.shape[1]
    order = np.argsort(-np.abs(x).max(0, initial=0), kind="stable")
    qs, xs = q[:, order].astype(float), x[:, order].astype(float)
    q_rest, x_rest = _rest(qs), _rest(xs)
    q_top, low = q_rest[:, 0].max(initial=0), float(floors.min(initial=LARGEST))
    # What sums of floats may be short of, in all.
    error = 1e-6 + 1e-9 * q_top * x_rest[:, 0].max(initial=0)
    # The inverted index: dimensions of a vector up to where the norm of the rest is too small for the lowest floor, in whole steps.
    kept = np.minimum(d, -(-(x_rest[:, :d] * q_top + error >= low).sum(1) // step) * step)
    rows = np.argsort(-kept, kind="stable")
    rows = rows[kept[rows] > 0]
    kept, part, xs, x_rest = kept[rows], np.zeros((len(q), len(rows))), xs[rows], x_rest[rows]
    met = []
    for start in range(0, d, step):
        n = int(np.searchsorted(-kept, -start, side="left"))  # the lists of these dimensions: a prefix of the rows
        if n == 0:
            break
        end = min(start + step, d)
        rows, kept, part, xs, x_rest = rows[:n], kept[:n], part[:, :n], xs[:n], x_rest[:n]
        part += qs[:, start:end] @ xs[:, start:end].T
        fine = part + (q_rest[:, end, None] * x_rest[:, end] + error) >= floors[:, None]
        last = np.ones(n, bool) if end == d or fine.mean() < few else kept <= end
        if last.any():  # lists that end here, or few pairs left
            i, k = np.nonzero(fine & last)
            met.append((i, rows[k]))
        alive = ~last & fine.any(0)
        if not alive.all():
            rows, kept, part, xs, x_rest = rows[alive], kept[alive], part[:, alive], xs[alive], x_rest[alive]
    i, k = (np.concatenate([m[c] for m in met]) if met else np.zeros(0, np.int64) for c in (0, 1))
    score = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", q[i[a : a + PRODUCTS]], x[k[a : a + PRODUCTS]]) for a in range(0, len(i), PRODUCTS))])
    ok = score >= floors[i]
    return i[ok], k[ok], score[ok]


def _rest(v: np.ndarray) -> np.ndarray:
    """Norms of what is left from each dimension on; 0 behind the last."""
    return np.sqrt(np.append(np.cumsum(v[:, ::-1] ** 2, axis=1)[:, ::-1], np.zeros((len(v), 1)), axis=1))


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best of each group, by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[place < most]


def _blocks(rows: DataFrame) -> DataFrame:
    """(dim, part, ids, labels, matrix): vectors dealt by row, so that copies and frequent ids are spread."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))).alias("parts"))
    sizes = sizes.select(F.col("dim").alias("d"), "parts")
    marked = rows.join(sizes, F.col("dim") == F.col("d")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))

    def gather(key, table):
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        packed = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table({"dim": table.column("dim").slice(0, 1), "part": table.column("part").slice(0, 1), "ids": packed(table.column("id").to_numpy()), "labels": packed(table.column("label").to_numpy().astype(np.int64)), "matrix": packed(flat)})

    return marked.select("dim", "part", "id", "label", "v").groupBy("dim", "part").applyInArrow(gather, "dim int, part long, ids binary, labels binary, matrix binary")


_ASKED = "q_block string, q_dim int, q_keys binary, q_ids binary, q_labels binary, q_matrix binary, q_floors binary, q_tops binary"


def _asked(anchors: DataFrame) -> DataFrame:
    """Blocks of anchors (dim, key, id, label, v, floors, tops); `floors` and `tops` are arrays: the windows of scores looked for."""
    counts = anchors.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(ANCHOR_BLOCK)).alias("parts")).select(F.col("dim").alias("d"), "parts")
    dealt = anchors.join(counts, F.col("dim") == F.col("d")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))

    def gather(key, table):
        packed = lambda name: pa.array([np.ascontiguousarray(table.column(name).to_numpy().astype(np.int64)).tobytes()], pa.binary())
        lists = lambda name: pa.array([table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary())
        dim, part = (k.as_py() for k in key)
        return pa.table([pa.array([f"{dim}/{part}"]), pa.array([dim], pa.int32()), packed("key"), packed("id"), packed("label"), lists("v"), lists("floors"), lists("tops")], [c.split()[0] for c in _ASKED.split(", ")])

    return dealt.select("dim", "part", "key", "id", "label", "v", "floors", "tops").groupBy("dim", "part").applyInArrow(gather, _ASKED)


def _joined(base: DataFrame, anchors: DataFrame, same_label: bool, most: int) -> DataFrame:
    """(key, window, place, id, score): for each anchor and window, the `most` best rows of the anchor's label, or of other ones."""

    def join(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                ids, labels, keys, q_ids, q_labels = (np.frombuffer(batch.column(n)[b].as_buffer(), np.int64) for n in ("ids", "labels", "q_keys", "q_ids", "q_labels"))
                x = np.frombuffer(batch.column("matrix")[b].as_buffer(), np.int64).reshape(len(ids), -1)
                q, floors, tops = (np.frombuffer(batch.column(n)[b].as_buffer(), np.int64).reshape(len(keys), -1) for n in ("q_matrix", "q_floors", "q_tops"))
                i, k, score = threshold_pairs(q, floors.min(1), x)
                ok = ((labels[k] == q_labels[i]) == same_label) & (ids[k] != q_ids[i])
                i, k, score = i[ok], k[ok], score[ok]
                for w in range(floors.shape[1]):
                    at = np.flatnonzero((score >= floors[i, w]) & (score <= tops[i, w]))
                    at = at[best_of(i[at], score[at], ids[k[at]], most)]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i[at]]), pa.array(np.full(len(at), w, np.int32)), pa.array(ids[k[at]]), pa.array(score[at])], ["key", "window", "id", "score"])

    asked = tx.cut(_asked(anchors))
    named = asked.select("q_block", "q_dim").join(base.select("dim", "part"), F.col("q_dim") == F.col("dim")).drop("q_dim")  # names of blocks only
    wanted = named.join(asked, "q_block").select(F.col("dim").alias("d"), F.col("part").alias("p"), *asked.columns[2:])
    met = wanted.join(base, (F.col("dim") == F.col("d")) & (F.col("part") == F.col("p"))).drop("d", "p", "dim", "part")
    place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.col("score").desc(), "id"))
    return tx.cut(met.mapInArrow(join, "key long, window int, id long, score long").withColumn("place", place).where(F.col("place") <= most))


def _full(found: DataFrame, most: int, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= most).select(*by)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def nearest_of_label(base: DataFrame, anchors: DataFrame, norms: DataFrame, most: int) -> DataFrame:
    """(key, place, id, score): each anchor's best rows of its label, by thresholds that come down until all have `most`."""
    anchors = anchors.join(norms, F.col("dim") == F.col("d")).drop("d")
    done = []
    for level in (*POSITIVE_LEVELS, None):
        floor = F.lit(-LARGEST) if level is None else F.floor(F.lit(level) * F.col("norm") * F.col("top")).cast("long")
        found = _joined(base, anchors.withColumn("floors", F.array(floor)).withColumn("tops", F.array(F.lit(LARGEST))), True, most)
        if level is None:
            done.append(found)
            break
        full = _full(found, most, "key")
        done.append(found.join(full, "key", "left_semi"))
        anchors = anchors.join(full, "key", "left_anti")
        if anchors.isEmpty():
            break
    return _union([d.select("key", "place", "id", "score") for d in done])


def below_positives(base: DataFrame, anchors: DataFrame, found: DataFrame, positives: int, most: int) -> DataFrame:
    """(key, window, place, id, score): for each positive of `found`, the best rows of other labels from 80 to 100 percent of its score."""
    score = F.col("score")
    todo = found.where(score >= 0).select("key", (F.col("place") - 1).alias("window"), score.alias("top"), (score - F.expr("score div 5")).alias("least"))
    done = []
    for level in (*NEGATIVE_LEVELS, None):
        floor = F.col("least") if level is None else F.greatest("least", F.col("top") - F.floor(F.col("top") * F.lit(1 - level)).cast("long"))
        # A window that isn't looked for is closed: its floor is above its top.
        slot = lambda w, c, other: F.coalesce(F.max(F.when(F.col("window") == w, c)), F.lit(other))
        windows = todo.groupBy("key").agg(F.array(*[slot(w, floor, LARGEST) for w in range(positives)]).alias("floors"), F.array(*[slot(w, F.col("top"), -LARGEST) for w in range(positives)]).alias("tops"))
        got = _joined(base, anchors.join(windows, "key"), False, most)
        if level is None:
            done.append(got)
            break
        full = _full(got, most, "key", "window")
        done.append(got.join(full, ["key", "window"], "left_semi"))
        todo = todo.join(full, ["key", "window"], "left_anti")
        if todo.isEmpty():
            break
    return _union(done)


def mine(rows: DataFrame, anchor: "F.Column", vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which `anchor` holds."""
    taken = rows.where(F.col(label).isNotNull())
    carried = {"label": F.col(label).cast("long"), "anchor": F.coalesce(anchor, F.lit(False))}
    vectors = tx.stored(integers(taken, vec_id, vector, scale, carried).withColumn("key", F.monotonically_increasing_id()))
    base = tx.cut(_blocks(vectors))
    anchors = vectors.where("anchor").drop("anchor")
    norms = vectors.groupBy("dim").agg(F.max("norm").alias("top")).withColumnRenamed("dim", "d")
    found = tx.cut(nearest_of_label(base, anchors, norms, positives))
    mined = below_positives(base, anchors, found, positives, negatives)
    pairs = found.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select("key", (F.col("place") - 1).alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(pairs, ["key", "window"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = """
with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.v) = len(c.v) where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLES = {"op13_hard_negatives": OP13_SQL}
