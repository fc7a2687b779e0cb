"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length, in classes of a quarter of a doubling; within a class, vectors with the same two
largest coordinates stand together, in blocks of bounded rows and bytes of their own if they are many. A block knows the length of
its longest vector, its mean direction and the widest angle to it. Queries lie in blocks of their own, cut in the same
way, so that queries of a block have like lengths and directions.

Blocks are met in waves, longest vectors first, each wave twice as large as those before it together; the first one also
takes, for each block of queries, the block whose direction is nearest. After a wave each query knows a floor under its
k-th score. A block of queries meets a block of vectors in the next wave only if the bound from length and direction
reaches the floor of one of its queries; this is told from names, lengths and directions, before any vector moves. Within a
pair, a query's floor and the block's greatest length give a local threshold, the cosine a vector needs to matter:
above 1 the block is skipped; below `switch` vectors are pruned by length (a prefix of the block); otherwise by the
coordinates where the query is largest, with a bound on the rest. Survivors are verified by exact integer products.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id; a
vector meets only vectors of its own dimension. Candidates with the query's id are its own row. Ties go to the
smaller id; repeated rows are candidates each. Products are exact while lengths multiply to less than 2^53, and
up to 2^63 by integers. Extra columns are ignored; without queries the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

SCALE, BLOCK, QUERY_BLOCK, FOCUS, SWITCH = 1024, 8192, 512, 16, 0.3
#: Bytes of vectors in one block, and blocks whose directions stand in one row.
BLOCK_BYTES, CHUNK = 8 << 20, 256


def integers(rows: DataFrame, vec_id: str, vector: str, scale: int = SCALE, carried: dict | None = None) -> DataFrame:
    """(id, v, dim, norm) of the vectors that take part, and carried columns; v holds floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    kept = kept.select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), F.size(vector).alias("dim"), *[c.alias(name) for name, c in (carried or {}).items()])
    return kept.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(level, part, dim, top, centre, spread, n, ids, matrix, norms): vectors of like length and direction, longest first, as byte strings.
    A block takes about `size` rows, or BLOCK_BYTES; a pair of largest coordinates that more vectors share is cut by hash."""
    level = F.when(F.col("norm") > 0, F.floor(4 * F.log2("norm"))).otherwise(-1).cast("int")
    largest = F.slice(F.sort_array(F.transform("v", lambda c, i: F.struct(F.abs(c).alias("a"), (2 * i + (c < 0).cast("int")).cast("long").alias("i"))), asc=False), 1, 2)
    marked = vectors.withColumn("level", level).withColumn("_two", largest)
    marked = marked.withColumn("lead", F.col("_two")[0]["i"] * 2 * F.col("dim") + F.coalesce(F.get("_two", F.lit(1))["i"], F.lit(0))).drop("_two")
    rows = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    plan = marked.groupBy("dim", "level", "lead").agg(F.count("*").alias("n")).withColumn("rows", rows).withColumn("own", 4 * F.col("n") >= F.col("rows"))
    order = Window.partitionBy("dim", "level", "own").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)  # a row a pair of coordinates
    plan = plan.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    plan = plan.select(F.col("dim").alias("d"), F.col("level").alias("l"), F.col("lead").alias("c"), "n", "before", "rows", "own")
    marked = marked.join(plan, (F.col("dim") == F.col("d")) & (F.col("level") == F.col("l")) & (F.col("lead") == F.col("c")))
    share = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)  # an id may have many rows
    alone = (F.col("lead") + 1) * F.lit(1 << 32) + F.floor(share * F.ceil(F.col("n") / F.col("rows")))
    part = F.when(F.col("own"), alone).otherwise(F.floor((F.col("before") + F.floor(share * F.col("n"))) / F.col("rows"))).cast("long")

    def gather(key, table):
        norms = table.column("norm").to_numpy()
        order = np.lexsort((table.column("id").to_numpy(), -norms))
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)
        unit = _unit(flat, norms)
        centre = unit.mean(0)
        size = np.sqrt(centre @ centre)
        centre = centre / size if size > 0 else centre
        spread = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) if size > 0 and norms.min() > 0 else np.pi
        packed = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table({
            "level": table.column("level").slice(0, 1), "part": table.column("part").slice(0, 1), "dim": table.column("dim").slice(0, 1), "top": pa.array([float(norms.max())]), "centre": packed(centre), "spread": pa.array([spread + 1e-6]), "n": pa.array([len(order)]),
            "ids": packed(table.column("id").to_numpy()[order]), "matrix": packed(flat[order]), "norms": packed(norms[order]),
        })

    grouped = marked.select("id", "v", "dim", "norm", "level", part.alias("part")).groupBy("dim", "level", "part")
    return grouped.applyInArrow(gather, "level int, part long, dim int, top double, centre binary, spread double, n long, ids binary, matrix binary, norms binary")


def _exact(matrix: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    return (matrix.astype(float) @ q.astype(float)).astype(np.int64) if bound < 2**53 else matrix @ q


def search_block(q: np.ndarray, q_id: int, q_norm: float, floor: float, k: int, ids: np.ndarray, matrix: np.ndarray, norms: np.ndarray, unit: np.ndarray, focus: int, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block for a query that needs a score of `floor` at least: ids and scores."""
    top = float(norms[0])
    need = floor / (q_norm * top) if q_norm * top > 0 else -np.inf if floor <= 0 else np.inf
    if need > 1 + 1e-9:
        return ids[:0], ids[:0]
    if need < switch:  # by length: vectors too short for the floor are a suffix
        n = len(ids) if floor <= 0 else int(np.searchsorted(-norms, -floor / q_norm * (1 - 1e-9), side="right"))
        rows = np.arange(n)
    else:  # by the coordinates where the query is largest
        f = np.argsort(-np.abs(q), kind="stable")[:focus]
        part = unit[:, f]
        rest_q = np.sqrt(max(0.0, 1 - float((q[f] / q_norm) @ (q[f] / q_norm))))
        bound = part @ (q[f] / q_norm) + rest_q * np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", part, part)))
        rows = np.flatnonzero(bound * norms * q_norm >= floor - 1e-9 * abs(floor) - 1e-6)
    rows = rows[ids[rows] != q_id]
    score = _exact(matrix[rows], q, top * q_norm)
    if len(rows) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        ok = score >= least
        rows, score = rows[ok], score[ok]
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][order], score[order]


def _load(batch, i: int, prefix: str):
    ids = np.frombuffer(batch.column(prefix + "ids")[i].as_buffer(), np.int64)
    norms = np.frombuffer(batch.column(prefix + "norms")[i].as_buffer(), np.float64)
    return ids, np.frombuffer(batch.column(prefix + "matrix")[i].as_buffer(), np.int64).reshape(len(ids), -1), norms


def _unit(matrix, norms):
    return matrix / np.where(norms > 0, norms, 1)[:, None]


def _in_waves(base: DataFrame, first: int) -> DataFrame:
    """(dim, level, part, top, centre, spread, wave): what is known of blocks without their vectors. Wave 0 has the longest ones, up to `first`
    vectors, and each later wave as many vectors as all before it."""
    longest = Window.partitionBy("dim").orderBy(F.col("top").desc(), "level", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = F.coalesce(F.sum("n").over(longest), F.lit(0))
    return base.select("dim", "level", "part", "top", "centre", "spread", F.floor(F.log2(F.greatest(F.lit(1.0), 2 * before / F.lit(first)))).cast("int").alias("wave"))


def _in_chunks(known: DataFrame) -> DataFrame:
    """Blocks of a wave, CHUNK to a row: their names, lengths and directions as arrays."""
    chunk = F.floor((F.row_number().over(Window.partitionBy("dim", "wave").orderBy("level", "part")) - 1) / CHUNK).alias("chunk")
    return known.withColumn("chunk", chunk).groupBy("dim", "wave", "chunk").agg(F.collect_list(F.struct("level", "part", "top", "spread", "centre")).alias("blocks"))


_NAMES = "q_block string, dim int, level int, part long, near double"


def block_pairs(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_block, dim, level, part, near): of each query block (with q_floors) the vector blocks whose bound reaches the floor of one of its queries,
    and the greatest cosine of a query with the block's direction. The stated queries against all rows, in blocks; rows here are
    names of blocks without vectors."""

    def meet(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                blocks = batch.column("blocks")[i].values
                q_norms, floor = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64) for c in ("q_norms", "q_floors"))
                q = np.frombuffer(batch.column("q_matrix")[i].as_buffer(), np.int64).reshape(len(q_norms), -1)
                centre = np.stack([np.frombuffer(x, np.float64) for x in blocks.field("centre").to_pylist()])
                top, spread = (blocks.field(c).to_numpy() for c in ("top", "spread"))
                cosine = np.clip(_unit(q, q_norms) @ centre.T, -1, 1)
                bound = q_norms[:, None] * top * np.cos(np.maximum(0, np.arccos(cosine) - spread)).clip(min=0)
                fine = np.flatnonzero((bound * (1 + 1e-9) + 1e-6 >= floor[:, None]).any(0))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("q_block")[i].as_py()] * len(fine), pa.string()), pa.array(np.full(len(fine), batch.column("dim")[i].as_py()), pa.int32()), blocks.field("level").take(pa.array(fine)), blocks.field("part").take(pa.array(fine)), pa.array(cosine.max(0)[fine])], ["q_block", "dim", "level", "part", "near"])

    met = asked.select("q_block", "q_dim", "q_matrix", "q_norms", "q_floors").join(chunks, F.col("q_dim") == F.col("dim"))
    return met.select("q_block", "dim", "q_matrix", "q_norms", "q_floors", "blocks").mapInArrow(meet, _NAMES)


def _verified(pairs: DataFrame, asked: DataFrame, base: DataFrame, k: int, focus: int, switch: float) -> DataFrame:
    """(q_block, nth, query_id, vec_id, score): the k best of each paired block for each query, if they reach its floor."""

    def verify(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, matrix, norms), (q_ids, q_matrix, q_norms) = _load(batch, i, ""), _load(batch, i, "q_")
                unit, floor = _unit(matrix, norms), np.frombuffer(batch.column("q_floors")[i].as_buffer(), np.float64)
                best = [search_block(q, qi, qn, fl, k, ids, matrix, norms, unit, focus, switch) for q, qi, qn, fl in zip(q_matrix, q_ids, q_norms, floor, strict=True)]
                sizes = [len(b[0]) for b in best]
                name = pa.array([batch.column("q_block")[i].as_py()] * sum(sizes), pa.string())
                yield pa.RecordBatch.from_pydict({"q_block": name, "nth": pa.array(np.repeat(np.arange(len(q_ids), dtype=np.int32), sizes)), "query_id": pa.array(np.repeat(q_ids, sizes)), "vec_id": pa.array(np.concatenate([b[0] for b in best])), "score": pa.array(np.concatenate([b[1] for b in best]).astype(np.int64))})

    wanted = pairs.select("q_block", F.col("dim").alias("d"), F.col("level").alias("lv"), F.col("part").alias("pt")).join(asked.drop("q_dim"), "q_block")
    met = wanted.join(base, (F.col("dim") == F.col("d")) & (F.col("lv") == F.col("level")) & (F.col("pt") == F.col("part")))
    return met.select("q_block", "ids", "matrix", "norms", "q_ids", "q_matrix", "q_norms", "q_floors").mapInArrow(verify, "q_block string, nth int, query_id long, vec_id long, score long")


def _floored(asked: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """Query blocks with `q_floors`, the k-th score of each query so far, or minus infinity."""
    names = ["q_block", "q_dim", "q_ids", "q_matrix", "q_norms"]
    least = None
    if found is not None:
        full = found.groupBy("q_block", "nth").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
        least = full.groupBy("q_block").agg(F.collect_list(F.struct("nth", "least")).alias("known"))  # a query block has a bounded number of queries

    def fill(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                floor = np.full(len(batch.column("q_norms")[i].as_buffer()) // 8, -np.inf)
                for x in batch.column("known")[i].as_py() or ():
                    floor[x["nth"]] = x["least"]
                out.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "q_floors"])

    known = asked.join(least, "q_block", "left") if least is not None else asked.withColumn("known", F.lit(None).cast("array<struct<nth:int,least:double>>"))
    return known.select(*names, "known").mapInArrow(fill, "q_block string, q_dim int, q_ids binary, q_matrix binary, q_norms binary, q_floors binary")


def top_k(rows: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = BLOCK, query_block: int = QUERY_BLOCK, focus: int = FOCUS, switch: float = SWITCH, told: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query. `told` gets the number of pairs of blocks of each wave."""
    base = tx.cut(_blocks(integers(rows, vec_id, vector), block))
    asked = tx.cut(_blocks(integers(queries, vec_id, vector), query_block).select(F.concat_ws("/", "dim", "level", "part").alias("q_block"), F.col("dim").alias("q_dim"), *[F.col(c).alias("q_" + c) for c in ("ids", "matrix", "norms")]))
    known = tx.cut(_in_waves(base, max(2 * block, 8 * k)))
    chunks = tx.cut(_in_chunks(known))
    waves = known.agg(F.max("wave")).first()[0]
    best = F.row_number().over(Window.partitionBy("q_block", "nth").orderBy(F.col("score").desc(), "vec_id"))
    found, near = None, None
    for wave in range(0 if waves is None else waves + 1):
        floored = tx.cut(_floored(asked, found, k))
        if wave == 0 and waves:
            every = block_pairs(floored, chunks)
            first = every.join(known.where("wave = 0").select("dim", "level", "part"), ["dim", "level", "part"], "left_semi").select("q_block", "dim", "level", "part")
            closest = every.groupBy("q_block").agg(F.max_by(F.struct("dim", "level", "part"), F.struct("near", "level", "part")).alias("b")).select("q_block", "b.*")
            near = tx.cut(closest)
            pairs = first.unionByName(near).distinct()
        else:
            pairs = block_pairs(floored, chunks.where(F.col("wave") == wave)).drop("near")
            if near is not None:
                pairs = pairs.join(near, ["q_block", "dim", "level", "part"], "left_anti")
        pairs = tx.cut(pairs)
        if told is not None:
            told.append(pairs.count())
        more = _verified(pairs, floored, base, k, focus, switch)
        found = tx.cut((more if found is None else found.unionByName(more)).withColumn("_place", best).where(F.col("_place") <= k).drop("_place"))
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
QUERIES = {"op10_top_k": op10_top_k}
ORACLES = {"op10_top_k": OP10_SQL}
