"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words; every document of it expects target / source size copies. Documents are
put in a fixed order (size class, hash of id and size, size, id), the expected copies are summed along that order, one
offset drawn per source is added, and a document is taken once for each whole number its stretch crosses.
The order by size class makes each source's words come near the target. Running positions come from counts of
small cells, ranges of the hash whose number follows the number of documents, plus a row number within a cell, so no
task holds a whole source or class of size.

Null text has size 0; the null source is a source of its own, last in order. Rows with equal ids are separate
documents; of rows equal in source, size and id any may be taken. An empty table gives no rows. Where all sizes are 0,
targets and copies are 0. All columns pass through whatever their names; a column named `mix` gives way to the result.
Targets are worked out in one window over all sources, which are few by their meaning (not hosts).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, 17
#: Cells are classes of size, an eighth of a doubling each, by ranges of a hash: so many of these at least, and rows of one on average beyond that.
CELLS, CELL_ROWS = 64, 50_000


def size_of(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(tx.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`sources` (source, source_size) with `target`: `share` of all sizes by weight, none above `cap` times its size.

    Sources stop at their cap in the order of cap / weight; the first that keeps below its part fixes the level
    of all later ones. Sources are few by their meaning, so one window over them is enough.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1).cast("double"))
    at = everything.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    limit = cap * F.col("source_size").cast("double")
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("_w").over(at.rowsBetween(0, Window.unboundedFollowing))
    found = weighed.withColumn("_level", level).withColumn("_open", limit > F.col("_w") * F.col("_level"))
    first = F.min_by("_level", F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("_w"), F.col("source").isNull(), "source"))).over(everything)
    return found.select("source", "source_size", F.when(limit > F.col("_w") * first, F.col("_w") * first).otherwise(limit).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """`docs` with source_size, target, expected and copies added (all under a struct `mix`)."""
    names = [c for c in docs.columns if c != "mix"]
    wide = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs[doc_id].alias("id"), docs[source].alias("source"), docs[size].alias("size"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "size", "id")), 1, 8), 16, 10).cast("long")
    step = F.lit((1 << 32) // (CELLS << (wide.count() // (CELLS * CELL_ROWS)).bit_length()))
    marked = wide.select("*", F.floor(8 * F.log2(F.col("size") + F.lit(1.0)) + 1e-9).cast("int").alias("class"), hashed.alias("hash"), F.floor(hashed / step).alias("cell"))
    counts = tx.cut(marked.groupBy("source", "class", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap).select(F.col("source").alias("s"), "source_size", "target")
    before = lambda n, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n")).select(F.col("source").alias("s2"), F.col("class").alias("c2"), before("n", "source", "class").alias("of_class"))
    cells = counts.select("source", "class", "cell", before("n", "source", "class", "cell").alias("of_cell"))
    cells = cells.join(classes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2"))).join(goal, F.col("source").eqNullSafe(F.col("s")))
    cells = cells.select(F.col("source").alias("s3"), F.col("class").alias("c3"), F.col("cell").alias("b3"), (F.col("of_class") + F.col("of_cell")).alias("before"), "source_size", "target")
    joined = marked.join(cells, F.col("source").eqNullSafe(F.col("s3")) & (F.col("class") == F.col("c3")) & (F.col("cell") == F.col("b3")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("s3", "c3", "b3").orderBy("hash", "size", "id"))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("double") / math.ldexp(1, 32)
    out = joined.select("row", "source_size", "target", place.alias("place"), rate.alias("rate"), offset.alias("offset"))
    copies = F.floor(F.col("offset") + F.col("place") * F.col("rate")) - F.floor(F.col("offset") + (F.col("place") - 1) * F.col("rate"))
    found = F.struct("source_size", "target", F.col("rate").alias("expected"), F.least(copies, F.lit(int(math.ceil(cap)))).cast("long").alias("copies"))
    return out.select("row", found.alias("found")).select(*[F.col("row")[c].alias(c) for c in names], F.col("found").alias("mix"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", size_of("text").alias("size"))
    return mix(tx.cut(docs)).select("doc_id", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"), "mix.expected", "mix.copies")


OP2_SQL = rf"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{tx.WORD}')), 0) as bigint) as size from documents),
m as (select *, cast(floor(8 * log2(size + 1.0::double) + 1e-9) as int) as c, cast('0x' || substr(md5(concat_ws(':', size, doc_id)), 1, 8) as bigint) as h from d),
p as (select *, row_number() over (partition by source order by c, h, size, doc_id) as place from m),
s as (select source, cast(sum(size) as double) as source_size from d group by source),
w as (select *, cast([3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as w from s),
l as (select *, (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
   / sum(w) over (order by source_size / w, source nulls last rows between current row and unbounded following) as level from w),
f as (select level from l where 2 * source_size > w * level order by source_size / w, source nulls last limit 1),
t as (select source, source_size, case when 2 * source_size > w * (select level from f) then w * (select level from f) else 2 * source_size end as target,
   cast(cast('0x' || substr(md5('17:' || coalesce(source, 'null')), 1, 8) as bigint) as double) / 4294967296.0::double as u from l),
r as (select p.doc_id, p.size, cast(source_size as bigint) as source_size, target, coalesce(target / nullif(source_size, 0), 0) as expected, u, place from p join t on p.source is not distinct from t.source)
select doc_id, size, source_size, target, expected, cast(floor(u + place * expected) - floor(u + (place - 1) * expected) as bigint) as copies,
  size * cast(floor(u + place * expected) - floor(u + (place - 1) * expected) as bigint) as taken from r
"""
QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {"op2_mix_sources": OP2_SQL}
