"""Tables and exports behind a manifest: written beside what is there, and seen at once by one rename.

A root folder holds data folders and numbered manifests. A manifest names the folder of each part; it is written under
another name and renamed to its number, which fails where another writer was first. Readers take the highest number, so
they see all of a publication or none of it, whenever a writer stops (on file systems that rename a file at once). Manifests are small: names of exports, or of
ranges of a table, whose number is set when it is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..session import cut, shared_folder
from .ingest import EXPORTS, concat_frames, exports_of, keyed_replace, merge_labels

R = Registry()
C = F.col
#: Manifests, and the folders that only they name, that are kept for readers of earlier ones.
KEPT = 2


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests of a root, in order."""
    files, path = _files(spark, root)
    place = path(f"{root}/manifests")
    names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The manifest of a version, the latest by default; an empty one where nothing was published."""
    found = versions(spark, root)
    if not found:
        return {"version": 0, "parts": {}}
    at = found[-1] if version is None else version
    files, path = _files(spark, root)
    stream = files.open(path(f"{root}/manifests/{at}.json"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, old: dict, parts: dict, **more) -> dict:
    """Make `parts` the content of the root, if nothing was published since `old`; then drop what no kept manifest names."""
    new = {"version": old["version"] + 1, "parts": parts, **more}
    files, path = _files(spark, root)
    staged, place = path(f"{root}/manifests/.{uuid.uuid4().hex}"), path(f"{root}/manifests/{new['version']}.json")
    files.mkdirs(path(f"{root}/manifests"))
    stream = files.create(staged, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    if files.exists(place) or not files.rename(staged, place):
        files.delete(staged, False)
        raise RuntimeError(f"version {new['version']} of {root} was published by another writer")
    _drop_unnamed(spark, root)
    return new


def _drop_unnamed(spark: SparkSession, root: str) -> None:
    """Delete manifests but the last ones, and data folders that were named by deleted ones only. Folders that no manifest has named
    yet may belong to a writer at work and stay."""
    found = versions(spark, root)
    files, path = _files(spark, root)
    folders = lambda v: {p["folder"] for p in manifest(spark, root, v)["parts"].values()}
    kept = set().union(*(folders(v) for v in found[-KEPT:]))
    for v in found[:-KEPT]:
        for folder in folders(v) - kept:
            files.delete(path(f"{root}/{folder}"), True)
        files.delete(path(f"{root}/manifests/{v}.json"), False)


# ---- several exports at once -------------------------------------------------------------------------


def publish(frames: dict[str, DataFrame], root: str, columns: dict[str, list[str]] | None = None, step: Callable[[str], None] = lambda name: None) -> dict:
    """Publish exports together: each is written to a folder of its own and compared with its promised columns and with the rows that
    were written; then one rename shows them all. Exports that aren't in `frames` stay as they are. `step` is told each step."""
    spark = next(iter(frames.values())).sparkSession
    old = manifest(spark, root)
    parts = dict(old["parts"])
    for name, df in frames.items():
        if columns and df.columns != columns[name]:
            raise ValueError(f"columns {df.columns} of {name} are not {columns[name]}")
        folder, seen = f"data/{name}-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{root}/{folder}")
        step(f"{name} written")
        if spark.read.schema(df.schema).parquet(f"{root}/{folder}").count() != seen.get["rows"]:
            raise RuntimeError(f"the staged rows of {name} are not those of the export")
        step(f"{name} compared")
        parts[name] = {"folder": folder, "rows": seen.get["rows"], "schema": df.schema.json()}
    new = commit(spark, root, old, parts)
    step("published")
    return new


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def published(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The exports of one version: all from the same publication."""
    return {name: spark.read.schema(_schema(p["schema"])).parquet(f"{root}/{p['folder']}") for name, p in manifest(spark, root, version)["parts"].items()}


# ---- tables in ranges of their key -------------------------------------------------------------------


def _range_of(key: Column, lows: list, kind: str) -> Column:
    """Number of the range a key falls in: those that begin at or below it, less one; the first also holds what is below, and nulls."""
    begins = F.array(*[F.lit(x).cast(kind) for x in lows])
    return F.greatest(F.size(F.filter(begins, lambda b: b.isNull() | (b <= key))) - 1, F.lit(0))


def _write_ranges(rows: DataFrame, root: str) -> tuple[str, list[int]]:
    """Rows with `_range` written to a new data folder, a folder each; and the ranges that are there."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy("_range").parquet(f"{root}/{folder}")
    files, path = _files(rows.sparkSession, f"{root}/{folder}")
    found = [f.getPath().getName() for f in files.listStatus(path(f"{root}/{folder}"))]
    return folder, sorted(int(n.removeprefix("_range=")) for n in found if n.startswith("_range="))


def create(df: DataFrame, root: str, key: str, parts: int) -> dict:
    """A table of `df` in `parts` ranges of `key`, a column whose values JSON can hold (numbers, text); equal keys share a range."""
    kind = dict(df.dtypes)[key]
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))
    lows = dict(ranged.groupBy("_range").agg(F.min(key)).collect())  # one row a range
    numbered = {r: i for i, r in enumerate(sorted(lows))}
    renamed = F.create_map(*[F.lit(x) for r, i in numbered.items() for x in (r, i)])[C("_range")] if numbered else C("_range")
    folder, there = _write_ranges(ranged.withColumn("_range", renamed), root)
    found = {str(i): {"folder": f"{folder}/_range={i}"} for i in there}
    return commit(df.sparkSession, root, manifest(df.sparkSession, root), found, key=key, kind=kind, schema=df.schema.json(), lows=[lows[r] for r in sorted(lows)])


def table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    m = manifest(spark, root, version)
    return spark.read.schema(_schema(m["schema"])).parquet(*[f"{root}/{p['folder']}" for p in m["parts"].values()])


def rewrite(incoming: DataFrame, root: str, keys: list[str], combine: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = keyed_replace) -> dict:
    """`combine(current, incoming, keys)` for the ranges that hold a key of `incoming`; files of the other ranges are neither read nor written.

    `keys` begins with the key of the ranges. Without incoming rows nothing is published. The new ranges are seen at once.
    """
    spark = incoming.sparkSession
    old = manifest(spark, root)
    schema, place = _schema(old["schema"]), _range_of(C(keys[0]), old["lows"], old["kind"])
    new = cut(incoming.withColumn("_range", place))
    touched = sorted(r["_range"] for r in new.select("_range").distinct().collect())  # at most one row a range
    if not touched:
        return old
    current = spark.read.schema(schema).parquet(*[f"{root}/{old['parts'][str(i)]['folder']}" for i in touched])
    rows = combine(current, new.drop("_range"), keys).withColumn("_range", place)
    folder, there = _write_ranges(rows.repartition(len(touched), "_range"), root)
    parts = {k: p for k, p in old["parts"].items() if int(k) not in touched} | {str(i): {"folder": f"{folder}/_range={i}"} for i in there}
    return commit(spark, root, old, parts, **{k: old[k] for k in ("key", "kind", "schema", "lows")})


# ---- fingerprints by partition -----------------------------------------------------------------------


def text_hash(columns: list[str]) -> Column:
    """60 bits of the md5 of a row's values as text; null is told from empty text."""
    row = F.concat_ws("|", *[F.coalesce(C(c).cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint_tree(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(part, row_count, content_hash): a leaf for each value of `by`, and the root (part null): its leaves' sums.

    Sums don't depend on the order of rows or on partitions. A null value of `by` is the leaf `\\N`. Hashes are of values as
    text, so whatever engine writes numbers alike can compare them.
    """
    part = F.coalesce(C(by).cast("string"), F.lit("\\N"))
    leaves = df.groupBy(part.alias("part")).agg(F.count("*").alias("row_count"), F.sum(text_hash(columns)).cast("decimal(38,0)").alias("content_hash"))
    leaves = cut(leaves)
    root = leaves.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), F.sum("content_hash").cast("decimal(38,0)").alias("content_hash"))
    return root.select(F.lit(None).cast("string").alias("part"), "row_count", "content_hash").unionByName(leaves)


def partition_plan(now: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(part, action) of two trees: `publish` leaves that are new or differ, `drop` those that are gone. Where the roots agree there is nothing to do,
    unless forced."""
    leaf = lambda df, p: df.where("part is not null").select(*[C(c).alias(p + c) for c in ("part", "row_count", "content_hash")])
    both = leaf(now, "n_").join(leaf(stored, "s_"), C("n_part") == C("s_part"), "full")
    same = C("n_row_count").eqNullSafe(C("s_row_count")) & C("n_content_hash").eqNullSafe(C("s_content_hash"))
    action = F.when(C("n_part").isNull(), "drop").when(F.lit(force) | ~same, "publish")
    return both.select(F.coalesce("n_part", "s_part").alias("part"), action.alias("action")).where("action is not null")


# ---- queries -----------------------------------------------------------------------------------------

_SMALL = ("runs", "days", "weeks", "dashboard_summary")


def _published_together(t) -> DataFrame:
    """Four exports published, then two of them again without some rows: readers get one version of all four."""
    root = shared_folder(t.spark)
    made = {n: exports_of(t, n)[n] for n in _SMALL}
    publish(made, root, EXPORTS)
    publish({"runs": made["runs"].where("run_id % 2 = 0"), "days": made["days"].where("run_count > 0")}, root, EXPORTS)
    return concat_frames([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("export_name"), "n") for name, df in published(t.spark, root).items()])


def _export_counts() -> str:
    from .ingest import R as ingest

    where = {"runs": " where run_id % 2 = 0", "days": " where run_count > 0"}
    return " union all ".join(f"select '{n}' as export_name, count(*) as n from ({ingest.oracles[f'SRC19_export_{n}']}) x{where.get(n, '')}" for n in _SMALL)


R.query("SRC22_published_together", _export_counts())(_published_together)


def _rewritten(t) -> DataFrame:
    root = shared_folder(t.spark)
    lines = t.lineitem.select("l_orderkey", "l_linenumber", C("l_quantity").alias("q"))
    create(lines, root, "l_orderkey", 16)
    rewrite(lines.where("l_orderkey between 100 and 900 and l_orderkey % 4 = 0").withColumn("q", F.lit(0.0)), root, ["l_orderkey"])
    return table(t.spark, root)


R.query("SRC15_replaced_ranges", "select l_orderkey, l_linenumber, case when l_orderkey between 100 and 900 and l_orderkey % 4 = 0 then 0.0 else l_quantity end as q from lineitem")(_rewritten)


def _merged(t) -> DataFrame:
    root = shared_folder(t.spark)
    create(t.customer.select(C("c_custkey").alias("k"), C("c_name").alias("v")), root, "k", 8)
    rewrite(t.supplier.select((C("s_suppkey") * 40).alias("k"), C("s_name").alias("v")), root, ["k"], merge_labels)
    return table(t.spark, root)


R.query("SRC24_merged_ranges", "select coalesce(c_custkey, k) as k, case when k is not null then v else c_name end as v from customer full join (select s_suppkey * 40 as k, s_name as v from supplier) s on c_custkey = k")(_merged)

_PRINTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_SQL_HASH = "cast(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, coalesce(o_orderstatus, '\\N'), coalesce(o_orderpriority, '\\N'))), 1, 15)) as bigint)"


def _months(t, rows: DataFrame | None = None) -> DataFrame:
    return fingerprint_tree((t.orders if rows is None else rows).withColumn("month", F.date_format(C("o_orderdate").cast("date"), "yyyy-MM")), "month", _PRINTED)


R.query("SRC20_fingerprint_tree", f"""with x as (select strftime(cast(o_orderdate as date), '%Y-%m') as part, {_SQL_HASH} as h from orders)
 select part, count(*) as row_count, cast(sum(h) as varchar) as content_hash from x group by part union all select null, count(*), cast(sum(h) as varchar) from x""")(
    lambda t: _months(t).withColumn("content_hash", C("content_hash").cast("string")))
R.query("SRC21_partition_plan", """select strftime(cast(o_orderdate as date), '%Y-%m') as part, case when min(cast(o_orderdate as date)) >= date '1998-01-01' then 'drop' else 'publish' end as action from orders
 where (o_orderkey % 501 = 0 and o_orderdate < '1997-01-01') or cast(o_orderdate as date) >= date '1998-01-01' group by 1""")(
    lambda t: partition_plan(_months(t, t.orders.where("cast(o_orderdate as date) < '1998-01-01'").withColumn("o_orderpriority", F.when((C("o_orderkey") % 501 == 0) & (C("o_orderdate").cast("date") < "1997-01-01"), "x").otherwise(C("o_orderpriority")))), _months(t)))
