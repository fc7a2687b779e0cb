"""Incremental ingest: discovery, change plans, alignment, keyed replace, validation, exports, fingerprints.

Plans stay DataFrames: nothing is collected to decide what changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import degrees
from ..registry import Registry
from ..session import shared_folder

R = Registry()
C = F.col
_day = lambda c="o_orderdate": C(c).cast("date")


# ---- discovery -------------------------------------------------------------------------------------


def discover_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, key, size, mtime) of the files under a path, by listing only: contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("key"), C("length").alias("size"), C("modificationTime").alias("mtime"))


R.query("SRC01_discover_files")(lambda t: discover_files(t.spark, t.folder).select("key", "size"))
PAYLOAD_KINDS = ("click", "error", "purchase", "signup", "view")


def discover_payloads(paths: DataFrame, kinds: tuple[str, ...] = PAYLOAD_KINDS) -> DataFrame:
    """(path, calendar_date, payload_type, problem) of paths `calendar_date=YYYY-MM-DD/{type}.json`; what doesn't fit says why."""
    date = F.regexp_extract("path", r"calendar_date=([^/]+)/", 1)
    kind = F.regexp_extract("path", r"/([^/]+)\.json$", 1)
    day = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date.try_cast("date"))
    problem = F.when(day.isNull(), "bad_partition").when(~kind.isin(*kinds), "bad_type")
    return paths.select("path", day.alias("calendar_date"), kind.alias("payload_type"), problem.alias("problem"))


_PATHS = "concat('/land/calendar_date=', case when event_id % 50 = 0 then 'broken' else cast(cast(ts as date) as varchar) end, '/', case when event_id % 33 = 0 then 'other' else event_type end, '.json')"
R.query("SRC02_discover_payloads", f"select path, case when event_id % 50 > 0 then d end as calendar_date, case when event_id % 33 = 0 then 'other' else event_type end as payload_type, case when event_id % 50 = 0 then 'bad_partition' when event_id % 33 = 0 then 'bad_type' end as problem from (select *, cast(ts as date) as d, {_PATHS} as path from events) x")(
    lambda t: discover_payloads(t.events.select(F.concat(F.lit("/land/calendar_date="), F.when(C("event_id") % 50 == 0, "broken").otherwise(_day("ts").cast("string")), F.lit("/"), F.when(C("event_id") % 33 == 0, "other").otherwise(C("event_type")), F.lit(".json")).alias("path"))))


def check_envelopes(payloads: DataFrame) -> DataFrame:
    """Payloads (calendar_date, payload_type, raw) with what in the text disagrees with the place it was found at, or null."""
    says = lambda k: F.get_json_object("raw", f"$.{k}")
    problem = F.when(~F.coalesce(C("raw").rlike(r"^\s*\{"), F.lit(False)) | F.json_object_keys("raw").isNull(), "not_an_object").when(~says("calendar_date").eqNullSafe(C("calendar_date").cast("string")), "date_differs").when(~says("payload_type").eqNullSafe(C("payload_type")), "type_differs")
    return payloads.withColumn("problem", problem)


R.query("SRC03_check_envelopes", "select event_id, case when event_id % 17 = 0 then 'not_an_object' when event_id % 13 = 0 then 'date_differs' when event_id % 11 = 0 then 'type_differs' end as problem from events")(
    lambda t: check_envelopes(t.events.select("event_id", _day("ts").alias("calendar_date"), C("event_type").alias("payload_type"), F.when(C("event_id") % 17 == 0, "[1, 2]").otherwise(F.to_json(F.struct(
        F.when(C("event_id") % 13 == 0, "1999-01-01").otherwise(_day("ts").cast("string")).alias("calendar_date"), F.when(C("event_id") % 11 == 0, "zzz").otherwise(C("event_type")).alias("payload_type"), "props"))).alias("raw"))).select("event_id", "problem"))


def lenient_instant(text):
    """Timestamp of ISO text, with Z or an offset; what can't be read is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


R.query("SRC04_lenient_instant", "select event_id, case when event_id % 9 > 0 then cast(date_trunc('second', ts) as timestamp) end as at from events")(
    lambda t: t.events.select("event_id", lenient_instant(F.when(C("event_id") % 9 == 0, "yesterday").otherwise(F.concat(F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))).alias("at")))

# ---- incremental change ----------------------------------------------------------------------------


def change_plan(source: DataFrame, existing: DataFrame, keys: list[str], full_refresh: bool = False) -> DataFrame:
    """`source` (keys, size, mtime) with `action`: parse (new), changed (size or time differs, or no time is known) or skipped."""
    old = existing.select(*[C(k).alias("_" + k) for k in keys], C("size").alias("_size"), C("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    both = source.join(old, [C(k) == C("_" + k) for k in keys], "left")
    differs = ~C("size").eqNullSafe(C("_size")) | C("mtime").isNull() | ~C("mtime").eqNullSafe(C("_mtime"))
    action = F.when(C("_known").isNull(), "parse").when(F.lit(full_refresh) | differs, "changed").otherwise("skipped")
    return both.select(*source.columns, action.alias("action"))


def existing_manifest(spark: SparkSession, table: str, keys: str = "key string", path: bool = False) -> DataFrame:
    """(key, size, mtime) that a table already holds; empty where the table doesn't exist."""
    schema = T._parse_datatype_string(f"{keys}, size long, mtime timestamp")
    if not path and not spark.catalog.tableExists(table):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(table) if path else spark.table(table)
    return rows.select(*schema.names).distinct()


_SNAP = lambda t: t.orders.where("o_orderkey % 10 > 0").select(C("o_orderkey").alias("key"), F.when(C("o_orderkey") % 7 == 0, 1.0).otherwise(C("o_totalprice")).alias("size"), F.when(C("o_orderkey") % 11 == 0, None).otherwise(_day()).alias("mtime"))
R.query("SRC05_change_plan", "select o_orderkey as key, case when o_orderkey % 10 = 0 then 'parse' when (o_orderkey % 7 = 0 and o_totalprice <> 1) or o_orderkey % 11 = 0 then 'changed' else 'skipped' end as action from orders")(
    lambda t: change_plan(t.orders.select(C("o_orderkey").alias("key"), C("o_totalprice").alias("size"), _day().alias("mtime")), _SNAP(t), ["key"]).select("key", "action"))


def _manifest(t):
    path = shared_folder(t.spark)
    t.orders.select(C("o_orderkey").alias("key"), C("o_custkey").alias("size"), C("o_orderdate").cast("timestamp").alias("mtime"), "o_totalprice").write.parquet(path)
    return existing_manifest(t.spark, path, "key long", path=True).unionByName(existing_manifest(t.spark, "no_such_table", "key long"))


R.query("SRC06_existing_manifest", "select distinct o_orderkey as key, o_custkey as size, cast(o_orderdate as timestamp) as mtime from orders")(_manifest)


def attach_metadata(sessions: DataFrame, children: DataFrame, key: str, start: str) -> DataFrame:
    """Children with the run date of their session, many to one; a session key that occurs twice is an error when the query runs."""
    one = sessions.groupBy(key).agg(F.min(start).cast("date").alias("run_date"), F.count("*").alias("_n"))
    one = one.withColumn("run_date", F.when(C("_n") > 1, F.raise_error(F.lit("a session occurs twice"))).otherwise(C("run_date"))).drop("_n")
    return children.join(one, key, "left")


R.query("SRC07_attach_metadata", "select l_orderkey as k, l_linenumber, l_partkey, cast(o_orderdate as date) as run_date from lineitem left join orders on l_orderkey = o_orderkey")(
    lambda t: attach_metadata(t.orders.select(C("o_orderkey").alias("k"), "o_orderdate"), t.lineitem.select(C("l_orderkey").alias("k"), "l_linenumber", "l_partkey"), "k", "o_orderdate"))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema in its order: missing ones null, extra ones gone."""
    return df.select([(C(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


R.query("SRC08_align", "select cast(o_orderkey as bigint) as o_orderkey, cast(null as varchar) as sport, o_totalprice from orders")(
    lambda t: align(t.orders, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("sport", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])))


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """All frames under each other by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


R.query("SRC09_concat", "select c_custkey as id, c_name as name, cast(null as double) as bal from customer union all select s_suppkey, s_name, s_acctbal from supplier")(
    lambda t: concat_frames([t.customer.select(C("c_custkey").alias("id"), C("c_name").alias("name")), t.supplier.select(C("s_suppkey").alias("id"), C("s_name").alias("name"), C("s_acctbal").alias("bal")), t.supplier.where("false").select(C("s_suppkey").alias("id"))]))
R.query("SRC10_degrees", "select event_id, round(try_cast(x as double) * (180.0 / 2147483648), 9) as deg from (select event_id, case when event_id % 5 = 0 then 'n/a' else cast(event_id * 1000003 as varchar) end as x from events) y")(
    lambda t: t.events.select("event_id", F.when(C("event_id") % 5 == 0, "n/a").otherwise((C("event_id") * 1000003).cast("string")).alias("x")).select("event_id", F.round(degrees(C("x")), 9).alias("deg")))
R.query("SRC11_keep_events", "select event_id, event_type from events where event_type in ('signup', 'error')")(lambda t: t.events.where(C("event_type").isin("signup", "error")).select("event_id", "event_type"))


def declared_schema(roles: dict[str, list[str]], required: set[str]) -> T.StructType:
    """A schema from lists of column names by type; required columns are not nullable."""
    kinds = {"timestamp": T.TimestampType(), "double": T.DoubleType(), "long": T.LongType(), "date": T.DateType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k], n not in required) for k, names in roles.items() for n in names])


_ORDER_SCHEMA = lambda: declared_schema({"string": ["run_id", "sport"], "double": ["distance"], "date": ["run_date"]}, {"run_id", "run_date"})
R.query("SRC12_declared_schema", "select cast(o_orderkey as varchar) as run_id, cast(null as varchar) as sport, o_totalprice as distance, cast(o_orderdate as date) as run_date from orders")(
    lambda t: align(t.orders.select(C("o_orderkey").alias("run_id"), C("o_totalprice").alias("distance"), C("o_orderdate").alias("run_date")), _ORDER_SCHEMA()))


def as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text: text as it is, nested values as JSON, others by cast."""
    kind = dict(df.dtypes)
    return df.withColumns({c: F.to_json(c) if kind[c].startswith(("array", "struct", "map")) else C(c).cast("string") for c in columns})


R.query("SRC13_as_text", "select event_id, event_type as t, cast(user_id as varchar) as u, concat('{\"user_id\":', user_id, '}') as s from events")(
    lambda t: as_text(t.events.select("event_id", C("event_type").alias("t"), C("user_id").alias("u"), F.struct("user_id").alias("s")), ["t", "u", "s"]))


def write_partitioned(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Append, or overwrite only the partitions that `df` holds. Rows of a partition meet in a few files."""
    writer = df.repartition(*by, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(4))).write.partitionBy(*by)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("append")).parquet(path)


def _written(t):
    path = shared_folder(t.spark)
    first = t.orders.select("o_orderkey", "o_totalprice", F.trunc(_day(), "year").alias("y"))
    write_partitioned(first, path, ["y"])
    write_partitioned(first.where("year(y) = 1996").withColumn("o_totalprice", F.lit(0.0)), path, ["y"], overwrite=True)
    return t.spark.read.schema(first.schema).parquet(path).groupBy("y").agg(F.count("*").alias("n"), F.sum(C("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


R.query("SRC14_partitioned_write", "select cast(date_trunc('year', o_orderdate) as date) as y, count(*) as n, cast(sum(cast(case when year(o_orderdate) = 1996 then 0 else o_totalprice end as decimal(18,2))) as double) as total from orders group by 1")(_written)


def keyed_replace(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """`current` without the keys of `incoming`, and `incoming`: the same however often it is applied."""
    gone = incoming.select(*[C(k).alias("_" + k) for k in keys]).distinct()
    return current.join(gone, [C(k) == C("_" + k) for k in keys], "left_anti").unionByName(incoming.select(*current.columns))


R.query("SRC15_keyed_replace", "select l_orderkey, l_linenumber, case when l_orderkey % 4 = 0 then 0.0 else l_quantity end as q from lineitem")(
    lambda t: keyed_replace(t.lineitem.select("l_orderkey", "l_linenumber", C("l_quantity").alias("q")), t.lineitem.where("l_orderkey % 4 = 0").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("q")), ["l_orderkey"]))


def validate_batch(sessions: DataFrame, records: DataFrame, events: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(rule, level, n): how many rows or keys break each rule of a batch."""
    def count(df, rule, level):
        return df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "n")

    keys = lambda df: df.select(C(key).alias("_k"))
    return concat_frames([
        *[count(sessions.where(C(c).isNull()), f"{c}_null", "error") for c in required], count(sessions.groupBy(key).count().where("count > 1"), "duplicate_session", "error"),
        count(sessions.join(keys(records), C(key) == C("_k"), "left_anti"), "no_records", "error"), count(sessions.join(keys(events), C(key) == C("_k"), "left_anti"), "no_events", "warning"),
    ])


R.query("SRC16_validate_batch", """select 'o_custkey_null' as rule, 'error' as level, count(*) as n from orders where o_custkey is null union all select 'duplicate_session', 'error', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1) x
 union all select 'no_records', 'error', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem) union all select 'no_events', 'warning', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity = 7)""")(
    lambda t: validate_batch(t.orders, t.lineitem.select(C("l_orderkey").alias("o_orderkey")), t.lineitem.where("l_quantity = 7").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", ["o_custkey"]))


def canonical_json(column: str):
    """Text of a flat JSON object with keys in order; what isn't an object is null."""
    pairs = F.map_entries(F.from_json(column, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


R.query("SRC17_canonical_json", "select event_id, concat('{\"k\":\"', json_extract_string(props, '$.k'), '\"}') as j from events")(lambda t: t.events.select("event_id", canonical_json("props").alias("j")))
R.query("SRC18_ingest_metrics", "select count(*) as source_count, count(*) filter (where a = 'parse') as parsed, count(*) filter (where a = 'changed') as changed, count(*) filter (where a = 'skipped') as skipped from (select case when o_orderkey % 10 = 0 then 'parse' when (o_orderkey % 7 = 0 and o_totalprice <> 1) or o_orderkey % 11 = 0 then 'changed' else 'skipped' end as a from orders) x")(
    lambda t: change_plan(t.orders.select(C("o_orderkey").alias("key"), C("o_totalprice").alias("size"), _day().alias("mtime")), _SNAP(t), ["key"]).agg(F.count("*").alias("source_count"), *[F.count_if(C("action") == a).alias(n) for n, a in (("parsed", "parse"), ("changed", "changed"), ("skipped", "skipped"))]))

# ---- exports ---------------------------------------------------------------------------------------

#: Columns of the exports, in order.
EXPORTS = {
    "runs": ["run_id", "subject", "activity_date", "distance", "duration_seconds", "avg_heart_rate"], "days": ["subject", "calendar_date", "run_count", "distance"], "weeks": ["subject", "week_start_date", "run_count", "distance", "active_week_streak"],
    "fitness": ["run_id", "efficiency", "hr_band", "score"], "routes": ["route_id", "run_count", "avg_km", "start_lat", "start_lon"], "segments": ["run_id", "length_m", "segment", "distance_m", "seconds"], "map_profile": ["run_id", "record_index", "lat", "lon"], "dashboard_summary": ["subject", "run_count", "distance", "latest_run"],
}


def export(df: DataFrame, name: str) -> DataFrame:
    """The columns that an export promises, dates as text; a missing column is an error."""
    kind = dict(df.dtypes)
    return df.select([C(c).cast("string").alias(c) if kind[c] == "date" else C(c) for c in EXPORTS[name]])


def exports_of(t, only: str | None = None) -> dict[str, DataFrame]:
    from ..plans import reads, rollups, routes, segments, signals, telemetry

    made = {
        "runs": lambda: t.vnat.withColumn("distance", C("distance").cast("double")), "days": lambda: rollups.days_of(t), "weeks": lambda: rollups.weeks_of(t), "fitness": lambda: signals.fitness_signals(t.vnat), "routes": lambda: routes.routes(routes.clusters_of(t), t.vrun, t.vgeo, None, 5),
        "segments": lambda: segments.segments_of(t), "map_profile": lambda: telemetry.downsample_even(t.vgeo, 5), "dashboard_summary": lambda: reads.dashboard(t.vnat, rollups.days_of(t)),
    }
    return {n: export(f(), n) for n, f in made.items() if only in (None, n)}


def _sql_exports() -> dict[str, str]:
    from ..plans import reads, rollups, routes, segments, signals

    return {
        "routes": f"{routes.SUMMARY} select " + ", ".join(EXPORTS["routes"]) + " from su",
        "runs": "select run_id, subject, cast(activity_date as varchar) as activity_date, cast(distance as double) as distance, duration_seconds, avg_heart_rate from {vnat} v", "days": f"select subject, cast(calendar_date as varchar) as calendar_date, run_count, distance from {rollups.DAYS} d",
        "weeks": f"select subject, cast(week_start_date as varchar) as week_start_date, run_count, distance, active_week_streak from {rollups.WEEKS} w", "fitness": f"select run_id, efficiency, hr_band, score from {signals.FIT} f",
        "map_profile": "select run_id, record_index, lat, lon from (select *, count(*) over (partition by run_id) as n from {vgeo} r) x where n <= 5 or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1)",
        "segments": f"select run_id, length_m, segment, distance_m, seconds from {segments.SEG} s", "dashboard_summary": "select subject, run_count, distance, latest_run from (" + reads.R.oracles["RD09_dashboard"] + ") x",
    }


for _n in ("runs", "days", "weeks", "fitness", "routes", "map_profile", "segments", "dashboard_summary"):
    R.query(f"SRC19_export_{_n}", _sql_exports()[_n])(lambda t, n=_n: exports_of(t, n)[n])


def fingerprint(df: DataFrame) -> DataFrame:
    """(row_count, content_hash): the same in whatever order and partitions the rows are; null hash for an empty table."""
    return df.agg(F.count("*").alias("row_count"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content_hash"))


def fingerprints(frames: dict[str, DataFrame]) -> DataFrame:
    return concat_frames([fingerprint(df).select(F.lit(n).alias("export_name"), "row_count", "content_hash") for n, df in frames.items()])


_NAMED = lambda t: {n: getattr(t, n) for n in ("orders", "customer", "lineitem", "part")}
R.query("SRC20_fingerprints")(lambda t: fingerprints(_NAMED(t)))
R.query("SRC20_fingerprint_counts", " union all ".join(f"select '{n}' as export_name, count(*) as row_count from {n}" for n in ("orders", "customer", "lineitem", "part")))(lambda t: fingerprints({n: df.repartition(3) for n, df in _NAMED(t).items()}).select("export_name", "row_count"))


def publish_plan(now: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(export_name, publish): exports that are forced, have no fingerprint, or differ from what is stored."""
    old = stored.select(C("export_name").alias("_n"), C("row_count").alias("_c"), C("content_hash").alias("_h"))
    differs = C("content_hash").isNull() | ~C("content_hash").eqNullSafe(C("_h")) | ~C("row_count").eqNullSafe(C("_c"))
    return now.join(old, C("export_name") == C("_n"), "left").select("export_name", (F.lit(force) | differs).alias("publish"))


R.query("SRC21_publish_plan", "select 'orders' as export_name, false as publish union all select 'customer', true union all select 'lineitem', true union all select 'part', false")(
    lambda t: publish_plan(fingerprints(_NAMED(t)), fingerprints({"orders": t.orders.repartition(5), "customer": t.customer.where("c_custkey > 1"), "part": t.part})))


def checked_export(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Write to a staging folder, compare columns with what was promised and the rows written with those read, then rename into place."""
    spark = df.sparkSession
    if df.columns != columns:
        raise ValueError(f"columns {df.columns} are not {columns}")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(staging)
    if spark.read.parquet(staging).count() != seen.get["rows"]:
        raise RuntimeError("the staged rows are not those of the export")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop(f"{staging}.old")
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), old)  # a crash leaves either export whole
    fs.rename(hadoop(staging), hadoop(path))
    fs.delete(old, True)
    return spark.read.parquet(path)


R.query("SRC22_checked_export", "select o_orderkey, o_totalprice from orders")(lambda t: checked_export(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], shared_folder(t.spark)))


def gazetteer(lines: DataFrame, countries: DataFrame, fields: int = 15) -> DataFrame:
    """Places from tab-separated lines: too few fields, bad numbers and impossible coordinates are left out; unknown countries keep their code."""
    parts = lines.select(F.split("value", "\t").alias("f")).where(F.size("f") >= fields)
    rows = parts.select(C("f")[1].alias("name"), C("f")[4].try_cast("double").alias("lat"), C("f")[5].try_cast("double").alias("lon"), C("f")[8].alias("code"), C("f")[14].try_cast("long").alias("population"))
    rows = rows.where(C("lat").between(-90, 90) & C("lon").between(-180, 180) & C("population").isNotNull())
    return rows.join(countries.select(C("code").alias("_c"), C("country").alias("_n")), C("code") == C("_c"), "left").select("name", "lat", "lon", "code", F.coalesce("_n", "code").alias("country"), "population")


_TSV = lambda t: t.supplier.select(F.concat_ws("\t", *[F.lit("x")] + [C("s_name")] + [F.lit("")] * 2 + [F.when(C("s_suppkey") % 8 == 0, "bad").otherwise((C("s_suppkey") % 120).cast("string")), (C("s_suppkey") % 300).cast("string")] + [F.lit("")] * 2 + [C("s_nationkey").cast("string")] + [F.lit("")] * 5, F.when(C("s_suppkey") % 9 > 0, C("s_suppkey").cast("string"))).alias("value"))
R.query("SRC23_gazetteer", "select s_name as name, cast(s_suppkey % 120 as double) as lat, cast(s_suppkey % 300 as double) as lon, cast(s_nationkey as varchar) as code, coalesce(n_name, cast(s_nationkey as varchar)) as country, cast(s_suppkey as bigint) as population from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20 where s_suppkey % 8 > 0 and s_suppkey % 9 > 0 and s_suppkey % 120 <= 90 and s_suppkey % 300 <= 180")(
    lambda t: gazetteer(_TSV(t), t.nation.where("n_nationkey < 20").select(C("n_nationkey").cast("string").alias("code"), C("n_name").alias("country"))))


def merge_labels(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both: source values where it has the key, even null ones, target's elsewhere."""
    values = [c for c in target.columns if c not in keys]
    s = source.select(*[C(c).alias("_" + c) for c in target.columns], F.lit(True).alias("_in"))
    both = target.join(s, [C(k) == C("_" + k) for k in keys], "full")
    return both.select(*[F.coalesce(k, "_" + k).alias(k) for k in keys], *[F.when(C("_in"), C("_" + v)).otherwise(C(v)).alias(v) for v in values])


R.query("SRC24_merge_labels", "select coalesce(n_nationkey, k) as k, case when k is not null then v else n_name end as v from nation full join (select r_regionkey * 10 as k, r_name as v from region) s on n_nationkey = k")(
    lambda t: merge_labels(t.nation.select(C("n_nationkey").alias("k"), C("n_name").alias("v")), t.region.select((C("r_regionkey") * 10).alias("k"), C("r_name").alias("v")), ["k"]))


def resume_range(existing: DataFrame, date: str, end: str) -> DataFrame:
    """Each date from the latest existing one (or the end, if that is earlier or nothing exists) to the end."""
    last = F.lit(end).cast("date")
    start = existing.agg(F.least(F.coalesce(F.max(C(date).cast("date")), last), last).alias("a"))
    return start.select(F.explode(F.sequence("a", last, F.expr("interval 1 day"))).alias("calendar_date"))


R.query("SRC25_resume_range", "select cast(unnest(generate_series(least(max(cast(o_orderdate as date)), date '2001-08-20')::timestamp, timestamp '2001-08-20', interval 1 day)) as date) as calendar_date from orders")(lambda t: resume_range(t.orders, "o_orderdate", "2001-08-20"))


def landing_gaps(dates: DataFrame, kinds: DataFrame, existing: DataFrame) -> DataFrame:
    """Wanted (date, kind) pairs that haven't landed; kinds are few."""
    return dates.crossJoin(kinds).join(existing.select(C("calendar_date").alias("_d"), C("kind").alias("_k")), (C("calendar_date") == C("_d")) & (C("kind") == C("_k")), "left_anti")


R.query("SRC26_landing_gaps", "select d as calendar_date, kind from (select distinct cast(ts as date) as d from events) a cross join (select distinct event_type as kind from events) b where not exists (select 1 from events where cast(ts as date) = d and event_type = kind and user_id % 13 = 0)")(
    lambda t: landing_gaps(t.events.select(_day("ts").alias("calendar_date")).distinct(), t.events.select(C("event_type").alias("kind")).distinct(), t.events.where("user_id % 13 = 0").select(_day("ts").alias("calendar_date"), C("event_type").alias("kind"))))
R.query("SRC27_since_filter", "select o_orderkey from (select o_orderkey, case when o_orderkey % 6 > 0 then cast(o_orderdate as date) end as d from orders) x where d between date '1997-01-01' and date '1998-06-30'")(
    lambda t: t.orders.select("o_orderkey", F.when(C("o_orderkey") % 6 > 0, _day()).alias("d")).where(C("d").between("1997-01-01", "1998-06-30")).select("o_orderkey"))
