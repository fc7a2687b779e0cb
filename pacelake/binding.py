"""Input tables, and views that stand for telemetry over them.

`vrec` records (one run per user and week), `vgeo` records with coordinates, `vevt` timer events, `vrun` runs,
`lrec`, `levt` and `lrun` the same as `vrec`, `vevt` and `vrun` for long runs over order lines (one run a supplier),
`vday` dated sessions of customers, `vnat` the same for nations with more measures, `vrest` resting heart rates by day. Each view exists as DataFrame code and as SQL text for comparison.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Attributes are the tables of one folder and the views over them, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over tables and views named in braces."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})

    @cached_property
    def vrec(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        base = self.events.select(
            "event_id", F.col("user_id").cast("string").alias("subject"), F.col("ts").alias("record_timestamp"), "event_type",
            F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").cast("decimal(18,2)").alias("v"), F.unix_timestamp(ts).alias("epoch_s"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_trunc("week", ts).cast("date").cast("string")).alias("run_id"),
        )
        run = Window.partitionBy("run_id")
        along = run.orderBy("record_timestamp", "event_id")
        return base.select(
            "run_id", "subject", "event_id", "record_timestamp", "event_type", "k", F.row_number().over(along).cast("long").alias("record_index"),
            F.floor((F.col("epoch_s") - F.min("epoch_s").over(run)) / 360.0).cast("long").alias("elapsed_seconds"),
            (F.sum("v").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("event_type") == "error", 30).otherwise(0)).cast("double").alias("record_distance_m"),
            F.when(F.col("k") % 10 != 0, (100 + F.col("k")).cast("double")).alias("heart_rate"), (160 + F.col("event_id") % 20).cast("double").alias("running_cadence"),
            (F.col("event_id") % 97).cast("double").alias("altitude_m"),
        )

    @cached_property
    def vgeo(self) -> DataFrame:
        # Decimal sums before the cast, as in the SQL text.
        lat = """cast(case when k % 13 = 0 then null else 52.0 + (cast(subject as int) % 8) * 0.05 + cast(floor(record_distance_m / 250.0) as double) * 0.004
          + case when k % 17 = 0 then 0.01 else 0.0 end end as double)"""
        return self.vrec.withColumns({"lat": F.expr(lat), "lon": F.expr("cast(4.9 + (cast(subject as int) % 8) * 0.05 as double)")})

    @cached_property
    def vevt(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop_all")
        return self.vrec.where(kind.isNotNull()).select("run_id", F.col("elapsed_seconds").alias("t"), "record_index", kind.alias("et"))

    @cached_property
    def vrun(self) -> DataFrame:
        return self.vrec.groupBy("run_id", "subject").agg(
            F.min(F.col("record_timestamp").cast("date")).alias("activity_date"), (F.max("record_distance_m") / 1000.0).alias("distance_km"),
            F.max("elapsed_seconds").alias("duration_seconds"), F.avg("heart_rate").alias("avg_heart_rate"), F.count("*").alias("record_count"),
        )

    @cached_property
    def lrec(self) -> DataFrame:
        along = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
        rows = self.lineitem.withColumn("record_index", F.row_number().over(along).cast("long"))
        metres = F.sum(F.col("l_quantity").cast("decimal(18,2)")).over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
        beats = F.when((F.col("l_orderkey") % 17 != 0) & ((F.col("l_suppkey") % 5 != 0) | (F.col("l_linenumber") < 3)), (120 + F.col("l_linenumber") * 3 + F.floor(F.col("record_index") / 60)).cast("double"))
        return rows.select(
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("run_id"), F.col("l_suppkey").cast("string").alias("subject"), "record_index", (F.col("record_index") * 7).alias("elapsed_seconds"), metres.alias("record_distance_m"), beats.alias("heart_rate"),
            F.lit(170.0).alias("running_cadence"), (F.col("l_partkey") % 90).cast("double").alias("altitude_m"), (52 + F.col("record_index") * 0.0001).cast("double").alias("lat"), F.lit(4.9).alias("lon"),
        )

    @cached_property
    def levt(self) -> DataFrame:
        last = F.max("record_index").over(Window.partitionBy("run_id"))
        rows = self.lrec.select("run_id", "record_index", "elapsed_seconds", F.col("subject").cast("int").alias("s")).withColumn("n", last)
        pause = (F.col("s") % 7 == 3) & F.col("record_index").isin(100, 110)
        stop = ((F.col("record_index") == F.col("n")) & (F.col("s") % 11 != 5)) | (F.col("s") % 7 == 3) & (F.col("record_index") == 100)
        kind = F.when(stop, "stop_all").otherwise("start")
        return rows.where((F.col("record_index") == 1) | stop | pause).select("run_id", F.col("elapsed_seconds").alias("t"), "record_index", kind.alias("et"))

    @cached_property
    def lrun(self) -> DataFrame:
        return self.lrec.groupBy("run_id", "subject").agg((F.max("record_distance_m") / 1000.0).alias("distance_km"), F.max("elapsed_seconds").alias("duration_seconds"), F.avg("heart_rate").alias("avg_heart_rate"), F.count("*").alias("record_count"))

    @cached_property
    def vday(self) -> DataFrame:
        return self.orders.select(F.col("o_orderdate").cast("date").alias("activity_date"), F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("distance"))

    @cached_property
    def vnat(self) -> DataFrame:
        who = self.customer.select("c_custkey", "c_nationkey")
        return self.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderdate").cast("date").alias("activity_date"), F.col("c_nationkey").cast("string").alias("subject"), F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("route"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("distance"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5000 + 600).cast("long").alias("duration_seconds"),
            F.when(F.col("o_orderkey") % 7 != 0, (100 + F.col("o_orderkey") % 75).cast("double")).alias("avg_heart_rate"), F.when(F.col("o_orderkey") % 5 != 0, (20 + F.col("o_orderkey") % 40).cast("double")).alias("recovery_drop"),
            F.when(F.col("o_orderkey") % 11 != 0, (130 + F.col("o_orderkey") % 50).cast("double")).alias("ending_heart_rate"),
        )

    @cached_property
    def vrest(self) -> DataFrame:
        return self.vnat.where(F.dayofmonth("activity_date") % 3 != 0).groupBy("subject", F.col("activity_date").alias("calendar_date")).agg((45 + F.min(F.col("run_id")) % 20).cast("double").alias("resting_heart_rate"))


_VREC = """(select run_id, subject, event_id, record_timestamp, event_type, k,
  row_number() over (partition by run_id order by record_timestamp, event_id) as record_index,
  cast(floor((epoch_s - min(epoch_s) over (partition by run_id)) / 360.0) as bigint) as elapsed_seconds,
  cast(sum(v) over (partition by run_id order by record_timestamp, event_id rows between unbounded preceding and current row)
    - case when event_type = 'error' then 30 else 0 end as double) as record_distance_m,
  case when k % 10 = 0 then null else cast(100 + k as double) end as heart_rate,
  cast(160 + event_id % 20 as double) as running_cadence, cast(event_id % 97 as double) as altitude_m
 from (select event_id, cast(user_id as varchar) as subject, ts as record_timestamp, event_type,
   cast(json_extract_string(props, '$.k') as int) as k, cast(value as decimal(18,2)) as v, cast(floor(epoch(ts)) as bigint) as epoch_s,
   concat(cast(user_id as varchar), '-', cast(cast(date_trunc('week', ts) as date) as varchar)) as run_id from events) e0)"""
_VGEO = f"""(select r0.*, cast(case when k % 13 = 0 then null else 52.0 + (cast(subject as int) % 8) * 0.05 + floor(record_distance_m / 250.0) * 0.004
  + case when k % 17 = 0 then 0.01 else 0.0 end end as double) as lat, cast(4.9 + (cast(subject as int) % 8) * 0.05 as double) as lon from {_VREC} r0)"""
_VNAT = """(select cast(o_orderdate as date) as activity_date, cast(c_nationkey as varchar) as subject, o_orderkey as run_id, o_custkey as route, cast(o_totalprice as decimal(18,2)) as distance, o_orderstatus as status,
  cast(o_orderkey % 5000 + 600 as bigint) as duration_seconds, case when o_orderkey % 7 <> 0 then cast(100 + o_orderkey % 75 as double) end as avg_heart_rate,
  case when o_orderkey % 5 <> 0 then cast(20 + o_orderkey % 40 as double) end as recovery_drop, case when o_orderkey % 11 <> 0 then cast(130 + o_orderkey % 50 as double) end as ending_heart_rate
 from orders join customer on o_custkey = c_custkey)"""
_LREC = """(select concat('s', l_suppkey) as run_id, cast(l_suppkey as varchar) as subject, record_index, record_index * 7 as elapsed_seconds, cast(metres as double) as record_distance_m,
  case when l_orderkey % 17 <> 0 and (l_suppkey % 5 <> 0 or l_linenumber < 3) then cast(120 + l_linenumber * 3 + floor(record_index / 60) as double) end as heart_rate, cast(170 as double) as running_cadence, cast(l_partkey % 90 as double) as altitude_m,
  cast(52 + record_index * 0.0001 as double) as lat, cast(4.9 as double) as lon from (select *, row_number() over w as record_index, sum(cast(l_quantity as decimal(18,2))) over (w rows between unbounded preceding and current row) as metres
   from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey)) l0)"""
VIEWS = {
    "lrec": _LREC,
    "levt": f"""(select run_id, elapsed_seconds as t, record_index, case when (record_index = n and s % 11 <> 5) or (s % 7 = 3 and record_index = 100) then 'stop_all' else 'start' end as et
  from (select *, cast(subject as int) as s, max(record_index) over (partition by run_id) as n from {_LREC} l1) l2 where record_index = 1 or (record_index = n and s % 11 <> 5) or (s % 7 = 3 and record_index in (100, 110)))""",
    "lrun": f"(select run_id, subject, max(record_distance_m) / 1000.0 as distance_km, max(elapsed_seconds) as duration_seconds, avg(heart_rate) as avg_heart_rate, count(*) as record_count from {_LREC} l3 group by run_id, subject)",
    "vnat": _VNAT,
    "vrest": f"(select subject, activity_date as calendar_date, cast(45 + min(run_id) % 20 as double) as resting_heart_rate from {_VNAT} n0 where day(activity_date) % 3 <> 0 group by subject, activity_date)",
    "vrec": _VREC,
    "vgeo": _VGEO,
    "vevt": f"(select run_id, elapsed_seconds as t, record_index, case event_type when 'signup' then 'start' else 'stop_all' end as et from {_VREC} r1 where event_type in ('signup', 'error'))",
    "vrun": f"""(select run_id, subject, min(cast(record_timestamp as date)) as activity_date, max(record_distance_m) / 1000.0 as distance_km, max(elapsed_seconds) as duration_seconds,
  avg(heart_rate) as avg_heart_rate, count(*) as record_count from {_VREC} r2 group by run_id, subject)""",
    "vday": "(select cast(o_orderdate as date) as activity_date, o_custkey as subject, o_orderkey as run_id, cast(o_totalprice as decimal(18,2)) as distance from orders)",
}


def sql_views(text: str) -> str:
    """SQL text with view names in braces replaced by the views' text, and table names by themselves."""
    return re.sub(r"\{(\w+)\}", lambda m: VIEWS.get(m[1], m[1]) if m[1] in VIEWS or m[1] in NAMES else m[0], text)
