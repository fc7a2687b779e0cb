"""Session context, feature tables with marked labels, availability audit and daily health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact_mean, instant
from ..operators.joins import trailing_sum
from ..registry import Registry

R = Registry()
C = F.col


def daily_health(payloads: DataFrame) -> DataFrame:
    """One row a subject and day from JSON payloads (subject, calendar_date, kind, raw, ingested_at): each measure tries several paths,
    bad numbers are null, presence flags say which kinds arrived, text instants may be ISO or epochs, the latest payload of a kind counts."""
    path = lambda *names: F.coalesce(*[F.get_json_object("raw", f"$.{n}") for n in names]).try_cast("double")
    rows = payloads.withColumn("_v", path("restingHeartRate", "k", "value")).withColumn("_when", instant(F.coalesce(F.get_json_object("raw", "$.at"), F.unix_timestamp("ingested_at").cast("string"))))
    of = lambda kind, c: F.max_by(C(c), F.when((C("kind") == kind) & C(c).isNotNull(), F.struct("ingested_at", "payload_id")))
    kinds = ("view", "click", "purchase")
    return rows.groupBy("subject", "calendar_date").agg(*[of(k, "_v").alias(f"{k}_value") for k in kinds], *[F.bool_or(C("kind") == k).alias(f"has_{k}") for k in kinds], F.max("_when").alias("latest_at"), F.count("*").alias("n_payloads"))


R.query("MD04_daily_health", "select subject, calendar_date, " + ", ".join(f"max(case when kind = '{k}' and rn = 1 and v is not null then v end) as {k}_value, bool_or(kind = '{k}') as has_{k}" for k in ("view", "click", "purchase")) + """, max(make_timestamp(s * 1000000)) as latest_at, count(*) as n_payloads from
 (select *, row_number() over (partition by subject, calendar_date, kind order by v is null, ts desc, event_id desc) as rn from (select cast(user_id as varchar) as subject, cast(ts as date) as calendar_date, event_type as kind, ts, event_id, try_cast(json_extract_string(props, '$.k') as double) as v, cast(floor(epoch(ts)) as bigint) as s from events) x) y group by 1, 2""")(
    lambda t: daily_health(t.events.select(C("user_id").cast("string").alias("subject"), C("ts").cast("date").alias("calendar_date"), C("event_type").alias("kind"), C("props").alias("raw"), C("ts").cast("timestamp").alias("ingested_at"), C("event_id").alias("payload_id"))))


def run_sessions(runs: DataFrame) -> DataFrame:
    """Runs with the load of the days before: 7 days without runs count as 0, 28 days as missing."""
    per_day = runs.groupBy("subject", "activity_date").agg(F.sum("distance").alias("_d"), F.count("*").alias("_n"))
    w = {n: trailing_sum(per_day, "subject", "activity_date", c, n, 1) for n in (7, 28) for c in ("_n",)}
    load = per_day.select("subject", "activity_date", F.coalesce(w[7], F.lit(0)).alias("prior_7d_run_count"), w[28].alias("prior_28d_run_count"), F.coalesce(trailing_sum(per_day, "subject", "activity_date", "_d", 7, 1).cast("double"), F.lit(0.0)).alias("prior_7d_distance"), trailing_sum(per_day, "subject", "activity_date", "_d", 28, 1).cast("double").alias("prior_28d_distance"))
    return runs.join(load, ["subject", "activity_date"], "left")


_L = "over (partition by subject order by activity_date range between interval {} days preceding and interval 1 day preceding)"
R.query("MD27_run_sessions", f"""select v.run_id, v.subject, v.activity_date, coalesce(n7, 0) as prior_7d_run_count, n28 as prior_28d_run_count, coalesce(d7, 0.0) as prior_7d_distance, d28 as prior_28d_distance from {{vnat}} v join (select subject, activity_date, cast(sum(n) {_L.format(7)} as bigint) as n7, cast(sum(n) {_L.format(28)} as bigint) as n28, cast(sum(d) {_L.format(7)} as double) as d7, cast(sum(d) {_L.format(28)} as double) as d28
 from (select subject, activity_date, sum(distance) as d, count(*) as n from {{vnat}} n group by 1, 2) x) l on v.subject = l.subject and v.activity_date = l.activity_date""")(
    lambda t: run_sessions(t.vnat).select("run_id", "subject", "activity_date", "prior_7d_run_count", "prior_28d_run_count", "prior_7d_distance", "prior_28d_distance"))


def route_prediction_features(runs: DataFrame) -> DataFrame:
    """For each attempt at a route: means of the attempts before it (inputs), and figures of all attempts, later ones too (`leak_`), and the label."""
    along = Window.partitionBy("route").orderBy("activity_date", "run_id")
    before, every = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("route")
    return runs.select("run_id", "route", F.count("*").over(before).alias("prior_attempts"), exact_mean("distance", 2, before).alias("prior_avg_distance"), exact_mean("duration_seconds", 0, before).alias("prior_avg_seconds"), F.round(F.avg("avg_heart_rate").over(before), 6).alias("prior_avg_hr"),
                       F.count("*").over(every).alias("leak_attempts"), exact_mean("distance", 2, every).alias("leak_avg_distance"), C("duration_seconds").alias("label_seconds"))


_B = "over (partition by route order by activity_date, run_id rows between unbounded preceding and 1 preceding)"
R.query("MD29_route_features", f"select run_id, route, count(*) {_B} as prior_attempts, cast(sum(distance) {_B} as double) / nullif(count(distance) {_B}, 0) as prior_avg_distance, cast(sum(cast(duration_seconds as decimal(38,0))) {_B} as double) / nullif(count(duration_seconds) {_B}, 0) as prior_avg_seconds, round(avg(avg_heart_rate) {_B}, 6) as prior_avg_hr, count(*) over (partition by route) as leak_attempts, cast(sum(distance) over (partition by route) as double) / count(distance) over (partition by route) as leak_avg_distance, duration_seconds as label_seconds from {{vnat}} v")(
    lambda t: route_prediction_features(t.vnat))


def availability_audit(df: DataFrame, entity: str, date: str, metrics: list[str]) -> DataFrame:
    """Denominator, available, missing and percent of each metric, overall and by month, from one scan."""
    periods = F.explode(F.array(F.struct(F.lit("all").alias("scope"), F.lit(None).cast("date").alias("month")), F.struct(F.lit("month").alias("scope"), F.trunc(C(date), "month").alias("month"))))
    rows = df.groupBy(F.trunc(C(date), "month").alias("_m")).agg(F.count("*").alias("n"), *[F.count(m).alias(m) for m in metrics])
    rows = rows.withColumn(date, C("_m")).select("n", *metrics, periods.alias("p"))
    flat = rows.select("n", "p.scope", "p.month", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), C(m).alias("have")) for m in metrics])).alias("c"))
    out = flat.groupBy("scope", "month", "c.metric").agg(F.sum("n").alias("denominator"), F.sum("c.have").alias("available"))
    return out.select(F.lit(entity).alias("entity"), "scope", "month", "metric", "denominator", "available", (C("denominator") - C("available")).alias("missing"), F.round(100.0 * C("available") / C("denominator"), 4).alias("pct"))


_M = ("avg_heart_rate", "recovery_drop", "ending_heart_rate", "distance")
R.query("MD30_availability_audit", " union all ".join(f"select 'run' as entity, '{s}' as scope, {m} as month, '{c}' as metric, count(*) as denominator, count({c}) as available, count(*) - count({c}) as missing, round(100.0 * count({c}) / count(*), 4) as pct from {{vnat}} v group by {g}" for c in _M for s, m, g in (("all", "cast(null as date)", "()"), ("month", "cast(date_trunc('month', activity_date) as date)", "cast(date_trunc('month', activity_date) as date)"))))(
    lambda t: availability_audit(t.vnat, "run", "activity_date", list(_M)))
