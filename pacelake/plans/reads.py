"""Parameterised reads over the marts: bounds, summaries, pages, windows and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sunday_week_start
from ..operators.relational import has_metric, optional_range
from ..operators.windows import page
from ..registry import Registry
from . import rollups, segments
from .telemetry import downsample_even

R = Registry()
C = F.col
FROM, TO = "1996-01-01", "1997-06-30"
_IN = f"activity_date between date '{FROM}' and date '{TO}'"


def window(df: DataFrame, date: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of a date window; either end may be missing, an inverted window is empty."""
    return optional_range(df, date, *(F.lit(x).cast("date") if x else None for x in (first, last)))


def filter_bounds(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Least and greatest value of each metric in one row."""
    return runs.agg(*[x for m in metrics for x in (F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))])


_B = ("activity_date", "distance", "duration_seconds", "avg_heart_rate", "recovery_drop", "ending_heart_rate")
R.query("RD01_filter_bounds", "select " + ", ".join(f"min({m}) as min_{m}, max({m}) as max_{m}" for m in _B) + f" from {{vnat}} v where {_IN}")(lambda t: filter_bounds(window(t.vnat, "activity_date", FROM, TO), list(_B)))


def route_summaries(runs: DataFrame, dimension: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of routes by runs, distance and id, with their names and the count of all."""
    per = runs.groupBy("route").agg(F.count("*").alias("run_count"), F.sum("distance").cast("double").alias("distance"), F.max("activity_date").alias("last_date"))
    return page(per.join(dimension, "route"), [C("run_count").desc(), C("distance").desc(), "route"], limit, offset)


R.query("RD02_route_summaries", f"select r.*, c_name as route_name, count(*) over () as total_count from (select route, count(*) as run_count, cast(sum(distance) as double) as distance, max(activity_date) as last_date from {{vnat}} v where {_IN} group by route) r join customer on route = c_custkey order by run_count desc, distance desc, route limit 50 offset 10")(
    lambda t: route_summaries(window(t.vnat, "activity_date", FROM, TO), t.customer.select(C("c_custkey").alias("route"), C("c_name").alias("route_name")), 50, 10))


def period_summary(runs: DataFrame) -> DataFrame:
    """Totals of a window, its last 7 and 28 days counted from its latest date, active weeks (from Sunday) and months."""
    rows = runs.crossJoin(F.broadcast(runs.agg(F.max("activity_date").alias("_latest"))))
    recent = lambda n: C("activity_date") > F.date_sub("_latest", n)
    return rows.agg(F.count("*").alias("run_count"), F.sum("distance").cast("double").alias("distance"), F.sum("duration_seconds").alias("duration_seconds"), F.max("activity_date").alias("latest_date"), *[F.count_if(recent(n)).alias(f"runs_{n}d") for n in (7, 28)], *[F.sum(F.when(recent(n), C("distance"))).cast("double").alias(f"distance_{n}d") for n in (7, 28)],
                    F.count_distinct(sunday_week_start(C("activity_date"))).alias("active_weeks"), F.count_distinct(F.trunc("activity_date", "month")).alias("active_months"))


R.query("RD03_period_summary", f"select count(*) as run_count, cast(sum(distance) as double) as distance, cast(sum(duration_seconds) as bigint) as duration_seconds, max(activity_date) as latest_date, " + ", ".join(f"count(*) filter (where activity_date > latest - {n}) as runs_{n}d, cast(sum(distance) filter (where activity_date > latest - {n}) as double) as distance_{n}d" for n in (7, 28)) + f", count(distinct activity_date - cast(dayofweek(activity_date) as int)) as active_weeks, count(distinct date_trunc('month', activity_date)) as active_months from (select *, max(activity_date) over () as latest from {{vnat}} v where {_IN}) x")(
    lambda t: period_summary(window(t.vnat, "activity_date", FROM, TO)))


def map_profile(records: DataFrame, run_id: str | None = None, representative_of: DataFrame | None = None, sample: int = 500) -> DataFrame:
    """Sampled points of one run, or of the one run named by `representative_of`; exactly one must be given."""
    if (run_id is None) == (representative_of is None):
        raise ValueError("give a run or a route")
    rows = records.where(C("run_id") == run_id) if run_id is not None else records.join(representative_of.select("run_id"), "run_id", "left_semi")
    return downsample_even(rows, sample).orderBy("run_id", "record_index")


R.query("RD04_map_profile", "select run_id, record_index, lat, lon, altitude_m from {vgeo} g where run_id in (select min(run_id) from {vrun} r)")(lambda t: map_profile(t.vgeo, representative_of=t.vrun.agg(F.min("run_id").alias("run_id"))).select("run_id", "record_index", "lat", "lon", "altitude_m"))


#: Sort keys of the run list and the columns they stand for.
SORT_KEYS = {
    "date": "activity_date", "distance": "distance", "distance_km": "distance_km", "duration": "duration_seconds", "pace": "pace", "heart_rate": "avg_heart_rate", "recovery": "recovery_drop", "ending_heart_rate": "ending_heart_rate", "ascent": "ascent_m", "prior_7d": "prior_7d_distance",
    "prior_28d": "prior_28d_distance", "route": "route", "route_id": "route_id", "coverage": "distance_coverage", "distance_economy": "m_per_beat", "elevation_economy": "climb_per_beat", "decoupling": "decoupling_pct", "efficiency": "score", "id": "run_id", "subject": "subject",
}


def run_page(runs: DataFrame, sort: str = "date", descending: bool = True, limit: int = 25, offset: int = 0, first: str | None = None, last: str | None = None, ranges: dict | None = None, metric: tuple[str, bool | None] | None = None) -> DataFrame:
    """A page of runs under optional filters, missing values last in either direction, ties by date and id, with the exact count."""
    rows = window(runs, "activity_date", first, last)
    for column, (low, high) in (ranges or {}).items():
        rows = optional_range(rows, column, low, high)
    if metric:
        rows = has_metric(rows, *metric)
    key = C(SORT_KEYS[sort])
    return page(rows, [key.desc_nulls_last() if descending else key.asc_nulls_last(), C("activity_date").desc(), "run_id"], limit, offset)


R.query("RD05_run_page", f"select run_id, activity_date, recovery_drop, count(*) over () as total_count from {{vnat}} v where {_IN} and duration_seconds >= 900 and avg_heart_rate is not null order by recovery_drop asc nulls last, activity_date desc, run_id limit 40 offset 5")(
    lambda t: run_page(t.vnat.select("run_id", "activity_date", "recovery_drop", "duration_seconds", "avg_heart_rate"), "recovery", False, 40, 5, FROM, TO, {"duration_seconds": (900, None)}, ("avg_heart_rate", True)).select("run_id", "activity_date", "recovery_drop", "total_count"))
R.query("RD06_run_segments", f"select run_id, segment, round(distance_m, 5) as distance_m, round(seconds, 5) as seconds from {segments.SEG} s where length_m = 500 and run_id in (select min(run_id) from {{vrun}} r) order by segment limit 5000")(
    lambda t: segments.distance_segments(t.vgeo.join(t.vrun.agg(F.min("run_id").alias("run_id")), "run_id", "left_semi"), [500.0]).orderBy("segment").limit(5000).select("run_id", "segment", F.round("distance_m", 5).alias("distance_m"), F.round("seconds", 5).alias("seconds")))
R.query("RD07_days_window", f"select subject, calendar_date, run_count, distance from {rollups.DAYS} d where calendar_date between date '{FROM}' and date '{TO}' order by subject, calendar_date")(
    lambda t: window(rollups.days_of(t), "calendar_date", FROM, TO).orderBy("subject", "calendar_date").select("subject", "calendar_date", "run_count", "distance"))


def volume_rollups(days: DataFrame) -> DataFrame:
    """Months and years from days, with their totals."""
    parts = [rollups.period_mart(days, u).withColumn("unit", F.lit(u)) for u in ("month", "year")]
    return parts[0].unionByName(parts[1]).where("run_count > 0").select("subject", "unit", "period_start", "run_count", "distance")


R.query("RD08_volume_rollups", " union all ".join(f"select subject, '{u}' as unit, cast(date_trunc('{u}', calendar_date) as date) as period_start, cast(sum(run_count) as bigint) as run_count, cast(sum(cast(distance as decimal(18,2))) as double) as distance from {rollups.DAYS} d group by 1, 3 having sum(run_count) > 0" for u in ("month", "year")))(lambda t: volume_rollups(rollups.days_of(t)))


def dashboard(runs: DataFrame, days: DataFrame) -> DataFrame:
    """One row a subject: totals, latest run, longest streak."""
    latest = runs.groupBy("subject").agg(F.count("*").alias("run_count"), F.sum("distance").cast("double").alias("distance"), F.max(F.struct("activity_date", "run_id")).alias("l"))
    return latest.join(rollups.daily_streaks(days).select("subject", "longest_streak"), "subject", "left").select("subject", "run_count", "distance", C("l.activity_date").alias("latest_date"), C("l.run_id").alias("latest_run"), "longest_streak")


R.query("RD09_dashboard", f"select a.subject, run_count, a.distance, latest_date, latest_run, longest_streak from (select subject, count(*) as run_count, cast(sum(distance) as double) as distance, max(activity_date) as latest_date, max(case when rn = 1 then run_id end) as latest_run from (select *, row_number() over (partition by subject order by activity_date desc, run_id desc) as rn from {{vnat}} v) x group by subject) a left join (select subject, max(n) filter (where active_day) as longest_streak from {rollups._ISLE} i group by subject) b on a.subject = b.subject")(
    lambda t: dashboard(t.vnat, rollups.days_of(t)))


def dashboard_status(runs: DataFrame, days: DataFrame, landed: DataFrame, as_of: str) -> DataFrame:
    """`dashboard` with the week so far and the landing status: the latest day of health data, how many days behind it is, and whether it is stale."""
    week = rollups.current_week(days, as_of).select(C("subject").alias("_w"), "week_start_date", C("run_count").alias("week_runs"), C("distance").alias("week_distance"), C("active_days").alias("week_active_days"), "days_so_far")
    last = landed.where(C("calendar_date") <= F.lit(as_of).cast("date")).groupBy(C("subject").alias("_l")).agg(F.max("calendar_date").alias("latest_landed"))
    behind = F.datediff(F.lit(as_of).cast("date"), "latest_landed").cast("long")
    out = dashboard(runs, days).join(week, C("subject") == C("_w"), "left").join(last, C("subject") == C("_l"), "left").drop("_w", "_l")
    return out.withColumn("days_behind", behind).withColumn("landing_status", F.when(behind.isNull(), "missing").when(behind <= 1, "current").otherwise("stale"))


R.query("RD09_dashboard_status", f"""select a.*, week_start_date, w.run_count as week_runs, w.distance as week_distance, w.active_days as week_active_days, days_so_far, latest_landed, date_diff('day', latest_landed, date '2001-07-19') as days_behind,
 case when latest_landed is null then 'missing' when date_diff('day', latest_landed, date '2001-07-19') <= 1 then 'current' else 'stale' end as landing_status from ({R.oracles["RD09_dashboard"]}) a left join ({rollups.R.oracles["MD09_current_week"]}) w on a.subject = w.subject
 left join (select subject, max(calendar_date) as latest_landed from {{vrest}} h where calendar_date <= date '2001-07-19' group by subject) h on a.subject = h.subject""")(
    lambda t: dashboard_status(t.vnat, rollups.days_of(t), t.vrest, "2001-07-19"))


def compared(runs: DataFrame, primary: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Runs and distance of each subject in two windows side by side."""
    part = lambda w, p: window(runs, "activity_date", *w).groupBy(C("subject").alias(f"{p}_s")).agg(F.count("*").alias(f"{p}_runs"), F.sum("distance").cast("double").alias(f"{p}_distance"))
    return part(primary, "now").join(part(other, "then"), C("now_s") == C("then_s"), "full").select(F.coalesce("now_s", "then_s").alias("subject"), "now_runs", "now_distance", "then_runs", "then_distance")


_CMP = "select subject, count(*) as n, cast(sum(distance) as double) as d from {{vnat}} v where activity_date between date '{}' and date '{}' group by subject"
R.query("RD10_comparison", f"select coalesce(a.subject, b.subject) as subject, a.n as now_runs, a.d as now_distance, b.n as then_runs, b.d as then_distance from ({_CMP.format('1997-01-01', '1997-01-14')}) a full join ({_CMP.format('1996-01-01', '1996-01-14')}) b on a.subject = b.subject")(
    lambda t: compared(t.vnat, ("1997-01-01", "1997-01-14"), ("1996-01-01", "1996-01-14")))


def _runs_fitness(t):
    from .signals import fitness_signals

    return t.vnat.select("run_id", "distance").join(fitness_signals(t.vnat).select("run_id", "efficiency", "hr_band", "score"), "run_id", "left").select("run_id", C("distance").cast("double").alias("distance"), "efficiency", "hr_band", "score")


def _runs_fitness_sql():
    from .signals import FIT

    return f"select v.run_id, cast(v.distance as double) as distance, f.efficiency, f.hr_band, f.score from {{vnat}} v left join {FIT} f on v.run_id = f.run_id"


R.query("RD11_runs_with_fitness", _runs_fitness_sql())(_runs_fitness)


def serving_availability(cells: DataFrame) -> DataFrame:
    """Of each segment length: runs, segments, and those with pace, heart rate and coordinates."""
    return cells.groupBy("length_m").agg(F.countDistinct("run_id").alias("runs"), F.count("*").alias("segments"), F.count("pace").alias("with_pace"), F.count("avg_heart_rate").alias("with_hr"), F.count_if(C("start_lat").isNotNull() & C("start_lon").isNotNull()).alias("with_gps"))


R.query("RD12_serving_availability", f"select length_m, count(distinct run_id) as runs, count(*) as segments, count(pace) as with_pace, count(avg_heart_rate) as with_hr, count(*) filter (where start_lat is not null and start_lon is not null) as with_gps from {segments.SEG} s group by length_m")(lambda t: serving_availability(segments.segments_of(t)))
