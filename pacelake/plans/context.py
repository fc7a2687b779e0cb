"""Runs with all that is known of them: route, shape of the path in 250 m segments, load of the days before, economy; and from
these the whole route summary and the features of each attempt at a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact_mean
from ..registry import Registry
from ..session import cut
from . import fitness, routes, segments, telemetry
from .features import run_sessions
from .reads import run_page

R = Registry()
C = F.col


def segment_summary(cells: DataFrame, length_m: float = 250.0) -> DataFrame:
    """One row a run over its segments of one length: count, mean pace and grade, altitude range, climb, descent and net change."""
    change = C("elevation_change_m")
    return cells.where(C("length_m") == length_m).groupBy("run_id").agg(
        F.count("*").alias("segment_count"), F.avg("pace").alias("avg_segment_pace"), F.avg("grade").alias("avg_segment_grade"), (F.max("max_altitude_m") - F.min("min_altitude_m")).alias("altitude_range_m"),
        F.sum(F.greatest(change, F.lit(0.0))).alias("ascent_m"), F.sum(F.greatest(-change, F.lit(0.0))).alias("descent_m"), F.sum(change).alias("net_elevation_m"),
    )


def record_extent(records: DataFrame) -> DataFrame:
    """One row a run over its records: first and last time, first and last valid coordinates, records with one, and the kilometres between
    the least and greatest distance."""
    valid = C("lat").between(-90, 90) & C("lon").between(-180, 180)
    place = F.when(valid, F.struct("lat", "lon"))
    order = F.when(valid, C("record_index"))
    rows = records.groupBy("run_id").agg(
        F.min("record_timestamp").alias("first_record"), F.max("record_timestamp").alias("last_record"), F.count(order).alias("gps_record_count"), F.min_by(place, order).alias("_a"), F.max_by(place, order).alias("_z"),
        ((F.max("record_distance_m") - F.min("record_distance_m")) / 1000.0).alias("record_distance_km"),
    )
    return rows.select("run_id", "first_record", "last_record", "gps_record_count", C("_a.lat").alias("start_lat"), C("_a.lon").alias("start_lon"), C("_z.lat").alias("end_lat"), C("_z.lon").alias("end_lon"), "record_distance_km")


def session_context(runs: DataFrame, clusters: DataFrame, obs: DataFrame, summary: DataFrame, economy: DataFrame, extent: DataFrame | None = None, mart: DataFrame | None = None) -> DataFrame:
    """`runs` (run_id, subject, activity_date, distance_km, ...) with pace, load, route, segment summary and economy, and, where given, the
    extent of their records (with the share of the distance that they cover) and score and decoupling; runs without any of these stay."""
    loaded = run_sessions(runs.withColumn("distance", C("distance_km").cast("decimal(20,5)")))
    pace = F.when(C("distance_km") > 0, C("duration_seconds") / 60.0 / C("distance_km"))
    path = obs.select("run_id", C("bucket").alias("route_bucket"), "start_cell", "end_cell", "signature")
    out = loaded.withColumn("pace", pace).join(clusters.withColumnRenamed("similarity", "route_similarity").drop("is_representative"), "run_id", "left")
    out = out.join(path, "run_id", "left").join(summary, "run_id", "left").join(economy.select("run_id", "m_per_beat", "climb_per_beat"), "run_id", "left").drop("distance")
    if extent is not None:
        out = out.join(extent, "run_id", "left").withColumn("distance_coverage", F.when(C("distance_km") > 0, C("record_distance_km") / C("distance_km")))
    return out if mart is None else out.join(mart.select("run_id", "score", "decoupling_pct"), "run_id", "left")


def route_summary(sessions: DataFrame) -> DataFrame:
    """One row a route over the runs that have one: counts, dates, ranges and means, and what names the route."""
    mean = lambda c, as_, digits=6: F.round(F.avg(c), digits).alias(as_)
    return sessions.where("route_id is not null").groupBy("route_id").agg(
        F.min("representative_run_id").alias("representative_run_id"), F.min("activity_date").alias("first_date"), F.max("activity_date").alias("last_date"), F.count("*").alias("run_count"),
        F.min("route_similarity").alias("min_similarity"), exact_mean("route_similarity", 9).alias("avg_similarity"), exact_mean("distance_km", 5).alias("avg_km"), F.min("distance_km").alias("min_km"), F.max("distance_km").alias("max_km"),
        exact_mean("duration_seconds", 0).alias("avg_seconds"), mean("pace", "avg_pace"), mean("avg_heart_rate", "avg_hr"), mean("ascent_m", "avg_ascent_m", 5), mean("descent_m", "avg_descent_m", 5),
        exact_mean("segment_count", 0).alias("avg_segment_count"), mean("avg_segment_grade", "avg_segment_grade"), mean("altitude_range_m", "avg_altitude_range_m", 5),
        F.min("route_bucket").alias("route_bucket"), F.min("start_cell").alias("start_cell"), F.min("end_cell").alias("end_cell"), F.min("signature").alias("signature"),
    )


def attempt_features(sessions: DataFrame, summary: DataFrame) -> DataFrame:
    """Each attempt at a route: what was known before it (its path, load, means of earlier attempts), figures of all attempts, later
    ones too (`lifetime_`), and labels (`label_`)."""
    before = Window.partitionBy("route_id").orderBy("activity_date", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c, as_: F.round(F.avg(c).over(before), 6).alias(as_)
    known = sessions.where("route_id is not null").select(
        "run_id", "activity_date", "route_id", "route_bucket", "segment_count", F.round("avg_segment_grade", 6).alias("segment_grade"), F.round("altitude_range_m", 5).alias("altitude_range_m"), F.round("ascent_m", 5).alias("ascent_m"), F.round("descent_m", 5).alias("descent_m"),
        "prior_7d_run_count", "prior_7d_distance", "prior_28d_run_count", "prior_28d_distance", F.count("*").over(before).alias("prior_attempts"), prior("pace", "prior_pace"), prior("avg_heart_rate", "prior_hr"),
        exact_mean("duration_seconds", 0, before).alias("prior_seconds"), C("distance_km").alias("label_km"), C("duration_seconds").alias("label_seconds"), F.round("pace", 6).alias("label_pace"), F.round("avg_heart_rate", 6).alias("label_hr"),
    )
    life = summary.select("route_id", C("run_count").alias("lifetime_runs"), C("avg_km").alias("lifetime_km"), C("avg_pace").alias("lifetime_pace"), C("avg_hr").alias("lifetime_hr"))
    return known.join(life, "route_id", "left")


def sessions_of(t) -> DataFrame:
    obs, clusters = routes.clustered(t)
    return session_context(t.vrun, clusters, obs, segment_summary(segments.segments_of(t, (250.0,))), telemetry.heart_economy(t.vrec))


def whole_sessions_of(t) -> DataFrame:
    """Sessions with the extent of their records and their figures of the fitness mart."""
    obs, clusters = routes.clustered(t)
    return session_context(t.vrun, clusters, obs, segment_summary(segments.segments_of(t, (250.0,))), telemetry.heart_economy(t.vrec), record_extent(t.vgeo), cut(fitness.mart_of(t)))


_LOAD = """(select subject, activity_date, cast(sum(n) over (partition by subject order by activity_date range between interval 7 days preceding and interval 1 day preceding) as bigint) as n7, cast(sum(n) over (partition by subject order by activity_date range between interval 28 days preceding and interval 1 day preceding) as bigint) as n28,
 cast(sum(d) over (partition by subject order by activity_date range between interval 7 days preceding and interval 1 day preceding) as double) as d7, cast(sum(d) over (partition by subject order by activity_date range between interval 28 days preceding and interval 1 day preceding) as double) as d28
 from (select subject, activity_date, count(*) as n, sum(cast(distance_km as decimal(20,5))) as d from {vrun} v group by 1, 2) x)"""
_SUMMED = f"""(select run_id, count(*) as segment_count, avg(pace) as avg_segment_pace, avg(grade) as avg_segment_grade, max(max_altitude_m) - min(min_altitude_m) as altitude_range_m, sum(greatest(elevation_change_m, 0.0)) as ascent_m,
 sum(greatest(-elevation_change_m, 0.0)) as descent_m, sum(elevation_change_m) as net_elevation_m from {segments.SEG} s where length_m = 250 group by run_id)"""
SESSIONS = f"""{routes.CLUSTER_CTES}, sx as materialized (select v.run_id, v.subject, v.activity_date, v.distance_km, v.duration_seconds, v.avg_heart_rate, v.record_count, case when v.distance_km > 0 then v.duration_seconds / 60.0::double / v.distance_km end as pace,
 coalesce(n7, 0) as prior_7d_run_count, n28 as prior_28d_run_count, coalesce(d7, 0.0) as prior_7d_distance, d28 as prior_28d_distance, cl.route_id, cl.representative_run_id, cl.similarity as route_similarity, p.bucket as route_bucket, p.start_cell, p.end_cell, p.signature,
 m.segment_count, m.avg_segment_pace, m.avg_segment_grade, m.altitude_range_m, m.ascent_m, m.descent_m, m.net_elevation_m, e.m_per_beat, e.climb_per_beat
 from {{vrun}} v left join {_LOAD} l on v.subject = l.subject and v.activity_date = l.activity_date left join cl on cl.run_id = v.run_id left join {routes.OBS} p on p.run_id = v.run_id left join {_SUMMED} m on m.run_id = v.run_id left join {telemetry.ECO} e on e.run_id = v.run_id)"""
WHOLE = f"""{SESSIONS}, ex as (select run_id, min(record_timestamp) as first_record, max(record_timestamp) as last_record, count(lat) as gps_record_count, arg_min(lat, record_index) filter (where lat is not null) as start_lat, arg_min(lon, record_index) filter (where lat is not null) as start_lon,
 arg_max(lat, record_index) filter (where lat is not null) as end_lat, arg_max(lon, record_index) filter (where lat is not null) as end_lon, (max(record_distance_m) - min(record_distance_m)) / 1000.0 as record_distance_km from {{vgeo}} g group by run_id),
 sw as materialized (select sx.*, ex.* exclude (run_id), case when distance_km > 0 then record_distance_km / distance_km end as distance_coverage, m.score, m.decoupling_pct from sx left join ex on ex.run_id = sx.run_id left join {fitness.MART} m on m.run_id = sx.run_id)"""
_MEAN = "cast(sum(cast({0} as decimal(38,{1}))) as double) / count({0})"
ROUTES = f"""{SESSIONS}, rs as materialized (select route_id, min(representative_run_id) as representative_run_id, min(activity_date) as first_date, max(activity_date) as last_date, count(*) as run_count, min(route_similarity) as min_similarity, {_MEAN.format("route_similarity", 9)} as avg_similarity,
 {_MEAN.format("distance_km", 5)} as avg_km, min(distance_km) as min_km, max(distance_km) as max_km, {_MEAN.format("duration_seconds", 0)} as avg_seconds, round(avg(pace), 6) as avg_pace, round(avg(avg_heart_rate), 6) as avg_hr, round(avg(ascent_m), 5) as avg_ascent_m, round(avg(descent_m), 5) as avg_descent_m,
 {_MEAN.format("segment_count", 0)} as avg_segment_count, round(avg(avg_segment_grade), 6) as avg_segment_grade, round(avg(altitude_range_m), 5) as avg_altitude_range_m, min(route_bucket) as route_bucket, min(start_cell) as start_cell, min(end_cell) as end_cell, min(signature) as signature from sx where route_id is not null group by route_id)"""
_ROUNDED = {"pace": 6, "avg_heart_rate": 6, "avg_segment_pace": 5, "avg_segment_grade": 6, "altitude_range_m": 5, "ascent_m": 5, "descent_m": 5, "net_elevation_m": 5}
_KEPT = ("run_id", "subject", "activity_date", "distance_km", "duration_seconds", "record_count", "prior_7d_run_count", "prior_28d_run_count", "prior_7d_distance", "prior_28d_distance", "route_id", "representative_run_id", "route_similarity", "route_bucket", "start_cell", "end_cell", "signature", "segment_count", "m_per_beat", "climb_per_beat")
R.query("MD27_session_context", f"{SESSIONS} select {', '.join(_KEPT)}, {', '.join(f'round({c}, {n}) as {c}' for c, n in _ROUNDED.items())} from sx")(lambda t: sessions_of(t).select(*_KEPT, *[F.round(c, n).alias(c) for c, n in _ROUNDED.items()]))
_EXTENT = ("first_record", "last_record", "gps_record_count", "start_lat", "start_lon", "end_lat", "end_lon", "score")
R.query("MD27_whole_sessions", f"{WHOLE} select {', '.join((*_KEPT, *_EXTENT))}, {', '.join(f'round({c}, {n}) as {c}' for c, n in _ROUNDED.items())}, round(record_distance_km, 6) as record_distance_km, round(distance_coverage, 6) as distance_coverage, round(decoupling_pct, 5) as decoupling_pct from sw")(
    lambda t: whole_sessions_of(t).select(*_KEPT, *_EXTENT, *[F.round(c, n).alias(c) for c, n in {**_ROUNDED, "record_distance_km": 6, "distance_coverage": 6, "decoupling_pct": 5}.items()]))
R.query("MD28_route_summary", f"{ROUTES} select * from rs")(lambda t: route_summary(sessions_of(t)))
_PRIOR = "over (partition by route_id order by activity_date, run_id rows between unbounded preceding and 1 preceding)"
R.query("MD29_attempt_features", f"""{ROUTES} select run_id, activity_date, sx.route_id, sx.route_bucket, segment_count, round(sx.avg_segment_grade, 6) as segment_grade, round(altitude_range_m, 5) as altitude_range_m, round(ascent_m, 5) as ascent_m, round(descent_m, 5) as descent_m, prior_7d_run_count, prior_7d_distance, prior_28d_run_count, prior_28d_distance,
 prior_attempts, round(prior_pace, 6) as prior_pace, round(prior_hr, 6) as prior_hr, prior_seconds, distance_km as label_km, duration_seconds as label_seconds, round(pace, 6) as label_pace, round(avg_heart_rate, 6) as label_hr, run_count as lifetime_runs, avg_km as lifetime_km, avg_pace as lifetime_pace, avg_hr as lifetime_hr
 from (select *, count(*) {_PRIOR} as prior_attempts, avg(pace) {_PRIOR} as prior_pace, avg(avg_heart_rate) {_PRIOR} as prior_hr, cast(sum(cast(duration_seconds as decimal(38,0))) {_PRIOR} as double) / nullif(count(duration_seconds) {_PRIOR}, 0) as prior_seconds from sx where route_id is not null) sx left join rs on sx.route_id = rs.route_id""")(
    lambda t: (lambda s: attempt_features(s, route_summary(s)))(cut(sessions_of(t))))
R.query("RD05_session_page", f"{SESSIONS} select run_id, route_id, m_per_beat, count(*) over () as total_count from sx where distance_km >= 0.4 order by m_per_beat desc nulls last, activity_date desc, run_id limit 50 offset 10")(
    lambda t: run_page(sessions_of(t), "distance_economy", True, 50, 10, ranges={"distance_km": (0.4, None)}).select("run_id", "route_id", "m_per_beat", "total_count"))
R.query("RD05_score_page", f"{WHOLE} select run_id, score, round(distance_coverage, 6) as distance_coverage, count(*) over () as total_count from sw where gps_record_count >= 3 order by score desc nulls last, activity_date desc, run_id limit 60 offset 5")(
    lambda t: run_page(cut(whole_sessions_of(t).select("run_id", "activity_date", "score", "distance_coverage", "gps_record_count")), "efficiency", True, 60, 5, ranges={"gps_record_count": (3, None)}).select("run_id", "score", F.round("distance_coverage", 6).alias("distance_coverage"), "total_count"))
