"""Record-level operators: sequencing, sessions, sampling, timer windows, half split, efficiency trace, heart economy.

Records have run_id, record_index, elapsed_seconds, record_distance_m and measures. All windows of an operator
share one order per run, so each takes one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.joins import interval_overlap
from ..operators.windows import latest_by
from ..registry import Registry

R = Registry()
C = F.col
RUN = lambda: Window.partitionBy("run_id").orderBy("record_index")
SO_FAR = lambda: RUN().rowsBetween(Window.unboundedPreceding, 0)


def sequence_records(records: DataFrame) -> DataFrame:
    """Duplicates of a run's instant give way to the latest event; then order, gaps, deltas, guarded pace, cells and point text."""
    unique = latest_by(records, ["run_id", "record_timestamp"], [C("event_id").desc()])
    w = Window.partitionBy("run_id").orderBy("record_timestamp")
    before = F.lag(F.struct("elapsed_seconds", "record_distance_m", "altitude_m")).over(w)
    rows = unique.withColumn("_p", before).withColumn("record_index", F.row_number().over(w).cast("long"))
    gap, step = C("elapsed_seconds") - C("_p.elapsed_seconds"), C("record_distance_m") - C("_p.record_distance_m")
    return rows.select(
        "run_id", "subject", "event_id", "record_timestamp", "record_index", "elapsed_seconds", gap.alias("gap_seconds"), F.round(step, 6).alias("distance_delta_m"), (C("altitude_m") - C("_p.altitude_m")).alias("altitude_delta_m"),
        F.round(F.when((step > 0) & (gap > 0), gap / 60.0 / (step / 1000.0)), 6).alias("pace"), (C("running_cadence") * 2).alias("cadence"), "heart_rate", "record_distance_m", "altitude_m",
        S.grid_cell(C("lat"), C("lon"), 0.004).alias("cell_8"), S.grid_cell(C("lat"), C("lon"), 0.002).alias("cell_9"), S.wkt_point(C("lat"), C("lon")).isNotNull().alias("has_point"), "lat", "lon",
    )


_U = "(select *, row_number() over (partition by run_id order by record_timestamp) as ix from (select *, row_number() over (partition by run_id, record_timestamp order by event_id desc) as rn from {vgeo} g) x where rn = 1)"
SEQ = f"""(select run_id, subject, event_id, record_timestamp, ix as record_index, elapsed_seconds, gap as gap_seconds, round(step, 6) as distance_delta_m, alt as altitude_delta_m, round(case when step > 0 and gap > 0 then gap / 60.0 / (step / 1000.0) end, 6) as pace,
 running_cadence * 2 as cadence, heart_rate, record_distance_m, altitude_m, cast(floor(lat / 0.004) as bigint) * 100000 + cast(floor(lon / 0.004) as bigint) as cell_8, cast(floor(lat / 0.002) as bigint) * 100000 + cast(floor(lon / 0.002) as bigint) as cell_9,
 lat is not null and lon is not null as has_point, lat, lon from (select *, elapsed_seconds - lag(elapsed_seconds) over w as gap, record_distance_m - lag(record_distance_m) over w as step, altitude_m - lag(altitude_m) over w as alt from {_U} u window w as (partition by run_id order by ix)) y)"""
R.query("MD03_sequence_records", f"select * from {SEQ} s")(lambda t: sequence_records(t.vgeo))


def sessions(records: DataFrame, events: DataFrame) -> DataFrame:
    """One row a run from one pass over its records, with the timer events' last stop as recovery event."""
    at = C("record_index")
    known = F.when(C("heart_rate").isNotNull(), at)
    per_run = records.groupBy("run_id", "subject").agg(
        (F.max("record_distance_m") / 1000.0).alias("distance_km"), F.max("elapsed_seconds").alias("duration_seconds"), F.round(F.avg("heart_rate"), 6).alias("avg_heart_rate"), F.max_by("heart_rate", known).alias("last_heart_rate"),
        F.count("*").alias("record_count"), F.count("lat").alias("gps_count"), F.min("record_timestamp").alias("first_ts"), F.max("record_timestamp").alias("last_ts"),
        F.min_by("lat", at).alias("start_lat"), F.min_by("lon", at).alias("start_lon"), F.max_by("lat", at).alias("end_lat"), F.max_by("lon", at).alias("end_lon"), (F.max_by("k", at) + 60).cast("double").alias("_k"),
    )
    stops = events.where("et = 'stop_all'").groupBy("run_id").agg(F.max("t").alias("recovery_t"))
    recovery = F.when(C("recovery_t").isNotNull(), C("_k"))
    return per_run.join(stops, "run_id", "left").select(
        "run_id", "subject", "distance_km", "duration_seconds", F.round(S.pace_min_per_km(C("duration_seconds"), C("distance_km")), 6).alias("pace"), F.round(S.ratio(C("distance_km"), C("duration_seconds").cast("double")) * 3600, 6).alias("speed_kmh"),
        "avg_heart_rate", "last_heart_rate", recovery.alias("recovery_heart_rate"), (C("last_heart_rate") - recovery).alias("recovery_drop"), "record_count", "gps_count", F.round(C("gps_count") / C("record_count"), 6).alias("gps_coverage"), "first_ts", "last_ts",
        "start_lat", "start_lon", "end_lat", "end_lon", "recovery_t",
    )


R.query("MD02_sessions", """select a.run_id, subject, distance_km, duration_seconds, round(case when distance_km > 0 and duration_seconds > 0 then duration_seconds / 60.0 / distance_km end, 6) as pace, round(distance_km / nullif(duration_seconds, 0) * 3600, 6) as speed_kmh, avg_heart_rate, last_heart_rate,
 case when recovery_t is not null then lk end as recovery_heart_rate, last_heart_rate - case when recovery_t is not null then lk end as recovery_drop, record_count, gps_count, round(gps_count / record_count::double, 6) as gps_coverage, first_ts, last_ts, start_lat, start_lon, end_lat, end_lon, recovery_t
 from (select run_id, subject, max(record_distance_m) / 1000.0 as distance_km, max(elapsed_seconds) as duration_seconds, round(avg(heart_rate), 6) as avg_heart_rate, max(case when known = 1 and heart_rate is not null then heart_rate end) as last_heart_rate, count(*) as record_count, count(lat) as gps_count,
  min(record_timestamp) as first_ts, max(record_timestamp) as last_ts, max(case when f = 1 then lat end) as start_lat, max(case when f = 1 then lon end) as start_lon, max(case when l = 1 then lat end) as end_lat, max(case when l = 1 then lon end) as end_lon, max(case when l = 1 then cast(k + 60 as double) end) as lk
  from (select *, row_number() over (partition by run_id order by record_index) as f, row_number() over (partition by run_id order by record_index desc) as l, row_number() over (partition by run_id order by heart_rate is null, record_index desc) as known from {vgeo} g) x group by run_id, subject) a
 left join (select run_id, max(t) as recovery_t from {vevt} e where et = 'stop_all' group by run_id) b on a.run_id = b.run_id""")(lambda t: sessions(t.vgeo, t.vevt))

R.query("MD12_activity_records", "select run_id, event_id, record_index, record_timestamp, elapsed_seconds, record_distance_m / 1000.0 as distance_km, heart_rate, running_cadence, altitude_m from {vrec} r")(
    lambda t: t.vrec.select("run_id", "event_id", "record_index", "record_timestamp", "elapsed_seconds", (C("record_distance_m") / 1000.0).alias("distance_km"), "heart_rate", "running_cadence", "altitude_m"))


def downsample_even(records: DataFrame, n: int = 500) -> DataFrame:
    """All rows of runs of up to n rows, else n evenly spread ones with the first and the last.

    Position floor(i * (total - 1) / (n - 1)) + 1 for i = 0 .. n - 1: a row is one of them iff the only i that could give it does; no join.
    """
    rows = records.withColumn("_total", F.count("*").over(Window.partitionBy("run_id")))
    at, last = C("record_index") - 1, C("_total") - 1
    i = F.floor((at * (n - 1) + last - 1) / F.nullif(last, F.lit(0)))  # the least i with i * last >= at * (n - 1)
    whole = lambda k: F.floor(k * last / F.lit(n - 1))
    return rows.where((C("_total") <= n) | (whole(i) == at)).drop("_total")


R.query("MD13_downsample", "select run_id, record_index from (select run_id, record_index, count(*) over (partition by run_id) as n from {vrec} r) x where n <= 5 or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1)")(
    lambda t: downsample_even(t.vrec, 5).select("run_id", "record_index"))

STATES = ("start", "stop", "stop_all", "stop_disable", "stop_disable_all")


def timer_windows(events: DataFrame) -> DataFrame:
    """(run_id, window_start, window_end): each start paired with the next state event if that is a later stop; doubles of an instant and type count once."""
    unique = events.where(C("et").isin(*STATES)).groupBy("run_id", "t", "et").agg(F.min("record_index").alias("record_index"))
    nxt = F.lead(F.struct("t", "et")).over(Window.partitionBy("run_id").orderBy("record_index"))
    return unique.withColumn("_n", nxt).where("et = 'start' and _n.et like 'stop%' and _n.t > t").select("run_id", C("t").alias("window_start"), C("_n.t").alias("window_end"))


def timer_context(events: DataFrame) -> DataFrame:
    """Starts, stops, windows and timed seconds of each run with timer events."""
    counts = events.where(C("et").isin(*STATES)).select("run_id", "t", "et").distinct().groupBy("run_id").agg(F.count_if(C("et") == "start").alias("starts"), F.count_if(C("et") != "start").alias("stops"))
    windows = timer_windows(events).groupBy("run_id").agg(F.count("*").alias("windows"), F.sum(C("window_end") - C("window_start")).alias("timer_seconds"))
    return counts.join(windows, "run_id", "left").select("run_id", "starts", "stops", F.coalesce("windows", F.lit(0)).alias("windows"), "timer_seconds")


_UE = "(select run_id, t, et, min(record_index) as record_index from {vevt} e group by run_id, t, et)"
WIN = f"(select run_id, t as window_start, nt as window_end from (select *, lead(t) over (partition by run_id order by record_index) as nt, lead(et) over (partition by run_id order by record_index) as ne from {_UE} u) q where et = 'start' and ne like 'stop%' and nt > t)"
CTX = f"(select c.run_id, starts, stops, coalesce(windows, 0) as windows, timer_seconds from (select run_id, count(*) filter (where et = 'start') as starts, count(*) filter (where et <> 'start') as stops from {_UE} u group by run_id) c left join (select run_id, count(*) as windows, cast(sum(window_end - window_start) as bigint) as timer_seconds from {WIN} w group by run_id) d on c.run_id = d.run_id)"
R.query("MD15_timer_windows", f"select * from {CTX} c")(lambda t: timer_context(t.vevt))


def half_intervals(records: DataFrame, windows: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Each record's interval with its timer-running seconds and distance, and how both divide at half of the run's timer distance."""
    distance = F.coalesce(F.max("record_distance_m").over(SO_FAR()), F.lit(0.0))
    rows = records.withColumn("_d", distance)
    prev = F.lag(F.struct(C("elapsed_seconds").alias("t"), C("_d").alias("d"), "heart_rate")).over(RUN())
    rows = rows.withColumn("_p", prev).select(
        "run_id", "record_index", F.coalesce("_p.t", "elapsed_seconds").alias("a"), C("elapsed_seconds").alias("b"), F.greatest(C("_d") - F.coalesce("_p.d", "_d"), F.lit(0.0)).alias("_step"),
        F.when((C("heart_rate") > 0) & (C("_p.heart_rate") > 0), (C("heart_rate") + C("_p.heart_rate")) / 2.0).alias("hr"),
    )
    timed = interval_overlap(rows, windows, "run_id", ("a", "b"), ("window_start", "window_end"), slice_seconds).withColumnRenamed("overlap", "sec")
    timed = timed.withColumn("m", F.when(C("b") > C("a"), C("_step") * C("sec") / (C("b") - C("a"))).otherwise(0.0))
    end, total = F.sum("m").over(SO_FAR()), F.sum("m").over(Window.partitionBy("run_id"))
    timed = timed.withColumns({"_end": end, "_mid": total / 2.0}).withColumn("_start", C("_end") - C("m"))
    first = F.greatest(F.least("_mid", "_end") - C("_start"), F.lit(0.0))
    second = F.greatest(C("_end") - F.greatest("_mid", "_start"), F.lit(0.0))
    timed = timed.withColumns({"m1": first, "m2": second})

    def seconds(part: str, still: Column) -> Column:
        return F.when(C("sec") <= 0, 0.0).when(C("m") > 0, C("sec") * C(part) / C("m")).when(still, C("sec")).otherwise(0.0)

    return timed.select("run_id", "record_index", "sec", "m", "m1", "m2", seconds("m1", C("_start") < C("_mid")).alias("s1"), seconds("m2", C("_start") >= C("_mid")).alias("s2"), "hr", ((C("sec") > 0) & C("hr").isNotNull()).alias("has_hr"))


def half_split(intervals: DataFrame) -> DataFrame:
    """One row a run: distance, seconds, heart rate and coverage of each half, and the longest stretch without heart rate."""
    on = lambda c: F.sum(F.when(C("has_hr"), C(c)).otherwise(0.0))
    silent = F.sum(F.when((C("sec") > 0) & ~C("has_hr"), C("sec")).otherwise(0.0)).over(SO_FAR())
    rows = intervals.withColumn("_silent", silent)
    rows = rows.withColumn("_gap", C("_silent") - F.coalesce(F.max(F.when(C("has_hr"), C("_silent"))).over(SO_FAR()), F.lit(0.0)))  # since the last heart rate
    per_run = rows.groupBy("run_id").agg(F.sum("m").alias("distance_m"), F.max("_gap").alias("max_gap"), F.sum("sec").alias("seconds"), *[F.sum(c).alias(c) for c in ("m1", "m2", "s1", "s2")], *[on(f"s{i}").alias(f"_h{i}") for i in (1, 2)],
                                                    *[F.sum(F.when(C("has_hr"), C("hr") * C(f"s{i}")).otherwise(0.0)).alias(f"_w{i}") for i in (1, 2)])
    return per_run.select("run_id", "distance_m", "seconds", "m1", "m2", "s1", "s2", *[S.ratio(C(f"_h{i}"), C(f"s{i}")).alias(f"coverage{i}") for i in (1, 2)],
                                                       *[S.ratio(C(f"_w{i}"), C(f"_h{i}")).alias(f"hr{i}") for i in (1, 2)], "max_gap")


_HI = f"""(select *, case when sec <= 0 then 0 when m > 0 then sec * m1 / m when st < mid then sec else 0 end as s1, case when sec <= 0 then 0 when m > 0 then sec * m2 / m when st >= mid then sec else 0 end as s2, sec > 0 and hr is not null as has_hr from
 (select *, greatest(least(mid, en) - st, 0) as m1, greatest(en - greatest(mid, st), 0) as m2 from (select *, en - m as st from
 (select *, sum(m) over (partition by run_id order by record_index) as en, sum(m) over (partition by run_id) / 2 as mid from
 (select *, case when b > a then step * sec / (b - a) else 0.0 end as m from (select i.run_id, i.record_index, i.a, i.b, i.step, i.hr, coalesce(sum(case when w.window_end is not null then cast(greatest(least(i.b, w.window_end) - greatest(i.a, w.window_start), 0) as double) end), 0.0) as sec
  from (select run_id, record_index, coalesce(lag(elapsed_seconds) over w, elapsed_seconds) as a, elapsed_seconds as b, greatest(d - coalesce(lag(d) over w, d), 0) as step, case when heart_rate > 0 and lag(heart_rate) over w > 0 then (heart_rate + lag(heart_rate) over w) / 2.0 end as hr
   from (select *, coalesce(max(record_distance_m) over (partition by run_id order by record_index), 0.0) as d from {{vrec}} r) x window w as (partition by run_id order by record_index)) i
  left join {WIN} w on i.run_id = w.run_id and i.a < w.window_end and i.b > w.window_start group by 1, 2, 3, 4, 5, 6) y) z) z2) z3) z4)"""
HALF = f"""(select p.*, coalesce(max_gap, 0.0) as max_gap from (select run_id, sum(m) as distance_m, sum(sec) as seconds, sum(m1) as m1, sum(m2) as m2, sum(s1) as s1, sum(s2) as s2, sum(case when has_hr then s1 else 0 end) / nullif(sum(s1), 0) as coverage1, sum(case when has_hr then s2 else 0 end) / nullif(sum(s2), 0) as coverage2,
 sum(case when has_hr then hr * s1 else 0 end) / nullif(sum(case when has_hr then s1 else 0 end), 0) as hr1, sum(case when has_hr then hr * s2 else 0 end) / nullif(sum(case when has_hr then s2 else 0 end), 0) as hr2 from {_HI} h group by run_id) p
 left join (select run_id, max(x) as max_gap from (select run_id, g, sum(sec) as x from (select *, sum(case when has_hr then 1 else 0 end) over (partition by run_id order by record_index) as g from {_HI} h2) h3 where sec > 0 and not has_hr group by run_id, g) h4 group by run_id) q on p.run_id = q.run_id)"""
_HALF_COLS = ("distance_m", "seconds", "m1", "m2", "s1", "s2", "coverage1", "coverage2", "hr1", "hr2", "max_gap")


def halves_of(t, events: DataFrame | None = None) -> DataFrame:
    return half_split(half_intervals(t.vrec, timer_windows(t.vevt if events is None else events), 500))


R.query("MD16_half_split", f"select run_id, {', '.join(f'round({c}, 5) as {c}' for c in _HALF_COLS)} from {HALF} h")(lambda t: halves_of(t).select("run_id", *[F.round(c, 5).alias(c) for c in _HALF_COLS]))


def efficiency_trace(records: DataFrame, min_speed: float = 1.8, max_gap: int = 10, warm_up: int = 300, base: int = 900, recent: int = 600, low: float = 80.0, high: float = 120.0, samples: int = 30) -> DataFrame:
    """Points of a run: recent efficiency in percent of an earlier baseline, clamped, with confidence; a record without heart
    rate is no reason for exclusion. Speed is smoothed over five rows; both windows share the second where they meet."""
    w = Window.partitionBy("run_id").orderBy("elapsed_seconds", "record_index")
    prev = F.lag(F.struct("elapsed_seconds", "record_distance_m")).over(RUN())
    rows = records.withColumn("_p", prev).withColumn("gap", C("elapsed_seconds") - C("_p.elapsed_seconds")).where("gap > 0")
    rows = rows.withColumn("speed", (C("record_distance_m") - C("_p.record_distance_m")) / C("gap") * 3.6).withColumn("smooth", F.avg("speed").over(w.rowsBetween(-2, 2)))
    out = F.coalesce((C("smooth") < min_speed) | (C("gap") > max_gap) | (C("elapsed_seconds") < warm_up) | (C("heart_rate") <= 0) | (C("smooth") <= 0), F.lit(False))
    rows = rows.withColumn("excluded", out).withColumn("eff", F.when((C("smooth") > 0) & (C("heart_rate") > 0), C("smooth") / C("heart_rate")))
    seconds = Window.partitionBy("run_id").orderBy("elapsed_seconds")
    before, now = seconds.rangeBetween(-base, -recent), seconds.rangeBetween(-recent, 0)
    used = F.when(~C("excluded"), C("eff"))
    rows = rows.withColumns({"b": F.avg(used).over(before), "r": F.avg(used).over(now), "nb": F.count(F.when(~C("excluded"), 1)).over(before), "nr": F.count(F.when(~C("excluded"), 1)).over(now)})
    n = F.least("nb", "nr")
    return rows.select("run_id", "record_index", "elapsed_seconds", F.round(C("record_distance_m") / 1000.0, 3).alias("distance_km"), F.round(F.when(C("excluded"), None).when((C("b") > 0) & (C("r") > 0), F.greatest(F.lit(low), F.least(F.lit(high), 100.0 * C("r") / C("b")))), 1).alias("efficiency"),
                       F.when(C("excluded"), 0.0).when(n >= samples, 1.0).when(n >= 5, 0.5).otherwise(0.2).alias("confidence"), "excluded")


_RG = "over (partition by run_id order by elapsed_seconds range between"
TRACE = f"""(select run_id, record_index, elapsed_seconds, round(record_distance_m / 1000.0, 3) as distance_km, round(case when excluded then null when b > 0 and r > 0 then greatest(80.0, least(120.0, 100.0 * r / b)) end, 1) as efficiency, case when excluded then 0.0 when least(nb, nr) >= 6 then 1.0 when least(nb, nr) >= 5 then 0.5 else 0.2 end as confidence, excluded
 from (select *, avg(case when not excluded then eff end) {_RG} 900 preceding and 300 preceding) as b, avg(case when not excluded then eff end) {_RG} 300 preceding and current row) as r, count(case when not excluded then 1 end) {_RG} 900 preceding and 300 preceding) as nb, count(case when not excluded then 1 end) {_RG} 300 preceding and current row) as nr
 from (select *, case when smooth > 0 and heart_rate > 0 then smooth / heart_rate end as eff, coalesce(smooth < 0.1 or gap > 400 or elapsed_seconds < 60 or heart_rate <= 0 or smooth <= 0, false) as excluded
 from (select *, avg(speed) over (partition by run_id order by elapsed_seconds, record_index rows between 2 preceding and 2 following) as smooth from (select *, (record_distance_m - pd) / gap * 3.6 as speed
 from (select *, elapsed_seconds - lag(elapsed_seconds) over w as gap, lag(record_distance_m) over w as pd from {{vrec}} r window w as (partition by run_id order by record_index)) a where gap > 0) b0) c0) d0) e0)"""


def trace_of(t) -> DataFrame:
    return efficiency_trace(t.vrec, 0.1, 400, 60, 900, 300, samples=6)


R.query("MD18_efficiency_trace", f"select * from {TRACE} t")(trace_of)


def trace_documents(points: DataFrame, runs: DataFrame, warm_up: int = 300, recent: int = 600, samples: int = 30) -> DataFrame:
    """One row a run: its points as an ordered array, valid samples, and why there is no drift."""
    doc = points.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("record_index", "distance_km", "efficiency", "confidence", "excluded"))).alias("points"), F.count_if(~C("excluded")).alias("valid"), F.max("elapsed_seconds").alias("seconds"))
    reason = F.when(C("seconds") < warm_up + recent, "insufficient_duration").when(C("valid") < samples, "insufficient_valid_samples")
    return runs.select("run_id").join(doc, "run_id", "left").select("run_id", F.coalesce(F.to_json("points"), F.lit("[]")).alias("trace"), F.coalesce("valid", F.lit(0)).alias("valid_samples"), F.coalesce("seconds", F.lit(0)).alias("seconds"), reason.alias("reason"))


R.query("MD18_trace_documents", f"select r.run_id, coalesce(n, 0) as n_points, coalesce(valid, 0) as valid_samples, coalesce(seconds, 0) as seconds, case when seconds < 360 then 'insufficient_duration' when valid < 6 then 'insufficient_valid_samples' end as reason from {{vrun}} r left join (select run_id, count(*) as n, count(*) filter (where not excluded) as valid, max(elapsed_seconds) as seconds from {TRACE} t group by run_id) d on r.run_id = d.run_id")(
    lambda t: trace_documents(trace_of(t), t.vrun, 60, 300, 6).select("run_id", F.coalesce(F.json_array_length("trace"), F.lit(0)).cast("long").alias("n_points"), "valid_samples", "seconds", "reason"))


def heart_economy(records: DataFrame) -> DataFrame:
    """Beats, metres a beat and climb a beat of each run, over records with heart rate and a gap before them."""
    prev = F.lag(F.struct("elapsed_seconds", "altitude_m")).over(RUN())
    rows = records.withColumn("_p", prev).withColumn("gap", C("elapsed_seconds") - C("_p.elapsed_seconds")).where("heart_rate is not null and gap > 0")
    climb = C("altitude_m") - C("_p.altitude_m")
    per_run = rows.groupBy("run_id").agg(F.sum(C("heart_rate") * C("gap") / 60.0).alias("beats"), F.max("record_distance_m").alias("m"), F.sum(F.when(climb > 0, climb).otherwise(0.0)).alias("up"))
    return per_run.select("run_id", F.round("beats", 6).alias("beats"), F.round(S.ratio(C("m"), C("beats")), 9).alias("m_per_beat"), F.round(S.ratio(C("up"), C("beats")), 9).alias("climb_per_beat"))


ECO = """(select run_id, round(sum(heart_rate * gap / 60.0), 6) as beats, round(max(record_distance_m) / nullif(sum(heart_rate * gap / 60.0), 0), 9) as m_per_beat, round(sum(case when climb > 0 then climb else 0 end) / nullif(sum(heart_rate * gap / 60.0), 0), 9) as climb_per_beat
 from (select *, elapsed_seconds - lag(elapsed_seconds) over w as gap, altitude_m - lag(altitude_m) over w as climb from {vrec} r window w as (partition by run_id order by record_index)) x where heart_rate is not null and gap > 0 group by run_id)"""
R.query("MD19_heart_economy", f"select * from {ECO} e")(lambda t: heart_economy(t.vrec))
