"""Gates on half-to-half efficiency, trailing personal baselines, recovery and drift summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.distributed import quantiles, sliding_quantiles
from ..operators.joins import trailing_sum
from ..registry import Registry
from ..session import cut
from . import segments, telemetry

R = Registry()
C = F.col


@dataclass(frozen=True)
class Gates:
    """Least or greatest values that a run's halves need to be compared."""

    seconds: float = 1200.0
    metres: float = 5000.0
    segments: int = 8
    segment_m: float = 249.5
    segment_kmh: float = 1.8
    coverage: float = 0.8
    gap_seconds: float = 30.0
    reconcile_seconds: float = 2.0


#: Thresholds for the compressed telemetry of the driver's tables.
SMALL = Gates(seconds=300, metres=200, segments=1, segment_m=100, segment_kmh=0.01, coverage=0.3, gap_seconds=500, reconcile_seconds=2)


def decoupling(halves: DataFrame, context: DataFrame, sessions: DataFrame, valid_segments: DataFrame, g: Gates = Gates()) -> DataFrame:
    """Efficiency of the first half over the second, minus 1, where nine gates hold; else the first gate that fails, and all that do.

    A comparison with a missing value doesn't fail its gate. A run without timed telemetry is ineligible.
    """
    q = halves.join(context, "run_id", "left").join(sessions.select("run_id", C("timer_seconds").alias("session_seconds")), "run_id", "left").join(valid_segments, "run_id", "left")
    q = q.withColumns({"n_segments": F.coalesce("n_segments", F.lit(0)), "speed1": S.ratio(C("m1"), C("s1")) * 3.6, "speed2": S.ratio(C("m2"), C("s2")) * 3.6, "coverage": S.ratio(C("s1") * C("coverage1") + C("s2") * C("coverage2"), C("seconds"))})
    invalid = (C("starts") == 0) | (C("starts") != C("stops")) | (C("windows") != C("starts")) | C("timer_seconds").isNull() | C("session_seconds").isNull() | (F.abs(C("timer_seconds") - C("session_seconds")) > g.reconcile_seconds)
    fine = ~invalid
    checks = {
        "invalid_timer_events": invalid,
        "incomplete_timer_telemetry": fine & (F.abs(C("seconds") - C("timer_seconds")) > g.reconcile_seconds),
        "insufficient_timer_running_duration": fine & (C("seconds") < g.seconds),
        "insufficient_timer_running_distance": fine & (C("distance_m") < g.metres),
        "insufficient_valid_segments": fine & (C("n_segments") < g.segments),
        "insufficient_hr_coverage": fine & ((C("coverage") < g.coverage) | (C("coverage1") < g.coverage) | (C("coverage2") < g.coverage)),
        "excessive_hr_gap": fine & (C("max_gap") > g.gap_seconds),
        "missing_half_heart_rate": fine & (C("hr1").isNull() | C("hr2").isNull()),
        "invalid_half_speed": fine & ((C("speed1") <= 0) | (C("speed2") <= 0)),
    }
    failed = F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull())
    q = q.withColumns({"failed_gates": failed, "eff1": S.ratio(C("speed1"), C("hr1")), "eff2": S.ratio(C("speed2"), C("hr2"))})
    reason = F.when(F.size("failed_gates") > 0, C("failed_gates")[0])
    out = sessions.select("run_id").join(q.withColumn("_known", F.lit(True)), "run_id", "left")
    reason = F.when(C("_known").isNull(), "missing_timer_telemetry").otherwise(reason)
    return out.withColumn("reason", reason).select("run_id", F.when(C("reason").isNull(), "eligible").otherwise("ineligible").alias("status"), "reason", F.coalesce(F.array_join("failed_gates", ","), F.lit("")).alias("failed_gates"), F.when(C("reason").isNull(), S.ratio(C("eff1"), C("eff2")) - 1).alias("decoupling"),
                                                    "seconds", "distance_m", "n_segments", "coverage", "max_gap", "speed1", "speed2", "hr1", "hr2", "eff1", "eff2", "m1", "m2")


def valid_segments(cells: DataFrame, g: Gates) -> DataFrame:
    return cells.where((C("length_m") == 250.0) & (C("distance_m") >= g.segment_m) & (C("seconds") > 0) & (C("speed_kmh") >= g.segment_kmh) & (C("avg_heart_rate") > 0)).groupBy("run_id").agg(F.count("*").alias("n_segments"))


def decoupling_of(t, g: Gates = SMALL) -> DataFrame:
    events = cut(t.vevt)  # few rows of a run, asked for three times
    context = telemetry.timer_context(events)
    totals = t.vrun.join(context.select("run_id", C("timer_seconds").alias("s")), "run_id", "left").select("run_id", C("s").alias("timer_seconds"))
    return decoupling(telemetry.halves_of(t, events), context, totals, valid_segments(segments.segments_of(t, (250.0,)), g), g)


def _gates_sql(g: Gates) -> dict[str, str]:
    return {
        "invalid_timer_events": "bad", "incomplete_timer_telemetry": f"not bad and abs(seconds - timer_seconds) > {g.reconcile_seconds}",
        "insufficient_timer_running_duration": f"not bad and seconds < {g.seconds}", "insufficient_timer_running_distance": f"not bad and distance_m < {g.metres}",
        "insufficient_valid_segments": f"not bad and n_segments < {g.segments}", "insufficient_hr_coverage": f"not bad and (coverage < {g.coverage} or coverage1 < {g.coverage} or coverage2 < {g.coverage})",
        "excessive_hr_gap": f"not bad and max_gap > {g.gap_seconds}", "missing_half_heart_rate": "not bad and (hr1 is null or hr2 is null)", "invalid_half_speed": "not bad and (speed1 <= 0 or speed2 <= 0)",
    }


_DEC_COLS = ("decoupling", "seconds", "distance_m", "coverage", "max_gap", "speed1", "speed2", "hr1", "hr2", "m1", "m2")
def dec_sql(g: Gates) -> str:
    """`decoupling_of` as SQL text for comparison."""
    halves = f"""(select h.*, c.starts, c.stops, c.windows, c.timer_seconds, coalesce(v.n, 0) as n_segments, m1 / nullif(s1, 0) * 3.6 as speed1, m2 / nullif(s2, 0) * 3.6 as speed2, (s1 * coverage1 + s2 * coverage2) / nullif(seconds, 0) as coverage,
 starts = 0 or starts <> stops or windows <> starts or timer_seconds is null as bad from {telemetry.HALF} h left join {telemetry.CTX} c on h.run_id = c.run_id
 left join (select run_id, count(*) as n from {segments.SEG} s where length_m = 250 and distance_m >= {g.segment_m} and seconds > 0 and speed_kmh >= {g.segment_kmh} and avg_heart_rate > 0 group by run_id) v on h.run_id = v.run_id)"""
    failed = ", ".join(f"case when {c} then '{n}' end" for n, c in _gates_sql(g).items())
    return f"""(select r.run_id, case when q.run_id is null or reason <> '' then 'ineligible' else 'eligible' end as status, case when q.run_id is null then 'missing_timer_telemetry' else nullif(reason, '') end as reason, coalesce(failed, '') as failed_gates,
 case when q.run_id is not null and reason = '' then speed1 / nullif(hr1, 0) / nullif(speed2 / nullif(hr2, 0), 0) - 1 end as decoupling, seconds, distance_m, n_segments, coverage, max_gap, speed1, speed2, hr1, hr2, speed1 / nullif(hr1, 0) as eff1, speed2 / nullif(hr2, 0) as eff2, m1, m2 from {{vrun}} r left join
 (select *, split_part(failed, ',', 1) as reason from (select *, concat_ws(',', {failed}) as failed from {halves} q0) q1) q on r.run_id = q.run_id)"""


DEC = dec_sql(SMALL)
R.query("MD17_decoupling_gates", f"select run_id, status, reason, failed_gates, n_segments, {', '.join(f'round({c}, 5) as {c}' for c in _DEC_COLS)} from {DEC} d")(
    lambda t: decoupling_of(t).select("run_id", "status", "reason", "failed_gates", "n_segments", *[F.round(c, 5).alias(c) for c in _DEC_COLS]))


def fitness_signals(runs: DataFrame) -> DataFrame:
    """Signals of each run of a subject: efficiency, heart-rate band, means of four runs, and baselines over the 90 days before.

    `runs`: subject, run_id, activity_date, distance, duration_seconds, avg_heart_rate, ending_heart_rate, recovery_drop; and m_per_beat,
    if metres a beat are known from records, else they come from the means.
    Recovery is compared within bands of ten of the ending heart rate; quartiles are observed values and need four runs.
    """
    km = C("distance").cast("double")
    speed = S.ratio(km, C("duration_seconds").cast("double")) * 3600
    economy = C("m_per_beat") if "m_per_beat" in runs.columns else F.when(C("avg_heart_rate") > 0, km * 1000 / (C("avg_heart_rate") * C("duration_seconds") / 60.0))
    rows = runs.withColumns({"efficiency": F.when(C("avg_heart_rate") > 0, speed / C("avg_heart_rate")), "hr_band": S.heart_rate_band(C("avg_heart_rate")), "economy": economy})
    band = F.when(C("ending_heart_rate") > 0, F.floor(C("ending_heart_rate") / 10) * 10)
    rows = rows.withColumn("_band", band).withColumn("_rec", F.when((C("recovery_drop") > 0) & (C("ending_heart_rate") > 0), C("recovery_drop"))).withColumn("_day", F.unix_date("activity_date").cast("long"))
    along = Window.partitionBy("subject").orderBy("activity_date", "run_id")
    same = Window.partitionBy("subject", "_band").orderBy("_day").rangeBetween(-90, -1)
    prior = Window.partitionBy("subject").orderBy("_day").rangeBetween(-90, -1)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    per_day = runs.groupBy("subject", "activity_date").agg(F.sum("distance").alias("_dist"))
    load = per_day.select("subject", "activity_date", F.coalesce(trailing_sum(per_day, "subject", "activity_date", "_dist", 7, 1).cast("double"), F.lit(0.0)).alias("prior_7d"))
    quartiles = sliding_quantiles(rows, ["subject", "_band"], "_day", "_rec", {"recovery_q1": 0.25, "recovery_median": 0.5, "recovery_q3": 0.75}).drop("n")
    quartiles = quartiles.select(C("subject").alias("_qs"), C("_band").alias("_qb"), C("_day").alias("_qd"), "recovery_q1", "recovery_median", "recovery_q3")
    rows = rows.join(quartiles, C("subject").eqNullSafe(C("_qs")) & C("_band").eqNullSafe(C("_qb")) & (C("_day") == C("_qd")), "left").drop("_qs", "_qb", "_qd")
    rows = rows.join(load, ["subject", "activity_date"]).withColumns({
        "efficiency_4": F.avg("efficiency").over(along.rowsBetween(-3, 0)), "recovery_4": F.avg("recovery_drop").over(along.rowsBetween(-3, 0)), "recovery_count": F.count("_rec").over(same), "recovery_min": F.min("_rec").over(same), "recovery_max": F.max("_rec").over(same),
        "_expected": F.avg("economy").over(prior), "_n": F.count("economy").over(prior), "previous_economy": F.last("economy", True).over(before), "previous_prior_7d": F.last("prior_7d", True).over(before),
    })
    enough = C("recovery_count") >= 4
    score = F.when((C("_n") >= 3) & (C("_expected") > 0) & C("economy").isNotNull(), 100 * C("economy") / C("_expected"))
    return rows.select("subject", "run_id", "activity_date", "hr_band", "prior_7d", "recovery_count", *[F.when(enough, C(f"recovery_{n}")).alias(f"recovery_{n}") for n in ("q1", "median", "q3", "min", "max")], "previous_prior_7d",
                       *[F.round(c, 6).alias(n) for n, c in (("efficiency", C("efficiency")), ("efficiency_4", C("efficiency_4")), ("recovery_4", C("recovery_4")), ("economy", C("economy")), ("previous_economy", C("previous_economy")), ("score", score))])


_BAND = "case " + " ".join(f"when avg_heart_rate between {b} and {b + 9} then '{b}-{b + 9}'" for b in range(100, 170, 10)) + " else 'other' end"
_SAME = "over (partition by subject, band order by activity_date range between interval 90 days preceding and interval 1 day preceding)"
_PRIOR = "over (partition by subject order by activity_date range between interval 90 days preceding and interval 1 day preceding)"
_ALONG = "over (partition by subject order by activity_date, run_id rows between"
def _fit_sql(runs: str, economy: str) -> str:
    return f"""(select subject, run_id, activity_date, hr_band, prior_7d, n as recovery_count, {", ".join(f"case when n >= 4 then {c} end as recovery_{c}" for c in ("q1", "median", "q3", "min", "max"))}, previous_prior_7d, round(efficiency, 6) as efficiency, round(efficiency_4, 6) as efficiency_4, round(recovery_4, 6) as recovery_4, round(economy, 6) as economy, round(previous_economy, 6) as previous_economy,
  round(case when ne >= 3 and expected > 0 and economy is not null then 100 * economy / expected end, 6) as score from
 (select *, avg(efficiency) {_ALONG} 3 preceding and current row) as efficiency_4, avg(recovery_drop) {_ALONG} 3 preceding and current row) as recovery_4, count(rec) {_SAME} as n, {", ".join(f"quantile_disc(rec, {q}) {_SAME} as {c}" for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))}, min(rec) {_SAME} as "min", max(rec) {_SAME} as "max",
  avg(economy) {_PRIOR} as expected, count(economy) {_PRIOR} as ne, last_value(economy ignore nulls) {_ALONG} unbounded preceding and 1 preceding) as previous_economy, last_value(prior_7d ignore nulls) {_ALONG} unbounded preceding and 1 preceding) as previous_prior_7d from
 (select v.*, {_BAND} as hr_band, case when avg_heart_rate > 0 then cast(v.distance as double) / nullif(duration_seconds, 0) * 3600 / avg_heart_rate end as efficiency, {economy} as economy, case when ending_heart_rate > 0 then floor(ending_heart_rate / 10) * 10 end as band,
  case when recovery_drop > 0 and ending_heart_rate > 0 then recovery_drop end as rec, l.prior_7d from {runs} v join (select subject, activity_date, coalesce(cast(sum(d) over (partition by subject order by activity_date range between interval 7 days preceding and interval 1 day preceding) as double), 0.0) as prior_7d from
  (select subject, activity_date, sum(distance) as d from {runs} n group by 1, 2) x) l on v.subject = l.subject and v.activity_date = l.activity_date) a) b)"""


FIT = _fit_sql("{vnat}", "case when avg_heart_rate > 0 then cast(v.distance as double) * 1000 / (avg_heart_rate * duration_seconds / 60.0) end")
R.query("MD20_fitness_signals", f"select * from {FIT} f")(lambda t: fitness_signals(t.vnat))


def signals_with_week(signals: DataFrame, weeks: DataFrame) -> DataFrame:
    """Signals with the distance, runs and streak of their week."""
    w = weeks.select(C("subject").alias("_s"), C("week_start_date").alias("_w"), C("distance").alias("week_distance"), C("run_count").alias("week_runs"), "active_week_streak")
    return signals.join(w, (C("subject") == C("_s")) & (S.week_start(C("activity_date")) == C("_w")), "left").drop("_s", "_w")


def _signals_week(t):
    from .rollups import weeks_of

    return signals_with_week(fitness_signals(t.vnat), weeks_of(t)).select("run_id", "efficiency", "week_distance", "week_runs", "active_week_streak")


def _week_sql():
    from .rollups import WEEKS

    return f"select run_id, efficiency, w.distance as week_distance, w.run_count as week_runs, w.active_week_streak from {FIT} f left join {WEEKS} w on f.subject = w.subject and cast(date_trunc('week', f.activity_date) as date) = w.week_start_date"


R.query("MD21_signals_week", _week_sql())(_signals_week)


def recovery_trend(points: DataFrame, days: int = 21) -> DataFrame:
    """Class of each recovery against its own baseline (3 beats either way are typical), with spread; only the last `days` days of a subject."""
    latest = F.max("activity_date").over(Window.partitionBy("subject"))
    delta = C("recovery_drop") - C("recovery_median")
    rows = points.withColumn("_latest", latest).where(F.datediff("_latest", "activity_date") < days)
    kind = F.when((C("recovery_count") < 4) | C("recovery_median").isNull() | C("recovery_drop").isNull(), "unavailable").when(delta > 3, "better").when(delta < -3, "worse").otherwise("typical")
    return rows.select("subject", "run_id", kind.alias("recovery_class"), delta.alias("delta"), (C("recovery_q3") - C("recovery_q1")).alias("iqr"), (C("recovery_count") <= 5).alias("provisional"), F.datediff("_latest", "activity_date").cast("long").alias("days_before_latest"))


R.query("MD33_recovery_trend", f"""select subject, run_id, case when recovery_count < 4 or recovery_median is null or recovery_drop is null then 'unavailable' when recovery_drop - recovery_median > 3 then 'better' when recovery_drop - recovery_median < -3 then 'worse' else 'typical' end as recovery_class, recovery_drop - recovery_median as delta,
 recovery_q3 - recovery_q1 as iqr, recovery_count <= 5 as provisional, date_diff('day', activity_date, latest) as days_before_latest from (select f.*, v.recovery_drop, max(f.activity_date) over (partition by f.subject) as latest from {FIT} f join {{vnat}} v on f.run_id = v.run_id) x where date_diff('day', activity_date, latest) < 21""")(
    lambda t: recovery_trend(fitness_signals(t.vnat).join(t.vnat.select("run_id", "recovery_drop"), "run_id")))


def comparable_efficiency(points: DataFrame, bands: list[str]) -> DataFrame:
    """Efficiency of runs in chosen bands, times ten, with the mean of four and the change against the four before."""
    along = Window.partitionBy("subject").orderBy("activity_date", "run_id")
    rows = points.where(C("hr_band").isin(bands) & C("efficiency").isNotNull()).withColumn("e", C("efficiency") * 10)
    prior = F.avg("e").over(along.rowsBetween(-4, -1))
    return rows.select("subject", "run_id", F.round("e", 2).alias("e"), F.round(F.avg("e").over(along.rowsBetween(-3, 0)), 3).alias("rolling4"), F.round(C("e") - prior, 3).alias("change"))


_CE = "over (partition by subject order by activity_date, run_id rows between"
R.query("MD34_comparable_efficiency", f"select subject, run_id, round(e, 2) as e, round(avg(e) {_CE} 3 preceding and current row), 3) as rolling4, round(e - avg(e) {_CE} 4 preceding and 1 preceding), 3) as change from (select *, efficiency * 10 as e from {FIT} f where hr_band in ('120-129', '130-139') and efficiency is not null) x")(
    lambda t: comparable_efficiency(fitness_signals(t.vnat), ["120-129", "130-139"]))


def latest_baseline(points: DataFrame, value: str, days: int = 90, least: int = 4) -> DataFrame:
    """Exact quartiles of a subject's values in the days before its latest one; null below `least` values."""
    last = points.where(C(value).isNotNull()).withColumn("_latest", F.max("activity_date").over(Window.partitionBy("subject")))
    old = (C("activity_date") < C("_latest")) & (F.datediff("_latest", "activity_date") <= days)
    known = quantiles(last.where(old), ["subject"], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("n", "_n")
    names = last.select("subject").distinct().join(known.withColumnRenamed("subject", "_s"), C("subject").eqNullSafe(C("_s")), "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return names.select("subject", n.alias("n"), *[F.round(F.when(n >= least, C(c)), 6).alias(c) for c in ("q1", "median", "q3")])


R.query("MD35_latest_baseline", "select subject, count(e) filter (where o) as n, " + ", ".join(f"round(case when count(e) filter (where o) >= 4 then quantile_cont(e, {q}) filter (where o) end, 6) as {c}" for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + f" from (select *, activity_date < latest and date_diff('day', activity_date, latest) <= 90 as o from (select subject, activity_date, efficiency as e, max(activity_date) over (partition by subject) as latest from {FIT} f where efficiency is not null) x) y group by subject")(
    lambda t: latest_baseline(fitness_signals(t.vnat), "efficiency"))


def drift_summary(points: DataFrame, steady: float = 97.5, moderate: float = 95.0, least: int = 2) -> DataFrame:
    """The last known efficiency of a run against 100, if it has `least` known ones, and its band."""
    known = points.where(~C("excluded") & C("efficiency").isNotNull())
    last = known.groupBy("run_id").agg(F.count("*").alias("n"), F.max_by("efficiency", "record_index").alias("e")).where(C("n") >= least)
    return last.select("run_id", "n", F.round(C("e") - 100, 1).alias("drift"), F.when(C("e") >= steady, "stable").when(C("e") >= moderate, "moderate").otherwise("high").alias("band"))


R.query("MD36_drift_summary", f"select run_id, n, round(e - 100, 1) as drift, case when e >= 97.5 then 'stable' when e >= 95 then 'moderate' else 'high' end as band from (select run_id, count(*) as n, max(case when rn = 1 then efficiency end) as e from (select *, row_number() over (partition by run_id order by record_index desc) as rn from {telemetry.TRACE} t where not excluded and efficiency is not null) x group by run_id) y where n >= 2")(
    lambda t: drift_summary(telemetry.trace_of(t)))
