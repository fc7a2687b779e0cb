"""The fitness mart of runs with records: signals, decoupling with its baseline, economies, drift, and what came before each run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.distributed import sliding_quantiles
from ..registry import Registry
from . import signals, telemetry

R = Registry()
C = F.col
#: Figures of a run's halves that the mart passes on.
HALVES = ("seconds", "n_segments", "coverage", "max_gap", "speed1", "speed2", "hr1", "hr2", "eff1", "eff2")
#: Days of a baseline and values that it needs.
DAYS, LEAST = 90, 4


def with_recovery(runs: DataFrame, records: DataFrame) -> DataFrame:
    """`runs` with distance (km, exact), the last known heart rate, and how far that is below the highest."""
    known = F.when(C("heart_rate").isNotNull(), C("record_index"))
    ends = records.groupBy("run_id").agg(F.max_by("heart_rate", known).alias("ending_heart_rate"), F.max("heart_rate").alias("_top"))
    rows = runs.withColumn("distance", C("distance_km").cast("decimal(20,5)")).join(ends, "run_id", "left")
    return rows.withColumn("recovery_drop", C("_top") - C("ending_heart_rate")).drop("_top")


def fitness_mart(runs: DataFrame, decoupling: DataFrame, economy: DataFrame, traces: DataFrame) -> DataFrame:
    """One row a run. Besides `signals.fitness_signals`: decoupling in percent with status, reason and figures of the halves; count, median
    and quartiles of a subject's decoupling over the 90 days before (observed values; null below four); climb a beat; the
    last known decoupling, economies and load before the run; and the samples and seconds of the drift trace.

    `runs`: as for `fitness_signals`; the others hold at most one row a run, and runs that they lack stay.
    """
    base = runs.join(economy.select("run_id", "m_per_beat", "climb_per_beat"), "run_id", "left")
    halves = decoupling.select("run_id", (100 * C("decoupling")).alias("decoupling_pct"), C("status").alias("decoupling_status"), C("reason").alias("decoupling_reason"), "failed_gates", *[C(c).alias(f"half_{c}") for c in HALVES])
    drift = traces.select("run_id", C("valid_samples").alias("drift_samples"), C("seconds").alias("drift_seconds"))
    more = base.select("subject", "run_id", "activity_date", "climb_per_beat").join(halves, "run_id", "left").join(drift, "run_id", "left").withColumn("_day", F.unix_date("activity_date").cast("long"))
    prior = sliding_quantiles(more, ["subject"], "_day", "decoupling_pct", {"decoupling_q1": 0.25, "decoupling_median": 0.5, "decoupling_q3": 0.75}, DAYS)
    prior = prior.select(C("subject").alias("_s"), C("_day").alias("_d"), C("n").alias("decoupling_count"), *[F.when(C("n") >= LEAST, C(c)).alias(c) for c in ("decoupling_q1", "decoupling_median", "decoupling_q3")])
    before = Window.partitionBy("subject").orderBy("activity_date", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    more = more.join(prior, C("subject").eqNullSafe(C("_s")) & (C("_day") == C("_d")), "left").withColumns({f"previous_{n}": F.last(c, True).over(before) for n, c in (("decoupling", "decoupling_pct"), ("climb_per_beat", "climb_per_beat"))})
    return signals.fitness_signals(base).join(more.drop("subject", "activity_date", "_day", "_s", "_d"), "run_id")


def mart_of(t) -> DataFrame:
    return fitness_mart(with_recovery(t.vrun, t.vrec), signals.decoupling_of(t), telemetry.heart_economy(t.vrec), telemetry.trace_documents(telemetry.trace_of(t), t.vrun, 60, 300, 6))


_RUNS = f"""(select v.*, cast(distance_km as decimal(20,5)) as distance, h.ending_heart_rate, h.top - h.ending_heart_rate as recovery_drop, e.m_per_beat, e.climb_per_beat from {{vrun}} v
 left join (select run_id, arg_max(heart_rate, record_index) filter (where heart_rate is not null) as ending_heart_rate, max(heart_rate) as top from {{vrec}} r group by run_id) h on h.run_id = v.run_id
 left join {telemetry.ECO} e on e.run_id = v.run_id)"""
_WIDE = ", ".join(f"half_{c}" for c in HALVES)
_BEFORE = "over (partition by subject order by activity_date, run_id rows between unbounded preceding and 1 preceding)"
MART = f"""(select f.*, climb_per_beat, decoupling_pct, decoupling_status, decoupling_reason, failed_gates, {_WIDE}, drift_samples, drift_seconds, decoupling_count,
 {", ".join(f"case when decoupling_count >= {LEAST} then {c} end as decoupling_{c}" for c in ("q1", "median", "q3"))}, previous_decoupling, previous_climb_per_beat from {signals._fit_sql(_RUNS, "v.m_per_beat")} f join
 (select *, count(decoupling_pct) {signals._PRIOR} as decoupling_count, {", ".join(f"quantile_disc(decoupling_pct, {q}) {signals._PRIOR} as {c}" for c, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))},
  last_value(decoupling_pct ignore nulls) {_BEFORE} as previous_decoupling, last_value(climb_per_beat ignore nulls) {_BEFORE} as previous_climb_per_beat from
 (select v.run_id, v.subject, v.activity_date, v.climb_per_beat, 100 * d.decoupling as decoupling_pct, d.status as decoupling_status, d.reason as decoupling_reason, d.failed_gates, {", ".join(f"d.{c} as half_{c}" for c in HALVES)},
  coalesce(x.valid, 0) as drift_samples, coalesce(x.seconds, 0) as drift_seconds from {_RUNS} v left join {signals.DEC} d on d.run_id = v.run_id
  left join (select run_id, count(*) filter (where not excluded) as valid, max(elapsed_seconds) as seconds from {telemetry.TRACE} t group by run_id) x on x.run_id = v.run_id) a) b on f.run_id = b.run_id)"""
_EXACT = ("subject", "run_id", "activity_date", "hr_band", "recovery_count", "recovery_q1", "recovery_median", "recovery_q3", "recovery_min", "recovery_max", "decoupling_status", "decoupling_reason", "failed_gates", "half_n_segments", "drift_samples", "drift_seconds", "decoupling_count",
          "efficiency", "efficiency_4", "recovery_4", "economy", "previous_economy", "score")
_ROUND = ("prior_7d", "previous_prior_7d", "climb_per_beat", "previous_climb_per_beat", "decoupling_pct", "previous_decoupling", "decoupling_q1", "decoupling_median", "decoupling_q3", *(f"half_{c}" for c in HALVES if c != "n_segments"))
R.query("MD20_fitness_mart", f"select {', '.join(_EXACT)}, {', '.join(f'round({c}, 5) as {c}' for c in _ROUND)} from {MART} m")(lambda t: mart_of(t).select(*_EXACT, *[F.round(c, 5).alias(c) for c in _ROUND]))
R.query("DT04_decoupling_baseline_validity", f"select count(*) as violation_count from {MART} m where decoupling_count < 4 and (decoupling_median is not null or decoupling_q1 is not null or decoupling_q3 is not null)")(
    lambda t: mart_of(t).where("decoupling_count < 4 and (decoupling_median is not null or decoupling_q1 is not null or decoupling_q3 is not null)").agg(F.count("*").alias("violation_count")))
