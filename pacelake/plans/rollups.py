"""Calendar spine and daily, weekly, monthly and yearly rollups with rolling windows and streaks, for each subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import week_start
from ..operators.windows import date_spine, islands
from ..registry import Registry

R = Registry()
C = F.col
AS_OF = "2001-08-05"


def calendar_spine(dates: DataFrame, column: str, as_of: str) -> DataFrame:
    """Each day from the first date to `as_of` with its calendar attributes; weeks start on Monday."""
    d = C("calendar_date")
    return date_spine(dates, column, as_of).select(
        d, week_start(d).alias("week_start_date"), F.date_add(week_start(d), 6).alias("week_end_date"), F.trunc(d, "month").alias("month_start_date"), F.last_day(d).alias("month_end_date"),
        F.date_trunc("quarter", d).cast("date").alias("quarter_start_date"), F.trunc(d, "year").alias("year_start_date"), F.year(d).cast("long").alias("calendar_year"), F.quarter(d).cast("long").alias("calendar_quarter"),
        F.month(d).cast("long").alias("calendar_month"), F.weekofyear(d).cast("long").alias("iso_week"), F.dayofmonth(d).cast("long").alias("day_of_month"), F.dayofweek(d).cast("long").alias("day_of_week"),
        F.date_format(d, "E").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), (d == F.lit(as_of).cast("date")).alias("is_latest_date"),
    )


_SPINE = "(select cast(unnest(generate_series(a::timestamp, b::timestamp, interval 1 day)) as date) as calendar_date from (select min(activity_date) as a, date '" + AS_OF + "' as b from {vnat} n) e)"
R.query("MD01_calendar_spine", f"""select calendar_date, cast(date_trunc('week', calendar_date) as date) as week_start_date, cast(date_trunc('week', calendar_date) as date) + 6 as week_end_date, cast(date_trunc('month', calendar_date) as date) as month_start_date,
 last_day(calendar_date) as month_end_date, cast(date_trunc('quarter', calendar_date) as date) as quarter_start_date, cast(date_trunc('year', calendar_date) as date) as year_start_date, year(calendar_date) as calendar_year, quarter(calendar_date) as calendar_quarter,
 month(calendar_date) as calendar_month, week(calendar_date) as iso_week, day(calendar_date) as day_of_month, dayofweek(calendar_date) + 1 as day_of_week, strftime(calendar_date, '%a') as day_name, dayofweek(calendar_date) in (0, 6) as is_weekend,
 calendar_date = date '{AS_OF}' as is_latest_date from {_SPINE} s""")(lambda t: calendar_spine(t.vnat, "activity_date", AS_OF))


def daily_mart(sessions: DataFrame, as_of: str, health: DataFrame | None = None) -> DataFrame:
    """Each subject's days from its first session to `as_of`: counts filled with 0, resting heart rate left null, rolling sums of
    7 and 28 days, averages of the resting rate over 7 and 30 days. Windows and the spine are split by subject."""
    per_day = sessions.groupBy("subject", "activity_date").agg(F.count("*").alias("run_count"), F.sum("distance").alias("distance"), F.max("distance").alias("long_run"), F.sum("duration_seconds").alias("duration_seconds"))
    ends = per_day.groupBy("subject").agg(F.min("activity_date").alias("a")).where(C("a") <= F.lit(as_of).cast("date"))
    spine = ends.select("subject", F.explode(F.sequence("a", F.lit(as_of).cast("date"), F.expr("interval 1 day"))).alias("calendar_date"))
    days = spine.join(per_day.withColumnRenamed("activity_date", "calendar_date"), ["subject", "calendar_date"], "left")
    days = days.join(health.select("subject", "calendar_date", "resting_heart_rate"), ["subject", "calendar_date"], "left") if health is not None else days.withColumn("resting_heart_rate", F.lit(None).cast("double"))
    days = days.select("subject", "calendar_date", F.coalesce("run_count", F.lit(0)).alias("run_count"), F.coalesce("distance", F.lit(0)).alias("distance"), F.coalesce("long_run", F.lit(0)).alias("long_run"),
                       F.coalesce("duration_seconds", F.lit(0)).alias("duration_seconds"), C("run_count").isNotNull().alias("active_day"), C("run_count").isNull().alias("missed_day"), "resting_heart_rate")
    along = Window.partitionBy("subject").orderBy("calendar_date")
    number = Window.partitionBy("subject").orderBy(F.unix_date("calendar_date").cast("long"))
    double = {"distance": C("distance").cast("double"), "long_run": C("long_run").cast("double")}
    return days.select(
        "subject", "calendar_date", "run_count", double["distance"].alias("distance"), double["long_run"].alias("long_run"), "duration_seconds", "active_day", "missed_day", "resting_heart_rate",
        *[F.sum("run_count").over(along.rowsBetween(1 - n, 0)).alias(f"run_count_{n}d") for n in (7, 28)],
        *[F.sum("distance").over(along.rowsBetween(1 - n, 0)).cast("double").alias(f"distance_{n}d") for n in (7, 28)],
        *[F.round(F.avg("resting_heart_rate").over(number.rangeBetween(1 - n, 0)), 6).alias(f"resting_{n}d") for n in (7, 30)],
    )


_W = "over (partition by subject order by calendar_date"
DAYS = f"""(select subject, calendar_date, run_count, cast(distance as double) as distance, cast(long_run as double) as long_run, duration_seconds, active_day, missed_day, resting_heart_rate,
 {", ".join(f"cast(sum(run_count) {_W} rows between {n - 1} preceding and current row) as bigint) as run_count_{n}d, cast(sum(distance) {_W} rows between {n - 1} preceding and current row) as double) as distance_{n}d" for n in (7, 28))},
 {", ".join(f"round(avg(resting_heart_rate) {_W} range between interval {n - 1} days preceding and current row), 6) as resting_{n}d" for n in (7, 30))}
 from (select s.subject, s.calendar_date, coalesce(run_count, 0) as run_count, coalesce(distance, 0) as distance, coalesce(long_run, 0) as long_run, coalesce(duration_seconds, 0) as duration_seconds, run_count is not null as active_day, run_count is null as missed_day, resting_heart_rate
  from (select subject, cast(unnest(generate_series(a::timestamp, timestamp '{AS_OF}', interval 1 day)) as date) as calendar_date from (select subject, min(activity_date) as a from {{vnat}} n group by subject) e) s
  left join (select subject, activity_date, count(*) as run_count, sum(distance) as distance, max(distance) as long_run, cast(sum(duration_seconds) as bigint) as duration_seconds from {{vnat}} n group by subject, activity_date) p on s.subject = p.subject and s.calendar_date = p.activity_date
  left join {{vrest}} h on s.subject = h.subject and s.calendar_date = h.calendar_date) d)"""


def days_of(t) -> DataFrame:
    return daily_mart(t.vnat, AS_OF, t.vrest)


R.query("MD05_daily_mart", f"select * from {DAYS} d")(days_of)


def weekly_mart(days: DataFrame, as_of: str) -> DataFrame:
    """Weeks with all seven days, the subject's first week, and the current one. Only whole weeks are active or missed; rolling
    sums run over the weeks kept; a missed week resets the streak; an incomplete week shows the streak of the week before."""
    weeks = days.withColumn("week_start_date", week_start(C("calendar_date"))).groupBy("subject", "week_start_date").agg(
        F.sum("run_count").alias("run_count"), F.sum(C("distance").cast("decimal(18,2)")).alias("distance"), F.sum("duration_seconds").alias("duration_seconds"), F.max("long_run").alias("long_run"),
        F.count_if("active_day").alias("active_days"), F.count_if("missed_day").alias("missed_days"), F.count("*").alias("n_days"),
    )
    whole = C("n_days") == 7
    weeks = weeks.withColumns({"completed": whole, "active_week": (C("run_count") > 0) & whole, "missed_week": (C("run_count") == 0) & whole, "_first": F.min("week_start_date").over(Window.partitionBy("subject"))})
    weeks = weeks.where(whole | (C("week_start_date") == C("_first")) | (C("week_start_date") == week_start(F.lit(as_of).cast("date")))).drop("_first")
    along = Window.partitionBy("subject").orderBy("week_start_date")
    number = lambda c: F.when(C(c), 1).otherwise(0)
    weeks = weeks.withColumn("_group", F.sum(number("missed_week")).over(along))
    streak = F.when(C("active_week"), F.sum(number("active_week")).over(Window.partitionBy("subject", "_group").orderBy("week_start_date"))).otherwise(0)
    weeks = weeks.withColumn("_streak", streak)
    km, runs = C("distance").cast("double"), C("run_count")
    return weeks.select(
        "subject", "week_start_date", F.date_add("week_start_date", 6).alias("week_end_date"), "completed", "run_count", km.alias("distance"), "duration_seconds",
        F.round(F.when(km > 0, C("duration_seconds") / 60.0 / km), 9).alias("pace"), "long_run", F.round(F.when(runs > 0, km / runs), 6).alias("avg_run"), F.round(F.when(km > 0, C("long_run") / km), 9).alias("long_run_share"),
        "active_days", "missed_days", "active_week", "missed_week", "n_days", F.sum("run_count").over(along.rowsBetween(-3, 0)).alias("run_count_4w"),
        F.when(C("completed"), C("_streak")).otherwise(F.lag("_streak").over(along)).cast("long").alias("active_week_streak"), F.sum(number("missed_week")).over(along.rowsBetween(-11, 0)).cast("long").alias("missed_weeks_12w"),
        F.sum("distance").over(along.rowsBetween(-3, 0)).cast("double").alias("distance_4w"), F.sum("distance").over(along.rowsBetween(-11, 0)).cast("double").alias("distance_12w"),
    )


_WW = "over (partition by subject order by week_start_date"
WEEKS = f"""(select subject, week_start_date, week_start_date + 6 as week_end_date, completed, run_count, cast(distance as double) as distance, duration_seconds, round(case when distance > 0 then duration_seconds / 60.0 / cast(distance as double) end, 9) as pace, long_run,
 round(case when run_count > 0 then cast(distance as double) / run_count end, 6) as avg_run, round(case when distance > 0 then long_run / cast(distance as double) end, 9) as long_run_share, active_days, missed_days, active_week, missed_week, n_days,
 cast(sum(run_count) {_WW} rows between 3 preceding and current row) as bigint) as run_count_4w, cast(case when completed then streak else lag(streak) {_WW}) end as bigint) as active_week_streak,
 cast(sum(case when missed_week then 1 else 0 end) {_WW} rows between 11 preceding and current row) as bigint) as missed_weeks_12w, cast(sum(distance) {_WW} rows between 3 preceding and current row) as double) as distance_4w,
 cast(sum(distance) {_WW} rows between 11 preceding and current row) as double) as distance_12w
 from (select *, case when active_week then sum(case when active_week then 1 else 0 end) over (partition by subject, grp order by week_start_date) else 0 end as streak
  from (select *, sum(case when missed_week then 1 else 0 end) {_WW}) as grp
   from (select *, n_days = 7 as completed, run_count > 0 and n_days = 7 as active_week, run_count = 0 and n_days = 7 as missed_week, min(week_start_date) over (partition by subject) as f
    from (select subject, cast(date_trunc('week', calendar_date) as date) as week_start_date, cast(sum(run_count) as bigint) as run_count, sum(cast(distance as decimal(18,2))) as distance, cast(sum(duration_seconds) as bigint) as duration_seconds, max(long_run) as long_run,
     count(*) filter (where active_day) as active_days, count(*) filter (where missed_day) as missed_days, count(*) as n_days from {DAYS} d group by 1, 2) a) b
   where completed or week_start_date = f or week_start_date = cast(date_trunc('week', date '{AS_OF}') as date)) c) e)"""


def weeks_of(t) -> DataFrame:
    return weekly_mart(days_of(t), AS_OF)


R.query("MD06_weekly_mart", f"select * from {WEEKS} w")(weeks_of)


def period_mart(days: DataFrame, unit: str) -> DataFrame:
    """Totals of each subject by month or year."""
    return days.groupBy("subject", F.trunc("calendar_date", unit).alias("period_start")).agg(
        F.sum("run_count").alias("run_count"), F.sum(C("distance").cast("decimal(18,2)")).cast("double").alias("distance"), F.sum("duration_seconds").alias("duration_seconds"), F.max("long_run").alias("long_run"),
        F.count_if("active_day").alias("active_days"), F.count_if("missed_day").alias("missed_days"), F.count("*").alias("n_days"),
    )


for _unit, _name in (("month", "MD07_monthly_mart"), ("year", "MD07_yearly_mart")):
    R.query(_name, f"select subject, cast(date_trunc('{_unit}', calendar_date) as date) as period_start, cast(sum(run_count) as bigint) as run_count, cast(sum(cast(distance as decimal(18,2))) as double) as distance, cast(sum(duration_seconds) as bigint) as duration_seconds, max(long_run) as long_run, count(*) filter (where active_day) as active_days, count(*) filter (where missed_day) as missed_days, count(*) as n_days from {DAYS} d group by 1, 2")(
        lambda t, u=_unit: period_mart(days_of(t), u))


def daily_streaks(days: DataFrame) -> DataFrame:
    """Longest and average active streak and break of each subject."""
    runs = islands(days, "subject", "calendar_date", "active_day")
    of = lambda f, active: f(F.when(C("active_day") == active, C("n")))
    return runs.groupBy("subject").agg(of(F.max, True).alias("longest_streak"), F.round(of(F.avg, True), 6).alias("average_streak"), of(F.max, False).alias("longest_break"), F.round(of(F.avg, False), 6).alias("average_break"))


_ISLE = f"(select subject, active_day, island, count(*) as n from (select *, sum(chg) over (partition by subject order by calendar_date) as island from (select *, case when active_day = lag(active_day) over (partition by subject order by calendar_date) then 0 else 1 end as chg from {DAYS} d) a) b group by 1, 2, 3)"
R.query("MD08_daily_streaks", f"select subject, max(n) filter (where active_day) as longest_streak, round(avg(n) filter (where active_day), 6) as average_streak, max(n) filter (where not active_day) as longest_break, round(avg(n) filter (where not active_day), 6) as average_break from {_ISLE} i group by subject")(
    lambda t: daily_streaks(days_of(t)))


def current_week(days: DataFrame, as_of: str) -> DataFrame:
    """The week of `as_of` so far."""
    start = week_start(F.lit(as_of).cast("date"))
    now = days.where((C("calendar_date") >= start) & (C("calendar_date") <= F.lit(as_of).cast("date")))
    return now.groupBy("subject").agg(F.min(start).alias("week_start_date"), F.sum("run_count").alias("run_count"), F.sum(C("distance").cast("decimal(18,2)")).cast("double").alias("distance"), F.count_if("active_day").alias("active_days"), F.count("*").alias("days_so_far"))


R.query("MD09_current_week", "select subject, date '2001-07-16' as week_start_date, cast(sum(run_count) as bigint) as run_count, cast(sum(cast(distance as decimal(18,2))) as double) as distance, count(*) filter (where active_day) as active_days, count(*) as days_so_far from " + DAYS + " d where calendar_date between date '2001-07-16' and date '2001-07-19' group by subject")(
    lambda t: current_week(days_of(t), "2001-07-19"))


def weekly_features(weeks: DataFrame) -> DataFrame:
    """Lags 1 to 4 and leads 1 to 4 of weekly distance and runs; leads are labels, not inputs."""
    along = Window.partitionBy("subject").orderBy("week_start_date")
    row = F.struct("distance", "run_count")
    shifts = {f"{n}_{k}": f(row, k).over(along) for k in range(1, 5) for n, f in (("lag", F.lag), ("lead", F.lead))}
    return weeks.withColumns({f"_{n}": s for n, s in shifts.items()}).select("subject", "week_start_date", *[C(f"_{n}.{c}").alias(f"{c}_{n}") for n in shifts for c in ("distance", "run_count")])


R.query("MD10_weekly_features", "select subject, week_start_date, " + ", ".join(f"{f}({c}, {k}) {_WW}) as {c}_{f}_{k}" for k in range(1, 5) for f in ("lag", "lead") for c in ("distance", "run_count")) + f" from {WEEKS} w")(lambda t: weekly_features(weeks_of(t)))


def volume_breakdown(weeks: DataFrame) -> DataFrame:
    """The longest run of a week, never above the total, and the rest, never below 0."""
    long = F.least("long_run", "distance")
    return weeks.select("subject", "week_start_date", long.alias("longest"), F.round(F.greatest(C("distance") - long, F.lit(0.0)), 6).alias("rest"))


R.query("MD37_volume_breakdown", f"select subject, week_start_date, least(long_run, distance) as longest, round(greatest(distance - least(long_run, distance), 0), 6) as rest from {WEEKS} w")(lambda t: volume_breakdown(weeks_of(t)))


def streak_status(weeks: DataFrame) -> DataFrame:
    """The latest streak of each subject against its longest before, and the week the streak began."""
    last = weeks.groupBy("subject").agg(F.max_by(F.struct("week_start_date", "active_week_streak"), "week_start_date").alias("l"), F.max("active_week_streak").alias("longest"))
    now = C("l.active_week_streak")
    return last.select("subject", now.alias("current"), "longest", F.when((now > 0) & (now == C("longest")), "record").when(now > 0, "running").otherwise("none").alias("status"), F.when(now > 0, F.date_sub("l.week_start_date", ((now - 1) * 7).cast("int"))).alias("started"))


R.query("MD38_streak_status", f"""select subject, current, longest, case when current > 0 and current = longest then 'record' when current > 0 then 'running' else 'none' end as status, case when current > 0 then cast(w - cast((current - 1) * 7 as int) as date) end as started from
 (select subject, max(case when rn = 1 then active_week_streak end) as current, max(active_week_streak) as longest, max(week_start_date) as w from (select *, row_number() over (partition by subject order by week_start_date desc) as rn from {WEEKS} x) y group by subject) z""")(lambda t: streak_status(weeks_of(t)))


def consistency_context(days: DataFrame) -> DataFrame:
    """Streak figures of the whole window and of its first and second half by rows."""
    w = Window.partitionBy("subject")
    half = F.when(F.row_number().over(w.orderBy("calendar_date")) * 2 <= F.count("*").over(w), "first").otherwise("second")
    parts = days.withColumn("half", half)
    each = [daily_streaks(parts.where(C("half") == h)).withColumn("part", F.lit(h)) for h in ("first", "second")]
    return daily_streaks(days).withColumn("part", F.lit("all")).unionByName(each[0]).unionByName(each[1])


_HALF = f"(select *, case when 2 * row_number() over (partition by subject order by calendar_date) <= count(*) over (partition by subject) then 'first' else 'second' end as half from {DAYS} d)"


def _streaks(part: str, source: str) -> str:
    return f"select '{part}' as part, subject, max(n) filter (where active_day) as longest_streak, round(avg(n) filter (where active_day), 6) as average_streak, max(n) filter (where not active_day) as longest_break, round(avg(n) filter (where not active_day), 6) as average_break from (select subject, active_day, island, count(*) as n from (select *, sum(chg) over (partition by subject order by calendar_date) as island from (select *, case when active_day = lag(active_day) over (partition by subject order by calendar_date) then 0 else 1 end as chg from {source}) a) b group by 1, 2, 3) i group by subject"


R.query("MD39_consistency", " union all ".join([_streaks("all", DAYS + " d0"), *[_streaks(h, f"(select * from {_HALF} h0 where half = '{h}') h1") for h in ("first", "second")]]))(lambda t: consistency_context(days_of(t)))
