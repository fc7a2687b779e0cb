"""Course queries: the tasks of a SQL course over sessions, days and records, as SQL on the views.

The same text runs on both engines where their dialects agree; `@DOW(x)` is the day of the week from 0 (Sunday)
and `@TXT(x)` a date as YYYY-MM-DD, `@DIFF(a, b)` or `@DAYS{a|b}` days from b to a, `@FIX2(x)` two decimals: they spell these differently.
The queries of `_FRAMES` are DataFrame code instead, in a form that needs no window over a whole table or over a year of it;
their text is only what they are compared with.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import global_order
from ..registry import Registry

R = Registry()
C = F.col
_SPARK = {"DOW": r"(dayofweek(\1) - 1)", "TXT": r"date_format(\1, 'yyyy-MM-dd')", "DIFF": r"datediff(\1)", "FIX2": r"cast(cast(round(\1, 2) as decimal(18,2)) as string)"}
_DUCK = {"DOW": r"dayofweek(\1)", "TXT": r"strftime(\1, '%Y-%m-%d')", "DIFF": r"SWAP(\1)", "FIX2": r"cast(cast(round(\1, 2) as decimal(18,2)) as varchar)"}


def _for(text: str, words: dict[str, str]) -> str:
    for name, to in words.items():
        text = re.sub(rf"@{name}\(([^()]*)\)", to, text)
    later = r"datediff(\1, \2)" if words is _SPARK else r"date_diff('day', \2, \1)"
    text = re.sub(r"@DAYS\{([^|]+)\|([^}]+)\}", later, text)
    return re.sub(r"SWAP\(([^,()]+), ([^,()]+)\)", r"date_diff('day', \2, \1)", text)


def _quartiles(t) -> DataFrame:
    """Quartiles by place in the order of all orders; the first n % 4 of them hold one row more."""
    orders = t.orders.select("o_totalprice", "o_orderkey")
    size, longer = divmod(orders.count(), 4)
    placed = global_order(orders, ["o_totalprice", "o_orderkey"], "place")
    edge = longer * (size + 1)
    q = F.when(C("place") <= edge, F.ceil(C("place") / (size + 1))).otherwise(longer + F.ceil((C("place") - edge) / max(size, 1)))
    return placed.groupBy(q.cast("long").alias("q")).agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))


def _top_decile(t) -> DataFrame:
    """Percent rank from the last place of each price: rows above it are those behind that place."""
    orders = t.orders.select("o_orderkey", "o_totalprice")
    n = orders.count()
    last = global_order(orders, ["o_totalprice", "o_orderkey"], "place").groupBy(C("o_totalprice").alias("p")).agg(F.max("place").alias("upto"))
    ranks = last.withColumn("pr", (n - C("upto")) / F.lit(float(max(n - 1, 1)))).where("pr <= 0.1")
    return orders.join(ranks, C("o_totalprice").eqNullSafe(C("p"))).select("o_orderkey", F.round("pr", 6).alias("pr"))


def _rank_in_year(t) -> DataFrame:
    """Rank from the last places of a year and of each price in it."""
    keys = ["yr", "o_totalprice"]
    orders = t.orders.select("o_orderkey", F.year("o_orderdate").cast("long").alias("yr"), "o_totalprice")
    last = global_order(orders, [*keys, "o_orderkey"], "place").groupBy(C("yr").alias("y"), C("o_totalprice").alias("p")).agg(F.max("place").alias("upto"))
    ends = last.groupBy(C("y").alias("z")).agg(F.max("upto").alias("end"))  # one row a year
    ranks = last.join(F.broadcast(ends), C("y").eqNullSafe(C("z"))).withColumn("place", C("end") - C("upto") + 1)
    return orders.join(ranks, C("yr").eqNullSafe(C("y")) & C("o_totalprice").eqNullSafe(C("p"))).select("o_orderkey", "yr", "place")


def _year_to_date(t) -> DataFrame:
    """Running sums over the days of a year, then each order's day."""
    orders = t.orders.select("o_orderkey", "o_orderdate", C("o_totalprice").cast("decimal(18,2)").alias("price"))
    days = orders.groupBy(C("o_orderdate").alias("day")).agg(F.sum("price").alias("total"))
    upto = F.sum("total").over(Window.partitionBy(F.year("day")).orderBy("day"))
    return orders.join(days.select("day", upto.cast("double").alias("ytd")), C("o_orderdate").eqNullSafe(C("day"))).select("o_orderkey", "ytd")


def _in_years(t) -> tuple[DataFrame, Column, Column]:
    """Orders of two years, and whether a customer has orders in each."""
    rows = t.orders.select("o_custkey", F.year("o_orderdate").alias("yr")).where("yr in (1995, 1996)")
    return rows, F.bool_or(C("yr") == 1995), F.bool_or(C("yr") == 1996)


def _only_first_year(t) -> DataFrame:
    rows, first, second = _in_years(t)
    return rows.groupBy("o_custkey").agg(first.alias("a"), second.alias("b")).where("a and not b").select("o_custkey")


def _in_both_sizes(t) -> DataFrame:
    each = t.part.groupBy("p_type").agg(F.bool_or(C("p_size") <= 10).alias("small"), F.bool_or(C("p_size") >= 40).alias("large"))
    return each.where("small and large").select("p_type")


def _by_size(t) -> DataFrame:
    bucket = F.when(C("p_size") < 10, "small").when(C("p_size") > 40, "large").alias("bucket")
    return t.part.select(bucket, "p_retailprice").where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"))


def _records(t) -> DataFrame:
    """Largest and smallest order of each year from one aggregation, of equal prices the one with the smaller key."""
    top, low = F.struct("o_totalprice", (-C("o_orderkey")).alias("k")), F.struct("o_totalprice", "o_orderkey")
    years = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.max(top).alias("top"), F.min(low).alias("low"))
    row = lambda name, key, price: F.struct(F.lit(name).alias("record"), key.alias("o_orderkey"), C(price).alias("o_totalprice"))
    return years.select("yr", F.inline(F.array(row("largest", -C("top.k"), "top.o_totalprice"), row("smallest", C("low.o_orderkey"), "low.o_totalprice"))))


_FRAMES = {
    "Q04_03_exists": lambda t: t.vday.groupBy("activity_date").agg(F.max("distance").alias("most")).where("most > 300000").select("activity_date"),
    "Q05_02_rank_in_year": _rank_in_year,
    "Q05_06_year_to_date": _year_to_date,
    "Q05_07_quartiles": _quartiles,
    "Q05_08_top_decile": _top_decile,
    "Q08_01_union": lambda t: _in_years(t)[0].select("o_custkey").distinct(),
    "Q08_02_union_counts": lambda t: _in_years(t)[0].agg(F.count_distinct(F.struct("o_custkey")).alias("n_union"), F.count("*").alias("n_all")),
    "Q08_03_intersect": _in_both_sizes,
    "Q08_04_except": _only_first_year,
    "Q08_05_over_union": _by_size,
    "Q10_03_records": _records,
}


def _course(name: str, text: str) -> None:
    if name in _FRAMES:
        R.query(name, _for(text, _DUCK))(_FRAMES[name])
    else:
        R.sql(name, _for(text, _SPARK), _for(text, _DUCK))


_O = "o_orderkey, o_custkey, cast(o_orderdate as date) as o_date, o_totalprice"
_YEAR = "year(o_orderdate)"
_WEEKS = """(select cast(date_trunc('week', activity_date) as date) as week_start, cast(sum(distance) as double) as total, count(*) as n,
  count(distinct activity_date) as active_days from {vday} v group by cast(date_trunc('week', activity_date) as date))"""
_MONTHS = "(select cast(date_trunc('month', o_orderdate) as date) as month_start, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, count(*) as n from {orders} o group by cast(date_trunc('month', o_orderdate) as date))"
_PACE = "cast(duration_seconds as double) / 60.0 / nullif(distance_km, 0)"

for _name, _text in {
    "Q01_01_recent_rows": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from {orders} o order by o_orderdate desc, o_orderkey desc limit 10",
    "Q01_02_recent_columns": f"select o_orderkey, cast(o_orderdate as date) as o_date, o_totalprice from {{orders}} o order by o_orderdate desc, o_orderkey desc limit 20",
    "Q01_03_distinct_buckets": "select distinct p_type from {part} p order by p_type",
    "Q01_04_top_days": "select activity_date, total from (select activity_date, sum(distance) as total from {vday} v group by activity_date) x where total > 0 order by total desc, activity_date limit 5",
    "Q01_05_year_and_or": f"select o_orderkey, o_totalprice, o_orderstatus from {{orders}} o where {_YEAR} = 1996 and (o_totalprice > 300000 or o_orderpriority = '1-URGENT')",
    "Q01_06_in_buckets": "select p_partkey, p_name, p_type from {part} p where p_type in (select p_type from (select distinct p_type from {part} p2 order by p_type limit 2) t) order by p_partkey limit 20",
    "Q01_07_between_fastest": f"select run_id, distance_km, {_PACE} as pace from {{vrun}} r where avg_heart_rate between 140 and 160 and distance_km > 0.5 and duration_seconds > 0 order by {_PACE}, run_id",
    "Q02_01_count": "select count(*) as n from {orders} o",
    "Q02_02_sum_avg": "select cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, round(avg(o_totalprice), 4) as mean from {orders} o",
    "Q02_03_per_year": f"select cast({_YEAR} as bigint) as yr, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, round(avg(o_totalprice), 4) as mean from {{orders}} o group by {_YEAR}",
    "Q02_04_having": "select p_type, count(*) as n from {part} p group by p_type having count(*) >= 3",
    "Q02_05_min_max": f"select cast({_YEAR} as bigint) as yr, min(o_totalprice) as low, max(o_totalprice) as high from {{orders}} o group by {_YEAR}",
    "Q02_06_weekend": "select case when @DOW(o_orderdate) in (0, 6) then 'weekend' else 'weekday' end as part_of_week, count(*) as n from {orders} o group by case when @DOW(o_orderdate) in (0, 6) then 'weekend' else 'weekday' end",
    "Q02_07_top_weeks": f"select week_start, total, active_days from {_WEEKS} w where active_days > 0 order by total desc, week_start limit 5",
    "Q03_01_inner": "select o_orderkey, c_name, o_totalprice from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o_totalprice > 200000",
    "Q03_02_left": "select c_custkey, c_name, count(o_orderkey) as n from {customer} c left join {orders} o on o.o_custkey = c.c_custkey group by c_custkey, c_name",
    "Q03_03_day_totals": "select v.run_id, v.activity_date, v.distance, d.total, d.n from {vday} v join (select activity_date, sum(distance) as total, count(*) as n from {vday} v2 group by activity_date) d on v.activity_date = d.activity_date",
    "Q03_04_rest_days": "select s.activity_date, count(v.run_id) as n, coalesce(cast(sum(v.distance) as double), 0) as total from (select distinct cast(l_shipdate as date) as activity_date from {lineitem} l) s left join {vday} v on v.activity_date = s.activity_date group by s.activity_date",
    "Q03_05_resolution": "select o_orderkey, l_linenumber, l_quantity, l_extendedprice from {orders} o join {lineitem} l on o.o_orderkey = l.l_orderkey where l_linenumber = 1 and l_quantity >= 30",
    "Q03_06_self_pairs": "select a.o_orderkey as first_key, b.o_orderkey as later_key, a.o_custkey from {orders} a join {orders} b on a.o_custkey = b.o_custkey and a.o_orderdate < b.o_orderdate and b.o_totalprice > a.o_totalprice + 200000",
    "Q03_07_three_way": "select o_orderkey, c_name, n_name from {orders} o join {customer} c on o.o_custkey = c.c_custkey left join {nation} n on c.c_nationkey = n.n_nationkey where o_totalprice > 250000",
    "Q03_08_vs_group_mean": "select o_orderkey, o.o_custkey, o_totalprice, round(o_totalprice - m.mean, 4) as diff from {orders} o join (select o_custkey, avg(o_totalprice) as mean from {orders} o2 group by o_custkey) m on o.o_custkey = m.o_custkey where abs(o_totalprice - m.mean) > 150000",
    "Q04_01_above_mean": "select o_orderkey, o_totalprice from {orders} o where o_totalprice > (select avg(o_totalprice) from {orders} o2)",
    "Q04_02_count_above": "select o_custkey, count(*) as n from {orders} o group by o_custkey having count(*) > (select avg(n) from (select count(*) as n from {orders} o2 group by o_custkey) x)",
    "Q04_03_exists": "select distinct activity_date from {vday} d where exists (select 1 from {vday} r where r.activity_date = d.activity_date and r.distance > 300000)",
    "Q04_04_correlated": "select p_partkey, p_type, p_retailprice from {part} p where p_retailprice > (select avg(q.p_retailprice) from {part} q where q.p_type = p.p_type)",
    "Q04_05_cte_months": f"with m as (select * from {_MONTHS} x) select month_start, total from m where total > 5000000",
    "Q04_06_best_year": f"with y as (select cast({_YEAR} as bigint) as yr, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from {{orders}} o group by {_YEAR}), b as (select * from y order by total desc, yr limit 1) select yr, total from b",
    "Q04_07_cte_rank": "with t as (select c_nationkey, o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from {orders} o join {customer} c on o.o_custkey = c.c_custkey group by c_nationkey, o_custkey) select c_nationkey, o_custkey, total, cast(row_number() over (partition by c_nationkey order by total desc, o_custkey) as bigint) as place from t",
    "Q05_01_row_number": "select * from (select o_orderkey, cast(row_number() over (order by o_orderdate desc, o_orderkey desc) as bigint) as rn from {orders} o) x where rn <= 20",
    "Q05_02_rank_in_year": f"select o_orderkey, cast({_YEAR} as bigint) as yr, cast(rank() over (partition by {_YEAR} order by o_totalprice desc) as bigint) as place from {{orders}} o",
    "Q05_03_lag": "select o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from {orders} o",
    "Q05_04_lead_days": "select o_orderkey, o_custkey, cast(@DAYS{lead(cast(o_orderdate as date)) over w|cast(o_orderdate as date)} as bigint) as days_until from {orders} o window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "Q05_05_moving_mean": "select o_orderkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 6 preceding and current row), 4) as mean7 from {orders} o",
    "Q05_06_year_to_date": f"select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by {_YEAR} order by o_orderdate) as double) as ytd from {{orders}} o",
    "Q05_07_quartiles": "select q, count(*) as n, round(min(o_totalprice), 2) as low, round(max(o_totalprice), 2) as high from (select o_totalprice, cast(ntile(4) over (order by o_totalprice, o_orderkey) as bigint) as q from {orders} o) x group by q",
    "Q05_08_top_decile": "select o_orderkey, round(pr, 6) as pr from (select o_orderkey, percent_rank() over (order by o_totalprice desc) as pr from {orders} o) x where pr <= 0.1",
    "Q06_01_year_month": f"select cast({_YEAR} as bigint) as yr, cast(month(o_orderdate) as bigint) as mon, count(*) as n from {{orders}} o group by {_YEAR}, month(o_orderdate)",
    "Q06_02_day_of_week": "select cast(@DOW(o_orderdate) as bigint) as dow, count(*) as n from {orders} o group by @DOW(o_orderdate)",
    "Q06_03_days_since": "select o_orderkey, cast(@DAYS{cast(o_orderdate as date)|lag(cast(o_orderdate as date)) over w} as bigint) as days_since from {orders} o window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "Q06_04_weekly": f"select week_start, total, n from {_WEEKS} w",
    "Q06_05_busiest_dow": "select dow, n from (select cast(@DOW(o_orderdate) as bigint) as dow, count(*) as n from {orders} o group by @DOW(o_orderdate)) x order by n desc, dow limit 1",
    "Q06_06_month_growth": f"select month_start, total, round(100 * (total - lag(total) over (order by month_start)) / nullif(lag(total) over (order by month_start), 0), 4) as growth_pct from {_MONTHS} m",
    "Q06_07_longest_streak": """with d as (select distinct cast(o_orderdate as date) as d from {orders} o join {customer} c on o.o_custkey = c.c_custkey where c_nationkey = 3),
      g as (select d, @DIFF(d, date '1990-01-01') - row_number() over (order by d) as grp from d) select max(n) as longest from (select count(*) as n from g group by grp) x""",
    "Q07_01_category": f"select run_id, case when {_PACE} < 5 then 'fast' when {_PACE} < 6.5 then 'steady' when {_PACE} is null then 'none' else 'easy' end as category from {{vrun}} r",
    "Q07_02_coalesce": "select event_id, coalesce(heart_rate, 0) as heart_rate from {vrec} r",
    "Q07_03_label": "select o_orderkey, concat('Run on ', @TXT(o_orderdate), ': ', @FIX2(o_totalprice), 'km') as label from {orders} o",
    "Q07_04_zone": "select event_id, case when heart_rate is null then 'unknown' when heart_rate < 120 then 'easy' when heart_rate < 160 then 'moderate' else 'hard' end as zone from {vrec} r",
    "Q07_05_lower_bound": "select p_partkey, split_part(p_brand, '#', 1) as head, split_part(p_brand, '#', 2) as tail from {part} p",
    "Q07_06_three_classes": "select run_id, case when distance_km < 0.5 then 'short' when distance_km < 1 then 'middle' else 'long' end as by_distance, case when avg_heart_rate < 140 then 'low' when avg_heart_rate is null then 'none' else 'high' end as by_heart, case when duration_seconds > 1000 then 'slow' else 'quick' end as by_time from {vrun} r",
    "Q07_07_guarded": f"select run_id, round({_PACE}, 6) as pace, round(distance_km / nullif(duration_seconds, 0) * 3600, 6) as speed from {{vrun}} r",
    "Q08_01_union": f"select o_custkey from {{orders}} a where {_YEAR} = 1995 union select o_custkey from {{orders}} b where {_YEAR} = 1996",
    "Q08_02_union_counts": f"select (select count(*) from (select o_custkey from {{orders}} a where {_YEAR} = 1995 union select o_custkey from {{orders}} b where {_YEAR} = 1996) x) as n_union, (select count(*) from {{orders}} c where {_YEAR} in (1995, 1996)) as n_all",
    "Q08_03_intersect": "select p_type from {part} a where p_size <= 10 intersect select p_type from {part} b where p_size >= 40",
    "Q08_04_except": f"select o_custkey from {{orders}} a where {_YEAR} = 1995 except select o_custkey from {{orders}} b where {_YEAR} = 1996",
    "Q08_05_over_union": "select bucket, count(*) as n, round(avg(p_retailprice), 4) as mean from (select 'small' as bucket, p_retailprice from {part} a where p_size < 10 union all select 'large' as bucket, p_retailprice from {part} b where p_size > 40) x group by bucket",
    "Q09_01_with_without": "select count(*) as n, count(heart_rate) as with_hr, count(*) - count(heart_rate) as without_hr from {vrec} r",
    "Q09_02_null_rows": "select event_id, run_id from {vrec} r where heart_rate is null",
    "Q09_03_multi_coalesce": "select run_id, coalesce(avg_heart_rate, cast(duration_seconds as double), 0) as first_known from {vrun} r",
    "Q09_04_completeness": "select round(cast(100 * count(heart_rate) as double) / nullif(count(*), 0), 4) as hr_pct, round(cast(100 * count(record_distance_m) as double) / nullif(count(*), 0), 4) as distance_pct from {vrec} r",
    "Q09_05_outliers": "select event_id, round((value - s.m) / s.sd, 6) as z from {events} e cross join (select avg(value) as m, stddev_samp(value) as sd from {events} e2) s where abs(value - s.m) > 3 * s.sd",
    "Q09_06_gap": "select run_id, max(heart_rate) as top from {vrec} r group by run_id having max(heart_rate) is not null and count(heart_rate) < count(*)",
    "Q10_01_week_growth": f"select week_start, round(100 * (total - lag(total) over (order by week_start)) / nullif(lag(total) over (order by week_start), 0), 4) as growth_pct from {_WEEKS} w",
    "Q10_02_year_over_year": f"select month_start, total, lag(total, 12) over (order by month_start) as year_before from {_MONTHS} m",
    "Q10_03_records": f"""with r as (select o_orderkey, cast({_YEAR} as bigint) as yr, o_totalprice, row_number() over (partition by {_YEAR} order by o_totalprice desc, o_orderkey) as hi, row_number() over (partition by {_YEAR} order by o_totalprice, o_orderkey) as lo from {{orders}} o)
      select yr, 'largest' as record, o_orderkey, o_totalprice from r where hi = 1 union all select yr, 'smallest' as record, o_orderkey, o_totalprice from r where lo = 1""",
    "Q10_04_cumulative_pct": f"select month_start, round(100 * sum(total) over (partition by year(month_start) order by month_start) / sum(total) over (partition by year(month_start)), 4) as pct from {_MONTHS} m",
    "Q10_05_load": "select run_id, distance_km * coalesce(avg_heart_rate, 0) as load, round(avg(distance_km * coalesce(avg_heart_rate, 0)) over (partition by subject order by activity_date, run_id rows between 6 preceding and current row), 4) as load7 from {vrun} r",
    "Q10_06_breakthrough": f"with p as (select run_id, subject, {_PACE} as pace, avg({_PACE}) over (partition by subject order by activity_date, run_id rows between 6 preceding and current row) as mean7 from {{vrun}} r) select run_id, round(pace, 6) as pace from p where pace < 0.9 * mean7",
    "Q10_07_rounded_bucket": "select cast(round(distance_km * 10) as bigint) as bucket, count(*) as n from {vrun} r group by cast(round(distance_km * 10) as bigint) having count(*) >= 2",
}.items():
    _course(_name, _text)
