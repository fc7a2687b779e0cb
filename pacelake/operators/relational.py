"""Projections, filters, joins, aggregates, windows, sorting, sets and generators, each as a query on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Registry
from ..session import cut
from .distributed import nearest_value_ranged, quantiles
from .joins import band_join, interval_overlap, nearest_place, nearest_value, trailing_sum

R = Registry()
C = F.col
D2 = "decimal(18,2)"


def _day(c="o_orderdate"):
    return C(c).cast("date")


def _total(c):
    """An exact sum of amounts."""
    return F.sum(C(c).cast(D2)).cast("double")


# ---- projections and filters -----------------------------------------------------------------------

R.query("PRJ01_projection", "select o_orderkey as run_id, cast(o_orderdate as date) as run_date, cast(o_totalprice as decimal(18,2)) as amount from orders")(
    lambda t: t.orders.select(C("o_orderkey").alias("run_id"), _day().alias("run_date"), C("o_totalprice").cast(D2).alias("amount")))
R.query("PRJ02_star_computed", "select *, c_acctbal * 2 as doubled, upper(c_name) as big from customer")(
    lambda t: t.customer.withColumns({"doubled": C("c_acctbal") * 2, "big": F.upper("c_name")}))
R.query("PRJ03_star_except", "select * exclude (c_acctbal), case when c_acctbal > 0 then c_acctbal end as c_acctbal from customer")(
    lambda t: t.customer.drop("c_acctbal").join(t.customer.select("c_custkey", F.when(C("c_acctbal") > 0, C("c_acctbal")).alias("c_acctbal")), "c_custkey"))
R.query("PRJ04_constants", "select o_orderkey, unit, size, canonical from orders join (values (0, 'metric', 0.25::double, true), (1, 'metric', 1.0::double, false), (2, 'imperial', 0.25::double, false)) v(k, unit, size, canonical) on o_orderkey % 3 = k")(
    lambda t: t.orders.join(F.broadcast(t.spark.createDataFrame([(0, "metric", 0.25, True), (1, "metric", 1.0, False), (2, "imperial", 0.25, False)], "k long, unit string, size double, canonical boolean")), C("o_orderkey") % 3 == C("k")).select("o_orderkey", "unit", "size", "canonical"))
R.query("PRJ05_distinct", "select distinct c_nationkey, c_mktsegment from customer")(lambda t: t.customer.select("c_nationkey", "c_mktsegment").distinct())
R.query("FLT01_precedence", "select o_orderkey from orders where o_orderstatus = 'F' and (o_totalprice > 100000 or not o_orderpriority = '5-LOW')")(
    lambda t: t.orders.where((C("o_orderstatus") == "F") & ((C("o_totalprice") > 100000) | ~(C("o_orderpriority") == "5-LOW"))).select("o_orderkey"))
R.query("FLT02_between", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12 and cast(l_shipdate as date) between date '1995-06-01' and date '1996-06-30'")(
    lambda t: t.lineitem.where(C("l_quantity").between(10, 12) & _day("l_shipdate").between("1995-06-01", "1996-06-30")).select("l_orderkey", "l_linenumber", "l_quantity"))
R.query("FLT03_in", "select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")(
    lambda t: t.customer.where(C("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t.nation.where("n_regionkey = 1"), C("c_nationkey") == C("n_nationkey"), "left_semi").select("c_custkey"))
R.query("FLT04_like", "select p_partkey from part where p_name like '%a%' and p_type ilike '%Econ%'")(lambda t: t.part.where(C("p_name").like("%a%") & C("p_type").ilike("%Econ%")).select("p_partkey"))
R.query("FLT05_rlike", "select event_id, props from events where regexp_matches(json_extract_string(props, '$.k'), '^[0-9]$')")(
    lambda t: t.events.where(F.get_json_object("props", "$.k").rlike("^[0-9]$")).select("event_id", "props"))
R.query("FLT06_null_tests", "select event_id, heart_rate is null as missing, (heart_rate > 150) is true as high, (heart_rate > 150) is not true as not_high from {vrec} r")(
    lambda t: t.vrec.select("event_id", C("heart_rate").isNull().alias("missing"), (C("heart_rate") > 150).eqNullSafe(F.lit(True)).alias("high"), (~(C("heart_rate") > 150).eqNullSafe(F.lit(True))).alias("not_high")))
R.query("FLT07_distinct_from", "select event_id from (select *, lag(heart_rate) over (partition by run_id order by record_index) as p from {vrec} r) x where heart_rate is distinct from p")(
    lambda t: t.vrec.withColumn("p", F.lag("heart_rate").over(Window.partitionBy("run_id").orderBy("record_index"))).where(~C("heart_rate").eqNullSafe(C("p"))).select("event_id"))


def optional_range(df, column: str, low=None, high=None):
    """Rows in a range of which either end may be missing; an inverted range is empty."""
    if low is not None:
        df = df.where(C(column) >= F.lit(low))
    return df.where(C(column) <= F.lit(high)) if high is not None else df


def has_metric(df, column: str, wanted: bool | None):
    """Rows with the metric, without it, or all."""
    return df if wanted is None else df.where(C(column).isNotNull() if wanted else C(column).isNull())


R.query("FLT08_optional_ranges", "select run_id, distance_km from {vrun} r where distance_km >= 0.4 and avg_heart_rate is not null")(
    lambda t: has_metric(optional_range(optional_range(t.vrun, "distance_km", 0.4), "duration_seconds", None, None), "avg_heart_rate", True).select("run_id", "distance_km"))
R.query("FLT09_clamped", "select b.low, b.high, nullif(greatest(b.low, least(b.high, -5.0)), b.low) as from_value, nullif(greatest(b.low, least(b.high, 300000.0)), b.high) as to_value from (select min(o_totalprice) as low, max(o_totalprice) as high from orders) b")(
    lambda t: t.orders.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")).select("low", "high", F.nullif(F.greatest("low", F.least("high", F.lit(-5.0))), "low").alias("from_value"), F.nullif(F.greatest("low", F.least("high", F.lit(300000.0))), "high").alias("to_value")))

# ---- joins -----------------------------------------------------------------------------------------

_OC = lambda t, how="inner": t.orders.join(t.customer, C("o_custkey") == C("c_custkey"), how)
R.query("JN01_inner", "select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey")(lambda t: _OC(t).select("o_orderkey", "c_name", "o_totalprice"))
R.query("JN02_left_chain", "select c_custkey, o_orderkey, l_linenumber from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' left join lineitem on l_orderkey = o_orderkey and l_quantity = 50")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'P'"), C("c_custkey") == C("o_custkey"), "left").join(t.lineitem.where("l_quantity = 50"), C("l_orderkey") == C("o_orderkey"), "left").select("c_custkey", "o_orderkey", "l_linenumber"))
R.query("JN03_full_parity", "select coalesce(o_orderkey, l_orderkey) as k, o_orderkey is null as only_right, l_orderkey is null as only_left from (select o_orderkey from orders where o_orderkey % 3 > 0) a full join (select distinct l_orderkey from lineitem where l_orderkey % 5 > 0) b on o_orderkey = l_orderkey")(
    lambda t: t.orders.where("o_orderkey % 3 > 0").select("o_orderkey").join(t.lineitem.where("l_orderkey % 5 > 0").select("l_orderkey").distinct(), C("o_orderkey") == C("l_orderkey"), "full").select(F.coalesce("o_orderkey", "l_orderkey").alias("k"), C("o_orderkey").isNull().alias("only_right"), C("l_orderkey").isNull().alias("only_left")))
R.query("JN04_left_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")(
    lambda t: t.customer.join(t.orders.where("o_totalprice > 200000"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey"))
R.query("JN05_left_is_null", "select p_partkey from part left join (select distinct l_partkey from lineitem where l_discount >= 0.1 and l_quantity >= 45) l on p_partkey = l_partkey where l_partkey is null")(
    lambda t: t.part.join(t.lineitem.where("l_discount >= 0.1 and l_quantity >= 45"), C("p_partkey") == C("l_partkey"), "left_anti").select("p_partkey"))
R.query("JN06_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F') and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'F'"), C("c_custkey") == C("o_custkey"), "left_semi").join(t.orders.where("o_orderpriority = '1-URGENT'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey"))
R.query("JN07_scalar_row", "select o_orderkey, o_totalprice / m.top as share from orders cross join (select max(o_totalprice) as top from orders) m")(
    lambda t: t.orders.crossJoin(F.broadcast(t.orders.agg(F.max("o_totalprice").alias("top")))).select("o_orderkey", (C("o_totalprice") / C("top")).alias("share")))
R.query("JN08_ordered_pairs", "select a.run_id as l, b.run_id as r from {vrun} a join {vrun} b on a.subject = b.subject and a.run_id < b.run_id and abs(a.distance_km - b.distance_km) <= 0.10 * least(a.distance_km, b.distance_km)")(
    lambda t: t.vrun.select(C("run_id").alias("l"), "subject", C("distance_km").alias("dl")).join(t.vrun.select(C("run_id").alias("r"), C("subject").alias("s2"), C("distance_km").alias("dr")), (C("subject") == C("s2")) & (C("l") < C("r")) & (F.abs(C("dl") - C("dr")) <= 0.10 * F.least("dl", "dr"))).select("l", "r"))
R.query("JN09_self_inequality", "select a.o_orderkey as k1, b.o_orderkey as k2 from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate < b.o_orderdate and b.o_totalprice - a.o_totalprice > 250000")(
    lambda t: t.orders.select(C("o_orderkey").alias("k1"), "o_custkey", C("o_orderdate").alias("d1"), C("o_totalprice").alias("p1")).join(t.orders.select(C("o_orderkey").alias("k2"), C("o_custkey").alias("c2"), C("o_orderdate").alias("d2"), C("o_totalprice").alias("p2")), (C("o_custkey") == C("c2")) & (C("d1") < C("d2")) & (C("p2") - C("p1") > 250000)).select("k1", "k2"))
_CELLS = "select run_id, subject, cast(floor(record_distance_m / 250) as bigint) as pos, cast(k as bigint) as cell from {vrec} r where record_distance_m is not null"
R.query("JN10_band", f"select a.run_id as l, b.run_id as r, a.cell, a.pos, b.pos as r_pos from ({_CELLS}) a join ({_CELLS}) b on a.subject = b.subject and a.cell = b.cell and abs(a.pos - b.pos) <= 1 and a.run_id < b.run_id")(
    lambda t: (lambda x: band_join(x, x, ["subject", "cell"], "pos", 1).where("run_id < r_run_id").select(C("run_id").alias("l"), C("r_run_id").alias("r"), "cell", "pos", "r_pos"))(
        t.vrec.where("record_distance_m is not null").select("run_id", "subject", F.floor(C("record_distance_m") / 250).cast("long").alias("pos"), C("k").cast("long").alias("cell"))))
R.query("JN10_band_whole", R.oracles["JN10_band"])(
    lambda t: (lambda x: band_join(x, x, ["subject", "cell"], "pos", 1).where("run_id < r_run_id").select(C("run_id").alias("l"), C("r_run_id").alias("r"), "cell", "pos", "r_pos"))(
        t.vrec.where("record_distance_m is not null").select("run_id", "subject", F.floor(C("record_distance_m") / 250).cast("long").alias("pos"), C("k").cast("long").alias("cell"))))


def _load(t):
    days = t.orders.groupBy("o_custkey", _day().alias("d")).agg(F.sum(C("o_totalprice").cast(D2)).alias("v"))
    return days.select("o_custkey", "d", trailing_sum(days, "o_custkey", "d", "v", 28, 1).cast("double").alias("prior_28d"), F.coalesce(trailing_sum(days, "o_custkey", "d", "v", 7, 1).cast("double"), F.lit(0.0)).alias("prior_7d"))


R.query("JN11_date_range", """with d as (select o_custkey, cast(o_orderdate as date) as d, sum(cast(o_totalprice as decimal(18,2))) as v from orders group by o_custkey, cast(o_orderdate as date))
 select a.o_custkey, a.d, cast(sum(b.v) as double) as prior_28d, coalesce(cast(sum(b.v) filter (where date_diff('day', b.d, a.d) <= 7) as double), 0.0) as prior_7d from d a
 left join d b on a.o_custkey = b.o_custkey and date_diff('day', b.d, a.d) between 1 and 28 group by a.o_custkey, a.d""")(_load)
_IV = "select run_id, record_index, lag(elapsed_seconds) over (partition by run_id order by record_index) as a, elapsed_seconds as b from {vrec} r"
_WIN = "select run_id, t as c, nt as d from (select run_id, t, et, lead(t) over (partition by run_id order by record_index) as nt, lead(et) over (partition by run_id order by record_index) as ne from {vevt} e) q where et = 'start' and ne = 'stop_all' and nt > t"


def _overlap(t):
    along = Window.partitionBy("run_id").orderBy("record_index")
    rows = t.vrec.select("run_id", "record_index", F.lag("elapsed_seconds").over(along).alias("a"), C("elapsed_seconds").alias("b")).where("a is not null")
    pairs = t.vevt.select("run_id", C("t").alias("c"), F.lead("t").over(along).alias("d"), "et", F.lead("et").over(along).alias("ne")).where("et = 'start' and ne = 'stop_all' and d > c")
    return interval_overlap(rows, pairs, "run_id", ("a", "b"), ("c", "d"), width=500).select("run_id", "record_index", "overlap")


R.query("JN12_interval_overlap", f"select i.run_id, i.record_index, coalesce(sum(case when w.c is not null then cast(greatest(least(i.b, w.d) - greatest(i.a, w.c), 0) as double) end), 0.0) as overlap from ({_IV}) i left join ({_WIN}) w on i.run_id = w.run_id and i.a < w.d and i.b > w.c where i.a is not null group by i.run_id, i.record_index")(_overlap)
R.query("JN13_segment_overlap", """select run_id, record_index, seg, least(b, seg * 250.0) - greatest(a, (seg - 1) * 250.0) as part from (select *, unnest(range(cast(floor(a / 250) as bigint) + 1, cast(ceil(b / 250) as bigint) + 1)) as seg from
 (select run_id, record_index, lag(m) over (partition by run_id order by record_index) as a, m as b from (select *, greatest(max(record_distance_m) over (partition by run_id order by record_index), 0) as m from {vrec} r) x) y where b > a) z""")(
    lambda t: (lambda w: t.vrec.withColumn("b", F.greatest(F.max("record_distance_m").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).withColumn("a", F.lag("b").over(w)).where("b > a")
               .select("run_id", "record_index", "a", "b", F.explode(F.sequence(F.floor(C("a") / 250) + 1, F.ceil(C("b") / 250))).alias("seg"))
               .select("run_id", "record_index", "seg", (F.least(C("b"), C("seg") * 250.0) - F.greatest(C("a"), (C("seg") - 1) * 250.0)).alias("part")))(Window.partitionBy("run_id").orderBy("record_index")))
R.query("JN14_sampling_positions", "select run_id, record_index from (select run_id, record_index, count(*) over (partition by run_id) as n from {vrec} r) x where n <= 5 or record_index in (select 1) or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1)")(
    lambda t: t.vrec.withColumn("n", F.count("*").over(Window.partitionBy("run_id"))).where((C("n") <= 5) | F.exists(F.sequence(F.lit(0), F.lit(4)), lambda i: C("record_index") == F.floor(i * (C("n") - 1) / 4.0) + 1)).select("run_id", "record_index"))
R.query("JN15_week_key", "select o_orderkey, w.n from orders join (select cast(date_trunc('week', o_orderdate) as date) as wk, count(*) as n from orders group by cast(date_trunc('week', o_orderdate) as date)) w on cast(date_trunc('week', o_orderdate) as date) = w.wk")(
    lambda t: t.orders.withColumn("wk", F.date_trunc("week", "o_orderdate").cast("date")).join(t.orders.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("wk")).agg(F.count("*").alias("n")), "wk").select("o_orderkey", "n"))
R.query("JN16_pointer_jump", "with s as (select c_custkey as id, case when c_custkey % 2 = 0 then c_custkey // 2 else c_custkey end as root from customer) select s.id, p.root from s join s p on s.root = p.id")(
    lambda t: (lambda s: s.join(s.select(C("id").alias("id2"), C("root").alias("up")), C("root") == C("id2")).select("id", C("up").alias("root")))(t.customer.select(C("c_custkey").alias("id"), F.when(C("c_custkey") % 2 == 0, F.floor(C("c_custkey") / 2)).otherwise(C("c_custkey")).alias("root"))))


def _points(t):
    points = t.embeddings.select("vec_id", (50 + C("embedding")[0].cast("double") * 5).alias("lat"), (5 + C("embedding")[1].cast("double") * 5).alias("lon"))
    places = t.supplier.select(C("s_name").alias("name"), (48 + (C("s_suppkey") % 10) * 0.4).cast("double").alias("p_lat"), (3 + (C("s_suppkey") % 9) * 0.45).cast("double").alias("p_lon"), C("s_suppkey").cast("long").alias("population"))
    return nearest_place(points, places, "vec_id").select("vec_id", "name", F.round("distance_km", 6).alias("distance_km"), "population")


R.query("JN17_nearest_place", """with p as (select vec_id, 50 + cast(embedding[1] as double) * 5 as lat, 5 + cast(embedding[2] as double) * 5 as lon from embeddings),
 c as (select s_name as name, cast(48 + (s_suppkey % 10) * 0.4 as double) as p_lat, cast(3 + (s_suppkey % 9) * 0.45 as double) as p_lon, cast(s_suppkey as bigint) as population from supplier),
 d as (select vec_id, name, population, 2 * 6371.0 * asin(least(sqrt(pow(sin(radians(p_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2)), 1.0)) as km from p join c on abs(lat - p_lat) <= 0.5 and abs(lon - p_lon) <= 0.7),
 m as (select *, min(km) over (partition by vec_id) as least_km from d)
 select vec_id, name, round(km, 6) as distance_km, population from (select *, row_number() over (partition by vec_id order by population desc, km, name desc) as rn from m where km <= least_km + 0.001) x where rn = 1""")(_points)
R.query("JN18_nearest_value", """with r as (select run_id, cast(record_index as double) as p, cast(k as double) as v from {vrec} r where k % 3 = 0), a as (select run_id, cast(record_index as double) + 0.4 as p from {vrec} r)
 select run_id, p, v from (select a.run_id, a.p, case when abs(r.p - a.p) <= 1.5 then r.v end as v, row_number() over (partition by a.run_id, a.p order by abs(r.p - a.p) nulls last, r.p) as rn from a left join r on a.run_id = r.run_id) x where rn = 1""")(
    lambda t: nearest_value(t.vrec.where("k % 3 = 0").select("run_id", C("record_index").cast("double").alias("p"), C("k").cast("double").alias("v")), t.vrec.select("run_id", (C("record_index").cast("double") + 0.4).alias("p")), "run_id", "p", "v", 1.5))
_JN18 = R.oracles["JN18_nearest_value"]
R.query("JN18_nearest_value_ranged", _JN18)(
    lambda t: nearest_value_ranged(t.vrec.where("k % 3 = 0").select("run_id", C("record_index").cast("double").alias("p"), C("k").cast("double").alias("v")), t.vrec.select("run_id", (C("record_index").cast("double") + 0.4).alias("p")), "run_id", "p", "v", 1.5))
R.query("JN19_using", "select l_orderkey as k, l_linenumber, o_totalprice from lineitem join orders on l_orderkey = o_orderkey")(
    lambda t: t.lineitem.select(C("l_orderkey").alias("k"), "l_linenumber").join(t.orders.select(C("o_orderkey").alias("k"), "o_totalprice"), "k"))
R.query("JN19_using_whole", "select l_orderkey as k, l_linenumber, o_totalprice from lineitem join orders on l_orderkey = o_orderkey")(
    lambda t: t.lineitem.select(C("l_orderkey").alias("k"), "l_linenumber").join(t.orders.select(C("o_orderkey").alias("k"), "o_totalprice"), "k"))
R.query("JN20_chain", "select r_name, n_name, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by r_name, n_name")(
    lambda t: _OC(t).join(t.nation, C("c_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey"), "left").groupBy("r_name", "n_name").agg(F.count("*").alias("n")))
R.query("JN21_fallback_key", """select c_custkey, coalesce(a.n_name, b.n_name, 'unknown') as name from (select c_custkey, case when c_custkey % 3 = 0 then c_nationkey end as code, case when c_custkey % 3 = 1 then ' algeria ' end as label from customer) c
 left join nation a on c.code = a.n_nationkey left join nation b on lower(trim(c.label)) = lower(b.n_name)""")(
    lambda t: t.customer.select("c_custkey", F.when(C("c_custkey") % 3 == 0, C("c_nationkey")).alias("code"), F.when(C("c_custkey") % 3 == 1, " algeria ").alias("label"))
    .join(t.nation.select(C("n_nationkey").alias("k1"), C("n_name").alias("n1")), C("code") == C("k1"), "left").join(t.nation.select(F.lower("n_name").alias("k2"), C("n_name").alias("n2")), F.lower(F.trim("label")) == C("k2"), "left").select("c_custkey", F.coalesce("n1", "n2", F.lit("unknown")).alias("name")))

# ---- aggregates ------------------------------------------------------------------------------------

R.query("AG01_group_by", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, round(avg(l_extendedprice), 4) as mean, min(l_discount) as low, max(l_tax) as high from lineitem group by l_returnflag, l_linestatus")(
    lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _total("l_quantity").alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("low"), F.max("l_tax").alias("high")))
R.query("AG02_global", "select count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total, min(cast(o_orderdate as date)) as first_day from orders")(
    lambda t: t.orders.agg(F.count("*").alias("n"), _total("o_totalprice").alias("total"), F.min(_day()).alias("first_day")))
R.query("AG03_count_column", "select run_id, count(*) as n, count(heart_rate) as with_hr from {vrec} r group by run_id")(lambda t: t.vrec.groupBy("run_id").agg(F.count("*").alias("n"), F.count("heart_rate").alias("with_hr")))
R.query("AG04_count_distinct", "select o_orderpriority, count(distinct o_custkey) as customers, count(distinct o_custkey) filter (where o_totalprice > 150000) as big from orders group by o_orderpriority")(
    lambda t: t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.when(C("o_totalprice") > 150000, C("o_custkey"))).alias("big")))
R.query("AG05_conditional", "select o_custkey, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as f, count(*) filter (where o_totalprice > 100000) as big from orders group by o_custkey")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.sum(F.when(C("o_orderstatus") == "F", 1).otherwise(0)).alias("f"), F.count_if(C("o_totalprice") > 100000).alias("big")))
_KINDS = ("click", "error", "purchase", "signup", "view")
R.query("AG06_pivot", "select user_id, cast(ts as date) as d, " + ", ".join(f"max(case when event_type = '{k}' then value end) as {k}, coalesce(bool_or(event_type = '{k}'), false) as has_{k}" for k in _KINDS) + " from events group by user_id, cast(ts as date)")(
    lambda t: t.events.groupBy("user_id", _day("ts").alias("d")).agg(*[x for k in _KINDS for x in (F.max(F.when(C("event_type") == k, C("value"))).alias(k), F.bool_or(C("event_type") == k).alias(f"has_{k}"))]))
R.query("AG07_arg_extremes", "select run_id, max(case when f = 1 then heart_rate end) as first_hr, max(case when l = 1 then heart_rate end) as last_hr from (select run_id, heart_rate, row_number() over (partition by run_id order by record_index) as f, row_number() over (partition by run_id order by record_index desc) as l from {vrec} r) x group by run_id")(
    lambda t: t.vrec.groupBy("run_id").agg(F.min_by("heart_rate", "record_index").alias("first_hr"), F.max_by("heart_rate", "record_index").alias("last_hr")))
R.query("AG08_arg_tie_break", "select run_id, event_id as low_event from (select run_id, event_id, row_number() over (partition by run_id order by record_distance_m, record_index) as rn from {vrec} r) x where rn = 1")(
    lambda t: t.vrec.groupBy("run_id").agg(F.min_by("event_id", F.struct("record_distance_m", "record_index")).alias("low_event")))
R.query("AG09_weighted_mean", "select l_returnflag, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) as mean from lineitem group by l_returnflag")(
    lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(C("l_extendedprice") * C("l_quantity")) / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 4).alias("mean")))
R.query("AG10_ordered_collect", "select run_id, string_agg(cast(k as varchar), '>' order by record_index) as path from {vrec} r where k is not null group by run_id")(
    lambda t: t.vrec.where("k is not null").groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_index", C("k").cast("string").alias("k")))), lambda x: x["k"]), ">").alias("path")))
R.query("AG11_json_array", "select run_id, count(*) as points from {vrec} r group by run_id")(
    lambda t: t.vrec.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("record_index", "heart_rate")))).alias("j")).select("run_id", F.json_array_length("j").cast("long").alias("points")))
R.query("AG12_any", "select run_id, bool_or(heart_rate > 160) as any_high, max(case when k > 50 then 1 else 0 end) = 1 as any_k from {vrec} r group by run_id")(
    lambda t: t.vrec.groupBy("run_id").agg(F.bool_or(C("heart_rate") > 160).alias("any_high"), (F.max(F.when(C("k") > 50, 1).otherwise(0)) == 1).alias("any_k")))
R.query("AG13_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")(lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"))
R.query("AG14_percentile_observed", "select o_orderpriority, quantile_disc(o_totalprice, 0.5) as median, quantile_disc(o_totalprice, 0.25) as q1 from orders group by o_orderpriority")(
    lambda t: quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5, "q1": 0.25}, discrete=True).drop("n"))
R.query("AG15_percentile_exact", "select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3 from orders group by o_orderpriority")(
    lambda t: quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5, "q3": 0.75}).select("o_orderpriority", F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3")))
R.query("AG15_percentile_whole", "select count(l_extendedprice) as n, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(quantile_cont(l_extendedprice, 0.999), 6) as p999 from lineitem")(
    lambda t: quantiles(t.lineitem, [], "l_extendedprice", {"median": 0.5, "p90": 0.9, "p999": 0.999}).select("n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p999")]))
R.query("AG16_stddev", "select event_type, round(stddev_samp(value), 6) as sd, round(avg(value), 6) as mean from events group by event_type")(
    lambda t: t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.avg("value"), 6).alias("mean")))
R.query("AG17_group_expression", "select case when o_totalprice > 200000 then 'big' else 'small' end as size, cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders group by 1, 2")(
    lambda t: t.orders.groupBy(F.when(C("o_totalprice") > 200000, "big").otherwise("small").alias("size"), F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count("*").alias("n")))


def completeness(df, columns: list[str]):
    """A row for each column: present, missing, percent, distinct, and how reliable that is; one scan."""
    cells = [x for c in columns for x in (F.count(c).alias(f"{c}_p"), F.countDistinct(c).alias(f"{c}_d"))]
    wide = df.agg(F.count("*").alias("n"), *cells)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), C(f"{c}_p").alias("present"), C(f"{c}_d").alias("n_distinct")) for c in columns]))
    pct = F.round(100.0 * C("r.present") / F.nullif("n", F.lit(0)), 4)
    return wide.select("n", rows.alias("r")).select("r.*", (C("n") - C("r.present")).alias("missing"), pct.alias("pct"), F.when(pct > 80, "reliable").when(pct > 20, "partial").when(pct > 0, "sparse").otherwise("absent").alias("reliability"))


_COLS = ("heart_rate", "k", "record_distance_m", "running_cadence")
R.query("AG18_completeness", " union all ".join(f"select '{c}' as column_name, count({c}) as present, count(distinct {c}) as n_distinct, count(*) - count({c}) as missing, round(100.0 * count({c}) / count(*), 4) as pct, case when 100.0 * count({c}) / count(*) > 80 then 'reliable' when 100.0 * count({c}) / count(*) > 20 then 'partial' when count({c}) > 0 then 'sparse' else 'absent' end as reliability from {{vrec}} r" for c in _COLS))(
    lambda t: completeness(t.vrec, list(_COLS)))


def leaf_paths(df: DataFrame, kind: str, ident: str, text: str) -> DataFrame:
    """(kind, path, n): how many documents of a kind hold each leaf path: `$.a.b` for members, `$.a[]` for items of lists.

    Leaves are values, nulls and empty objects and lists. Documents are walked a level at a time, each level on all
    documents at once, until none is nested deeper. Text that isn't JSON, and null text, holds no path.
    """
    front = df.select(kind, ident, F.lit("$").alias("path"), C(text).alias("_text"))
    levels = []
    while True:
        front = cut(front.withColumn("_v", F.try_parse_json("_text")).where("_v is not null").withColumn("_shape", F.schema_of_variant("_v")).select(kind, ident, "path", F.to_json("_v").alias("_text"), "_shape"))
        nested = (C("_shape").startswith("OBJECT") | C("_shape").startswith("ARRAY")) & ~C("_text").isin("{}", "[]")
        levels.append(front.where(~nested).select(kind, "path", ident))
        inner = front.where(nested).withColumn("_v", F.parse_json("_text"))
        if inner.isEmpty():
            break
        each = inner.lateralJoin(df.sparkSession.tvf.variant_explode(C("_v").outer()))
        front = each.select(kind, ident, F.concat("path", F.when(C("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key"))).alias("path"), F.to_json("value").alias("_text"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.groupBy(kind, "path").agg(F.countDistinct(ident).alias("n"))


_NESTED = """(select event_type, event_id, concat('{"props":', props, ',"who":{"id":', user_id, ',"tags":[', case event_id % 4 when 0 then '' when 1 then '1, 2' when 2 then '{"deep": [true, null, {"x": 1.5}]}, "t"' else '[], [[3]]' end, '],"seen":{"at":{"week":', event_id % 53, '}}},"none":',
 case when event_id % 5 = 0 then '{}' when event_id % 5 = 1 then 'null' else '{"value":"a.b"}' end, '}') as doc from events)"""


def _nested(events: DataFrame) -> DataFrame:
    """Events as documents that nest objects and lists."""
    k = C("event_id") % 4
    tags = F.when(k == 0, "").when(k == 1, "1, 2").when(k == 2, '{"deep": [true, null, {"x": 1.5}]}, "t"').otherwise("[], [[3]]")
    none = F.when(C("event_id") % 5 == 0, "{}").when(C("event_id") % 5 == 1, "null").otherwise('{"value":"a.b"}')
    parts = ['{"props":', C("props"), ',"who":{"id":', C("user_id"), ',"tags":[', tags, '],"seen":{"at":{"week":', C("event_id") % 53, '}}},"none":', none, "}"]
    return events.select("event_type", "event_id", F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]).alias("doc"))


R.query("AG19_json_paths", "select event_type, key as path, count(distinct event_id) as n from (select event_type, event_id, unnest(json_keys(props)) as key from events) x group by event_type, key")(
    lambda t: leaf_paths(t.events, "event_type", "event_id", "props").withColumn("path", F.substring_index("path", ".", -1)))
R.query("AG19_leaf_paths", f"""select event_type, path, count(distinct event_id) as n from (select event_type, event_id, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') as path from {_NESTED} d, json_tree(d.doc) x
 where x.type not in ('OBJECT', 'ARRAY') or (x.type = 'OBJECT' and x.value::varchar = '{{}}') or (x.type = 'ARRAY' and x.value::varchar = '[]')) y group by event_type, path""")(
    lambda t: leaf_paths(_nested(t.events), "event_type", "event_id", "doc"))
R.query("AG20_coverage", "select x.kind, count(event_id) as n from (values ('click'), ('purchase'), ('absent')) x(kind) left join events on event_type = x.kind group by x.kind")(
    lambda t: t.spark.createDataFrame([("click",), ("purchase",), ("absent",)], "kind string").join(t.events.groupBy("event_type").agg(F.count("*").alias("c")), C("kind") == C("event_type"), "left").select("kind", F.coalesce("c", F.lit(0)).cast("long").alias("n")))
R.query("AG21_regression", "select round(regr_slope(o_totalprice, x), 6) as slope, round(regr_intercept(o_totalprice, x), 4) as intercept, round(regr_intercept(o_totalprice, x) + regr_slope(o_totalprice, x) * max(x), 4) as at_end from (select o_totalprice, cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as double) as x from orders) y")(
    lambda t: t.orders.select("o_totalprice", F.datediff(_day(), F.lit("1995-01-01").cast("date")).cast("double").alias("x")).agg(F.regr_slope("o_totalprice", "x").alias("s"), F.regr_intercept("o_totalprice", "x").alias("i"), F.max("x").alias("m")).select(F.round("s", 6).alias("slope"), F.round("i", 4).alias("intercept"), F.round(C("i") + C("s") * C("m"), 4).alias("at_end")))
R.query("AG22_histogram", "select cast(floor(heart_rate / 10) * 10 as bigint) as bin, count(*) as n from {vrec} r where heart_rate is not null group by 1")(
    lambda t: t.vrec.where("heart_rate is not null").groupBy((F.floor(C("heart_rate") / 10) * 10).cast("long").alias("bin")).agg(F.count("*").alias("n")))
