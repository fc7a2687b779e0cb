"""Window functions, sorting, sets, subqueries, generators and scalar families as queries on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..registry import Registry
from ..session import cut
from .distributed import running, sliding_quantiles

R = Registry()
C = F.col
D2 = "decimal(18,2)"
CUST = lambda: Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
RUN = lambda: Window.partitionBy("run_id").orderBy("record_index")
_W = "over (partition by o_custkey order by o_orderdate, o_orderkey"
_RW = "over (partition by run_id order by record_index"


def _day(c="o_orderdate"):
    return C(c).cast("date")


def latest_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in `order` (which must be total for a stable answer)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


R.query("WN01_latest", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) x where rn = 1")(
    lambda t: latest_by(t.orders, ["o_custkey"], [C("o_orderdate").desc(), C("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice"))
R.query("WN02_sequence", f"select o_orderkey, cast(row_number() {_W}) as bigint) as seq from orders")(lambda t: t.orders.select("o_orderkey", F.row_number().over(CUST()).cast("long").alias("seq")))


def global_order(df: DataFrame, keys: list[str], name: str, cell_rows: int = 200_000) -> DataFrame:
    """Rank of each row in the whole set without one task for all: rows are cut into ranges of all keys at sampled quantiles, as many
    as their number asks for, ranks restart in each range, and counts of earlier ranges are added. Ranges compare the keys together,
    so a constant first key is cut by the next ones. The ranges are written once, as another sample would cut elsewhere."""
    ranged = cut(df.repartitionByRange(max(1, df.count() // cell_rows), *keys).withColumn("_cell", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = ranged.groupBy(C("_cell").alias("_c")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(*keys))
    return ranged.join(counts, C("_cell") == C("_c")).withColumn(name, (C("_before") + inside).cast("long")).drop("_cell", "_c", "_n", "_before")


R.query("WN03_global_order", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as place from orders")(lambda t: global_order(t.orders, ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place"))
R.query("WN04_ranks", "select p_partkey, rank() over (partition by p_type order by p_size desc) as r, dense_rank() over (partition by p_type order by p_size desc) as d from part")(
    lambda t: (lambda w: t.part.select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d")))(Window.partitionBy("p_type").orderBy(C("p_size").desc())))
R.query("WN05_ntile", "select p_partkey, ntile(4) over (partition by p_type order by p_retailprice, p_partkey) as q from part")(
    lambda t: t.part.select("p_partkey", F.ntile(4).over(Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")).cast("long").alias("q")))
R.query("WN06_top_decile", "select p_partkey from (select p_partkey, percent_rank() over (partition by p_brand order by p_retailprice desc) as pr from part) x where pr <= 0.1")(
    lambda t: t.part.withColumn("pr", F.percent_rank().over(Window.partitionBy("p_brand").orderBy(C("p_retailprice").desc()))).where("pr <= 0.1").select("p_partkey"))
R.query("WN07_lag_lead", f"select o_orderkey, lag(o_totalprice) {_W}) as p1, lag(o_orderstatus = 'F') {_W}) as was_f, lead(cast(o_orderdate as date)) {_W}) as next_day, lag(o_totalprice, 12) {_W}) as p12 from orders")(
    lambda t: t.orders.withColumn("b", F.lag(F.struct("o_totalprice", (C("o_orderstatus") == "F").alias("f"))).over(CUST())).select("o_orderkey", C("b.o_totalprice").alias("p1"), C("b.f").alias("was_f"), F.lead(_day()).over(CUST()).alias("next_day"), F.lag("o_totalprice", 12).over(CUST()).alias("p12")))
R.query("WN08_first_value", "select event_id, first_value(event_type) over (partition by run_id order by record_index) as first_type from {vrec} r")(
    lambda t: t.vrec.select("event_id", F.first("event_type").over(RUN().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first_type")))
R.query("WN09_last_known_before", f"select event_id, last_value(heart_rate ignore nulls) {_RW} rows between unbounded preceding and 1 preceding) as hr from {{vrec}} r")(
    lambda t: t.vrec.select("event_id", F.last("heart_rate", True).over(RUN().rowsBetween(Window.unboundedPreceding, -1)).alias("hr")))
R.query("WN09_last_known_ranged", R.oracles["WN09_last_known_before"])(
    lambda t: running(t.vrec, ["run_id"], ["record_index"], {"hr": ("last", "heart_rate", False)}).select("event_id", "hr"))
R.query("WN10_last_value", f"select event_id, last_value(k) {_RW} rows between unbounded preceding and unbounded following) as last_k from {{vrec}} r")(
    lambda t: t.vrec.select("event_id", F.last_value("k").over(RUN().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_k")))
R.query("WN11_trailing_rows", "select o_orderkey, " + ", ".join(f"cast(sum(cast(o_totalprice as decimal(18,2))) {_W} rows between {n - 1} preceding and current row) as double) as sum{n}" for n in (4, 7, 12, 28)) + f", round(avg(o_totalprice) {_W} rows between 3 preceding and current row), 4) as avg4 from orders")(
    lambda t: t.orders.select("o_orderkey", *[F.sum(C("o_totalprice").cast(D2)).over(CUST().rowsBetween(1 - n, 0)).cast("double").alias(f"sum{n}") for n in (4, 7, 12, 28)], F.round(F.avg("o_totalprice").over(CUST().rowsBetween(-3, 0)), 4).alias("avg4")))


def by_day(key: str, day: str, first: int, last: int):
    """Window over days [day - first, day - last] of a key."""
    return Window.partitionBy(key).orderBy(F.unix_date(C(day).cast("date")).cast("long")).rangeBetween(-first, -last)


_EV = "(select user_id, cast(ts as date) as d, event_id, case when event_type <> 'view' then value end as v from events)"
R.query("WN12_range_days", f"select event_id, round(avg(v) over (partition by user_id order by d range between interval 6 days preceding and current row), 6) as avg7 from {_EV} x")(
    lambda t: t.events.withColumn("v", F.when(C("event_type") != "view", C("value"))).select("event_id", F.round(F.avg("v").over(by_day("user_id", "ts", 6, 0)), 6).alias("avg7")))
_F = "over (partition by user_id order by d range between interval 10 days preceding and interval 1 day preceding)"
R.query("WN13_range_excluding_today", f"select event_id, count(v) {_F} as n, round(avg(v) {_F}, 6) as mean, min(v) {_F} as low, max(v) {_F} as high from {_EV} x")(
    lambda t: (lambda w: t.events.withColumn("v", F.when(C("event_type") != "view", C("value"))).select("event_id", F.count("v").over(w).alias("n"), F.round(F.avg("v").over(w), 6).alias("mean"), F.min("v").over(w).alias("low"), F.max("v").over(w).alias("high")))(by_day("user_id", "ts", 10, 1)))
_E = "over (partition by run_id order by elapsed_seconds range between"
R.query("WN13_sliding_quantiles", """select distinct cast(l_shipdate as date) as day, count(l_quantity) over w as n, cast(quantile_disc(l_quantity, 0.25) over w as double) as q1, cast(quantile_disc(l_quantity, 0.5) over w as double) as median, cast(quantile_disc(l_quantity, 0.75) over w as double) as q3
 from lineitem window w as (order by cast(l_shipdate as date) range between interval 90 days preceding and interval 1 day preceding)""")(
    lambda t: sliding_quantiles(t.lineitem.select(F.unix_date(C("l_shipdate").cast("date")).alias("d"), "l_quantity"), [], "d", "l_quantity", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(F.date_from_unix_date(C("d").cast("int")).alias("day"), "n", "q1", "median", "q3"))
R.query("WN14_range_seconds", f"select event_id, count(heart_rate) {_E} 900 preceding and 600 preceding) as base_n, round(avg(heart_rate) {_E} 600 preceding and current row), 6) as recent from {{vrec}} r")(
    lambda t: (lambda w: t.vrec.select("event_id", F.count("heart_rate").over(w.rangeBetween(-900, -600)).alias("base_n"), F.round(F.avg("heart_rate").over(w.rangeBetween(-600, 0)), 6).alias("recent")))(Window.partitionBy("run_id").orderBy("elapsed_seconds")))
R.query("WN15_centred", f"select event_id, round(avg(altitude_m) {_RW} rows between 2 preceding and 2 following), 6) as smooth from {{vrec}} r")(lambda t: t.vrec.select("event_id", F.round(F.avg("altitude_m").over(RUN().rowsBetween(-2, 2)), 6).alias("smooth")))
R.query("WN16_running", f"select event_id, max(record_distance_m) {_RW}) as monotone, cast(sum(k) {_RW}) as bigint) as total_k, count(heart_rate) {_RW}) as n from {{vrec}} r")(
    lambda t: (lambda w: t.vrec.select("event_id", F.max("record_distance_m").over(w).alias("monotone"), F.sum("k").over(w).alias("total_k"), F.count("heart_rate").over(w).alias("n")))(RUN().rowsBetween(Window.unboundedPreceding, 0)))
R.query("WN16_running_ranged", R.oracles["WN16_running"])(
    lambda t: running(t.vrec, ["run_id"], ["record_index"], {"monotone": ("max", "record_distance_m", True), "total_k": ("sum", "k", True), "n": ("count", "heart_rate", True)}).select("event_id", "monotone", "total_k", "n"))
R.query("WN16_running_whole", "select event_id, max(value) over (order by ts, event_id) as highest, cast(sum(cast(json_extract_string(props, '$.k') as int)) over (order by ts, event_id) as bigint) as total_k, last_value(case when event_type = 'error' then value end ignore nulls) over (order by ts, event_id rows between unbounded preceding and 1 preceding) as last_error from events")(
    lambda t: running(t.events.select("event_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(C("event_type") == "error", C("value")).alias("e")), [], ["ts", "event_id"], {"highest": ("max", "value", True), "total_k": ("sum", "k", True), "last_error": ("last", "e", False)}).select("event_id", "highest", "total_k", "last_error"))
R.query("WN17_partition_total", "select event_id, count(*) over (partition by run_id) as n, cast(sum(k) over (partition by run_id) as bigint) as total from {vrec} r")(
    lambda t: (lambda w: t.vrec.select("event_id", F.count("*").over(w).alias("n"), F.sum("k").over(w).alias("total")))(Window.partitionBy("run_id")))
R.query("WN18_prior_history", f"select o_orderkey, count(*) {_W} rows between unbounded preceding and 1 preceding) as prior_n, round(avg(o_totalprice) {_W} rows between unbounded preceding and 1 preceding), 4) as prior_mean from orders")(
    lambda t: (lambda w: t.orders.select("o_orderkey", F.count("*").over(w).alias("prior_n"), F.round(F.avg("o_totalprice").over(w), 4).alias("prior_mean")))(CUST().rowsBetween(Window.unboundedPreceding, -1)))
R.query("WN19_named", "select o_orderkey, min(o_totalprice) over w as low, max(o_totalprice) over w as high from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)")(
    lambda t: (lambda w: t.orders.select("o_orderkey", F.min("o_totalprice").over(w).alias("low"), F.max("o_totalprice").over(w).alias("high")))(CUST().rowsBetween(-2, 0)))


def islands(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of equal flags in order: key, flag, island, length."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.coalesce((C(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).groupBy(key, flag, "island").agg(F.count("*").alias("n"))


R.query("WN20_islands", "select run_id, missing, island, count(*) as n from (select *, cast(sum(chg) over (partition by run_id order by record_index) as bigint) as island from (select *, coalesce(cast(missing <> lag(missing) over (partition by run_id order by record_index) as int), 1) as chg from (select run_id, record_index, heart_rate is null as missing from {vrec} r) a) b) c group by run_id, missing, island")(
    lambda t: islands(t.vrec.select("run_id", "record_index", C("heart_rate").isNull().alias("missing")), "run_id", "record_index", "missing"))
R.query("WN21_date_islands", "with d as (select distinct o_custkey, cast(o_orderdate as date) as d from orders), g as (select o_custkey, d, date_diff('day', date '1990-01-01', d) - row_number() over (partition by o_custkey order by d) as g from d) select o_custkey, min(d) as first_day, count(*) as n from g group by o_custkey, g having count(*) > 1")(
    lambda t: t.orders.select("o_custkey", _day().alias("d")).distinct().withColumn("g", F.date_sub("d", F.row_number().over(Window.partitionBy("o_custkey").orderBy("d")))).groupBy("o_custkey", "g").agg(F.min("d").alias("first_day"), F.count("*").alias("n")).where("n > 1").drop("g"))
R.query("WN22_reset_streak", "select event_id, case when hit then cast(sum(case when hit then 1 else 0 end) over (partition by run_id, grp order by record_index) as bigint) else 0 end as streak from (select *, sum(case when hit then 0 else 1 end) over (partition by run_id order by record_index) as grp from (select event_id, run_id, record_index, k >= 20 as hit from {vrec} r) a) b")(
    lambda t: t.vrec.withColumn("hit", C("k") >= 20).withColumn("grp", F.sum(F.when(C("hit"), 0).otherwise(1)).over(RUN())).select("event_id", F.when(C("hit"), F.sum(F.when(C("hit"), 1).otherwise(0)).over(Window.partitionBy("run_id", "grp").orderBy("record_index"))).otherwise(0).cast("long").alias("streak")))
R.query("WN23_longest_missing", "select run_id, max(n) as longest from (select run_id, grp, count(*) as n from (select run_id, heart_rate, count(heart_rate) over (partition by run_id order by record_index) as grp from {vrec} r) a where heart_rate is null group by run_id, grp) b group by run_id")(
    lambda t: t.vrec.withColumn("grp", F.count("heart_rate").over(RUN())).where("heart_rate is null").groupBy("run_id", "grp").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max("n").alias("longest")))
R.query("WN24_cumulative_share", f"select o_orderkey, round(100 * sum(cast(o_totalprice as decimal(18,2))) {_W})::double / sum(cast(o_totalprice as decimal(18,2))) over (partition by o_custkey)::double, 4) as pct from orders")(
    lambda t: t.orders.select("o_orderkey", F.round(100 * F.sum(C("o_totalprice").cast(D2)).over(CUST()).cast("double") / F.sum(C("o_totalprice").cast(D2)).over(Window.partitionBy("o_custkey")).cast("double"), 4).alias("pct")))
R.query("WN25_forward_fill", f"select event_id, case when heart_rate is null and k is not null then last_value(heart_rate ignore nulls) {_RW} rows between unbounded preceding and current row) else heart_rate end as filled from {{vrec}} r")(
    lambda t: t.vrec.select("event_id", F.when(C("heart_rate").isNull() & C("k").isNotNull(), F.last("heart_rate", True).over(RUN().rowsBetween(Window.unboundedPreceding, 0))).otherwise(C("heart_rate")).alias("filled")))

# ---- sorting, sets, subqueries, generators ---------------------------------------------------------

R.query("SO01_order_by", "select o_orderpriority, o_totalprice, o_orderkey from orders order by o_orderpriority, o_totalprice desc, o_orderkey")(lambda t: t.orders.orderBy("o_orderpriority", C("o_totalprice").desc(), "o_orderkey").select("o_orderpriority", "o_totalprice", "o_orderkey"))
R.query("SO02_nulls_last", "select event_id, heart_rate from {vrec} r order by heart_rate desc nulls last, record_timestamp, event_id")(lambda t: t.vrec.orderBy(C("heart_rate").desc_nulls_last(), "record_timestamp", "event_id").select("event_id", "heart_rate"))
R.query("SO02_nulls_last_whole", "select event_id, heart_rate from {vrec} r order by heart_rate desc nulls last, record_timestamp, event_id")(lambda t: t.vrec.orderBy(C("heart_rate").desc_nulls_last(), "record_timestamp", "event_id").select("event_id", "heart_rate"))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page of 1 to 1000 rows from a place not below 0, with the count of all rows."""
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit))).crossJoin(F.broadcast(total))


R.query("SO03_page", "select o_orderkey, o_totalprice, count(*) over () as total_count from orders order by o_totalprice desc, o_orderkey limit 1000 offset 0")(
    lambda t: page(t.orders.select("o_orderkey", "o_totalprice"), [C("o_totalprice").desc(), "o_orderkey"], 5000, -3))
R.query("SO04_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")(lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(C("o_totalprice").desc(), "o_orderkey").limit(10))
R.query("SO05_top_per_group", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as rn from orders) x where rn = 1")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", "o_orderkey")).alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice"))
R.query("SO06_latest_values", """select run_id, max(case when rn = 1 then heart_rate end) as latest, max(case when heart_rate is not null and nn = 1 then heart_rate end) as latest_known, max(case when dr = 2 then k end) as second_k from (select *, row_number() over (partition by run_id order by record_index desc) as rn,
 row_number() over (partition by run_id order by heart_rate is null, record_index desc) as nn, dense_rank() over (partition by run_id order by k desc) as dr from {vrec} r) x group by run_id""")(
    lambda t: t.vrec.withColumn("dr", F.dense_rank().over(Window.partitionBy("run_id").orderBy(C("k").desc()))).groupBy("run_id").agg(
        F.max_by("heart_rate", "record_index").alias("latest"), F.max_by("heart_rate", F.when(C("heart_rate").isNotNull(), C("record_index"))).alias("latest_known"), F.max(F.when(C("dr") == 2, C("k"))).alias("second_k")))
R.query("SO07_directed", "select run_id, avg_heart_rate from {vrun} r order by avg_heart_rate asc nulls last, run_id")(lambda t: t.vrun.orderBy(C("avg_heart_rate").asc_nulls_last(), "run_id").select("run_id", "avg_heart_rate"))
R.query("SO07_directed_whole", "select run_id, avg_heart_rate from {vrun} r order by avg_heart_rate asc nulls last, run_id")(lambda t: t.vrun.orderBy(C("avg_heart_rate").asc_nulls_last(), "run_id").select("run_id", "avg_heart_rate"))
R.query("ST01_union_all", "select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region")(lambda t: t.nation.select(C("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(t.region.select(C("r_name").alias("name"), F.lit("region").alias("kind"))))
R.query("ST02_union", "select c_nationkey as k from customer union select s_nationkey from supplier")(lambda t: t.customer.select(C("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
R.query("ST03_intersect", "select l_partkey as k from lineitem where l_quantity = 1 intersect select l_partkey from lineitem where l_quantity = 50")(lambda t: t.lineitem.where("l_quantity = 1").select(C("l_partkey").alias("k")).intersect(t.lineitem.where("l_quantity = 50").select("l_partkey")))
R.query("ST04_except", "select p_partkey as k from part except select l_partkey from lineitem where l_discount > 0.09")(lambda t: t.part.select(C("p_partkey").alias("k")).subtract(t.lineitem.where("l_discount > 0.09").select("l_partkey")))
R.query("ST05_union_aggregate", "select kind, count(*) as n, round(avg(bal), 4) as mean from (select 'c' as kind, c_acctbal as bal from customer union all select 's', s_acctbal from supplier) x group by kind")(
    lambda t: t.customer.select(F.lit("c").alias("kind"), C("c_acctbal").alias("bal")).unionByName(t.supplier.select(F.lit("s").alias("kind"), C("s_acctbal").alias("bal"))).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("bal"), 4).alias("mean")))
R.sql("SQ01_scalar_subquery", "select o_orderkey, o_totalprice, (select count(*) from {customer} c) as n_customers from {orders} o where o_totalprice > 1.5 * (select avg(o_totalprice) from {orders} o2)")
R.query("SQ02_correlated", "select o_orderkey from orders o where o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)")(
    lambda t: t.orders.withColumn("m", F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))).where("o_totalprice > m").select("o_orderkey"))
R.sql("SQ03_recursive_cte", "with recursive n(i) as (select cast(1 as bigint) union all select i + 1 from n where i < 7), q as (select l_linenumber, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty from {lineitem} l group by l_linenumber), m as (select max(qty) as top from q) select i, qty, top from n left join q on i = l_linenumber cross join m")
R.query("GN01_sequence", "select l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) as i from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("long"), C("l_linenumber").cast("long"))).alias("i")))
R.query("GN01_sequence_whole", "select l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) as i from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("long"), C("l_linenumber").cast("long"))).alias("i")))


def date_spine(dates: DataFrame, column: str, last=None) -> DataFrame:
    """One row a day from the earliest date to `last` (or the latest date); empty where there is none or the end lies before."""
    ends = dates.agg(F.min(C(column).cast("date")).alias("a"), (F.lit(last).cast("date") if last else F.max(C(column).cast("date"))).alias("b"))
    return ends.where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("calendar_date"))


R.query("GN02_date_spine", "select cast(unnest(generate_series(min(cast(o_orderdate as date))::timestamp, date '2001-12-31'::timestamp, interval 1 day)) as date) as calendar_date from orders")(lambda t: date_spine(t.orders, "o_orderdate", "2001-12-31"))
R.query("GN03_posexplode", "select vec_id, i as pos, cast(embedding[i + 1] as double) as x from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings) y")(lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", C("p").cast("long").alias("pos"), C("v").cast("double").alias("x")))
R.query("GN03_posexplode_whole", "select vec_id, i as pos, cast(embedding[i + 1] as double) as x from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings) y")(lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", C("p").cast("long").alias("pos"), C("v").cast("double").alias("x")))
R.query("GN04_unpivot", "select p_partkey, 'size' as metric, cast(p_size as double) as v from part union all select p_partkey, 'price', p_retailprice from part")(
    lambda t: t.part.select("p_partkey", C("p_size").cast("double").alias("size"), C("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "metric", "v"))

# ---- scalar families -------------------------------------------------------------------------------

R.query("SC01_conditional", "select event_id, case when k > 50 then 'hi' when k > 20 then 'mid' else 'lo' end as c, coalesce(heart_rate, -1) as hr, nullif(k, 0) as k from {vrec} r")(
    lambda t: t.vrec.select("event_id", F.when(C("k") > 50, "hi").when(C("k") > 20, "mid").otherwise("lo").alias("c"), F.coalesce("heart_rate", F.lit(-1.0)).alias("hr"), F.nullif("k", F.lit(0)).alias("k")))
R.query("SC02_cast", "select c_custkey, cast(c_acctbal as decimal(10,1)) as d, try_cast(c_name as int) as bad, try_cast(substring(c_name, 10) as bigint) as num, cast(c_custkey as varchar) as s from customer")(
    lambda t: t.customer.select("c_custkey", C("c_acctbal").cast("decimal(10,1)").alias("d"), C("c_name").try_cast("int").alias("bad"), F.substring("c_name", 10, 100).try_cast("long").alias("num"), C("c_custkey").cast("string").alias("s")))
R.query("SC03_math", "select l_orderkey, l_linenumber, l_extendedprice / l_quantity as unit, cast(floor(l_extendedprice) as bigint) as f, cast(ceil(l_extendedprice) as bigint) as c, abs(l_discount - 0.05) as a, greatest(l_discount, l_tax) as g, least(l_discount, l_tax) as l, round(l_discount / nullif(l_tax, 0), 4) as r from lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (C("l_extendedprice") / C("l_quantity")).alias("unit"), F.floor("l_extendedprice").alias("f"), F.ceil("l_extendedprice").alias("c"), F.abs(C("l_discount") - 0.05).alias("a"), F.greatest("l_discount", "l_tax").alias("g"), F.least("l_discount", "l_tax").alias("l"), F.round(S.ratio(C("l_discount"), C("l_tax")), 4).alias("r")))
R.query("SC04_trig", "select event_id, round(2 * 6371.0 * asin(least(sqrt(pow(sin(radians(52.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(52.5)) * pow(sin(radians(5.0 - lon) / 2), 2)), 1.0)), 6) as km from {vgeo} r")(
    lambda t: t.vgeo.select("event_id", F.round(S.haversine_km(C("lat"), C("lon"), F.lit(52.5), F.lit(5.0)), 6).alias("km")))
R.query("SC05_date", """select o_orderkey, cast(date_trunc('month', d) as date) as m, d + 7 as plus7, cast(d + interval 1 month as date) as next_month, last_day(d) as eom, date_diff('day', date '1995-01-01', d) as days, dayofweek(d) + 1 as dow, day(d) as dom, week(d) as wk, month(d) as mon, quarter(d) as q, year(d) as y, strftime(d, '%a') as e
 from (select o_orderkey, cast(o_orderdate as date) as d from orders) x""")(
    lambda t: t.orders.select("o_orderkey", _day().alias("d")).select("o_orderkey", F.date_trunc("month", "d").cast("date").alias("m"), F.date_add("d", 7).alias("plus7"), F.add_months("d", 1).alias("next_month"), F.last_day("d").alias("eom"), F.datediff("d", F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
        F.dayofweek("d").cast("long").alias("dow"), F.dayofmonth("d").cast("long").alias("dom"), F.weekofyear("d").cast("long").alias("wk"), F.month("d").cast("long").alias("mon"), F.quarter("d").cast("long").alias("q"), F.year("d").cast("long").alias("y"), F.date_format("d", "E").alias("e")))
R.query("SC06_time", """select event_id, cast(floor(epoch(ts)) as bigint) as s, cast(ts as timestamp) as from_text, make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000) as from_s from events""")(
    lambda t: t.events.withColumn("ts", C("ts").cast("timestamp")).withColumn("s", F.unix_timestamp("ts")).select("event_id", "s", S.instant(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("from_text"), S.instant(C("s").cast("string")).alias("from_s")))
R.query("SC07_local_today", "select event_id, cast(ts + interval 1 hour as date) as d from events")(lambda t: t.events.select("event_id", S.local_today(C("ts").cast("timestamp"), "GMT+1").alias("d")))
R.query("SC08_extract", "select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(dow from o_orderdate) as dow, cast(o_orderdate as date) + 3 as later, date_diff('day', cast(o_orderdate as date), date '2002-01-01') as ago, cast(o_orderdate as date) < date '1998-01-01' as old from orders")(
    lambda t: t.orders.select("o_orderkey", F.extract(F.lit("year"), "o_orderdate").cast("long").alias("y"), F.extract(F.lit("month"), "o_orderdate").cast("long").alias("m"), (F.extract(F.lit("dow"), "o_orderdate") - 1).cast("long").alias("dow"), F.date_add(_day(), 3).alias("later"), F.datediff(F.lit("2002-01-01").cast("date"), _day()).cast("long").alias("ago"), (_day() < F.lit("1998-01-01").cast("date")).alias("old")))
R.query("SC09_string", "select p_partkey, concat(p_brand, '/', p_type) as c, concat_ws('-', p_brand, cast(p_size as varchar)) as w, p_name || '!' as b, upper(p_name) as u, lower(p_type) as l, trim('  ' || p_name || ' ') as t, length(p_name) as n, replace(p_name, 'a', 'A') as r, substring(p_name, 2, 3) as s, split_part(p_brand, '#', 2) as sp from part")(
    lambda t: t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("c"), F.concat_ws("-", "p_brand", C("p_size").cast("string")).alias("w"), F.concat("p_name", F.lit("!")).alias("b"), F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"), F.length("p_name").cast("long").alias("n"), F.replace("p_name", F.lit("a"), F.lit("A")).alias("r"), F.substring("p_name", 2, 3).alias("s"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("sp")))
R.query("SC10_regex", "select p_partkey, regexp_matches(p_brand, '^Brand#[0-9]+$') as ok, regexp_extract(p_brand, '#([0-9])', 1) as d from part")(lambda t: t.part.select("p_partkey", C("p_brand").rlike("^Brand#[0-9]+$").alias("ok"), F.regexp_extract("p_brand", "#([0-9])", 1).alias("d")))
R.query("SC11_hash", "select c_custkey, sha256(concat(c_name, '|', c_mktsegment)) as id from customer")(lambda t: t.customer.select("c_custkey", F.sha2(F.concat("c_name", F.lit("|"), "c_mktsegment"), 256).alias("id")))
R.query("SC12_arrays", "select p_partkey, array_to_string(list_filter([case when p_size > 10 then 'a' end, case when p_size > 20 then 'b' end, 'c'], lambda x: x is not null), ',') as kept, cast(list_sum(list_transform([p_size, 1, 2], lambda x: x * 2)) as bigint) as total from part")(
    lambda t: t.part.select("p_partkey", F.array_join(F.filter(F.array(F.when(C("p_size") > 10, "a"), F.when(C("p_size") > 20, "b"), F.lit("c")), lambda x: x.isNotNull()), ",").alias("kept"), F.aggregate(F.transform(F.array(C("p_size").cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long")), lambda x: x * 2), F.lit(0).cast("long"), lambda a, b: a + b).alias("total")))
R.query("SC13_json_fallback", "select event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) as v from events")(lambda t: t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("v")))
R.query("SC14_struct", "select o_orderkey, o_totalprice * 2 as twice from orders")(lambda t: t.orders.select("o_orderkey", F.struct((C("o_totalprice") * 2).alias("x"), "o_orderkey").alias("s")).select("o_orderkey", C("s.x").alias("twice")))
R.query("SC15_geo", "select event_id, case when lat is null then null else cast(floor(lat / 0.002) as bigint) * 100000 + cast(floor(lon / 0.002) as bigint) end as cell, lat between -90 and 90 as valid from {vgeo} r")(lambda t: t.vgeo.select("event_id", S.grid_cell(C("lat"), C("lon"), 0.002).alias("cell"), C("lat").between(-90, 90).alias("valid")))
R.query("SC16_units", "select run_id, round(distance_km * 0.621371192237334, 6) as miles, case when distance_km > 0 and duration_seconds > 0 then round(duration_seconds / 60.0 / distance_km, 6) end as pace, round(distance_km / nullif(duration_seconds, 0) * 3600, 6) as kmh from {vrun} r")(
    lambda t: t.vrun.select("run_id", F.round(C("distance_km") * S.MILES_PER_KM, 6).alias("miles"), F.round(S.pace_min_per_km(C("duration_seconds"), C("distance_km")), 6).alias("pace"), F.round(S.ratio(C("distance_km"), C("duration_seconds").cast("double")) * 3600, 6).alias("kmh")))
_BAND = "case " + " ".join(f"when h between {b} and {b + 9} then '{b}-{b + 9}'" for b in range(100, 170, 10)) + " else 'other' end"
R.query("SC17_bands", f"select event_id, {_BAND} as band, case when h is null then null when h < 120 then 'easy' when h < 160 then 'steady' else 'hard' end as level, cast(floor(k / 10) as bigint) * 10 as grp from (select event_id, heart_rate + 0.5 * (event_id % 2) as h, k from {{vrec}} r) x")(
    lambda t: t.vrec.withColumn("h", C("heart_rate") + 0.5 * (C("event_id") % 2)).select("event_id", S.heart_rate_band(C("h")).alias("band"), S.levels(C("h"), [120, 160], ["easy", "steady", "hard"]).alias("level"), (F.floor(C("k") / 10) * 10).cast("long").alias("grp")))
R.query("SC18_trend", f"select o_orderkey, case when o_totalprice > p then 'up' when o_totalprice < p then 'down' when o_totalprice = p then 'flat' end as direction, round(o_totalprice - p, 6) as diff, round((o_totalprice - p) / nullif(p, 0), 6) as relative from (select *, lag(o_totalprice) {_W}) as p from orders) x")(
    lambda t: t.orders.withColumn("p", F.lag("o_totalprice").over(CUST())).select("o_orderkey", S.trend(C("o_totalprice"), C("p")).alias("t")).select("o_orderkey", "t.direction", F.round("t.diff", 6).alias("diff"), F.round("t.relative", 6).alias("relative")))

#: Preset windows: name to first day as SQL over `as_of`.
PRESETS = {"last_7_days": "date_sub(as_of, 6)", "last_4_weeks": "date_sub(as_of, 27)", "last_90_days": "date_sub(as_of, 89)", "month_to_date": "trunc(as_of, 'month')", "year_to_date": "trunc(as_of, 'year')", "last_12_months": "date_add(add_months(as_of, -12), 1)", "last_30_days": "date_sub(as_of, 29)"}


def comparison_windows(days: DataFrame) -> DataFrame:
    """For each as_of date and preset: the window, the period of equal length before it, and the same dates a year earlier (29 February becomes 28)."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("preset"), F.expr(e).alias("from_date")) for n, e in PRESETS.items()]))
    out = days.select("as_of", rows.alias("w")).select("as_of", "w.*").withColumn("n", F.datediff("as_of", "from_date") + 1)
    return out.select("as_of", "preset", "from_date", F.date_sub("from_date", C("n")).alias("previous_from"), F.date_sub("from_date", 1).alias("previous_to"), F.add_months("from_date", -12).alias("year_ago_from"), F.add_months("as_of", -12).alias("year_ago_to"))


_P = {"last_7_days": "as_of - 6", "last_4_weeks": "as_of - 27", "last_90_days": "as_of - 89", "month_to_date": "cast(date_trunc('month', as_of) as date)", "year_to_date": "cast(date_trunc('year', as_of) as date)", "last_12_months": "cast(as_of - interval 12 month as date) + 1", "last_30_days": "as_of - 29"}
R.query("SC19_windows", "select as_of, preset, f as from_date, cast(f - cast(date_diff('day', f, as_of) + 1 as int) as date) as previous_from, f - 1 as previous_to, cast(f - interval 12 month as date) as year_ago_from, cast(as_of - interval 12 month as date) as year_ago_to from (" + " union all ".join(f"select as_of, '{n}' as preset, {e} as f from (select distinct cast(o_orderdate as date) as as_of from orders) d" for n, e in _P.items()) + ") x")(
    lambda t: comparison_windows(t.orders.select(_day().alias("as_of")).distinct()))
