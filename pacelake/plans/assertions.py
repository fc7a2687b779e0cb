"""Data tests: each gives the rows that break a rule; as queries they are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Registry
from . import routes, segments, signals, telemetry

R = Registry()
C = F.col


def unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.where(" or ".join(f"`{c}` is null" for c in cols))


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(C(column).isNotNull() & ~C(column).isin(values))


def relationship(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose key no parent has."""
    return child.where(C(column).isNotNull()).join(parent.select(C(key).alias("_k")), C(column) == C("_k"), "left_anti")


def key_parity(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*cols).distinct().withColumn("_l", F.lit(1)), right.select(*cols).distinct().withColumn("_r", F.lit(1))
    return a.join(b, cols, "full").where("_l is null or _r is null")


def gaps_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose number isn't one more than the row before (or 1 at the start)."""
    return df.withColumn("_p", F.lag(order).over(Window.partitionBy(key).orderBy(order))).where(C(order) != F.coalesce(C("_p") + 1, F.lit(1)))


def breaks(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which a rule is false; unknown is no break."""
    return df.where(~rule)


def reconciliation(cells: DataFrame, records: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Runs and lengths whose segments don't add up to the run's monotone distance and its seconds, or whose last index isn't its end's."""
    run = records.groupBy("run_id").agg(F.greatest(F.max("record_distance_m"), F.lit(0.0)).alias("m"), (F.max("elapsed_seconds") - F.min("elapsed_seconds")).alias("s"))
    sums = cells.groupBy("run_id", "length_m").agg(F.sum("distance_m").alias("dm"), F.sum("seconds").alias("ds"), F.max("segment").alias("last"))
    off = lambda a, b: F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(b)) * 1000
    return sums.join(run, "run_id").where(off(C("dm"), C("m")) | off(C("ds"), C("s").cast("double")) | (C("last") != F.greatest(F.ceil(C("m") / C("length_m")), F.lit(1))))


def _count(name: str, f, sql: str) -> None:
    R.query(name, f"select count(*) as violation_count from ({sql}) x")(lambda t: f(t).agg(F.count("*").alias("violation_count")))


_count("DT01_unique", lambda t: unique(t.orders, ["o_orderkey"]), "select o_orderkey from orders group by 1 having count(*) > 1")
_count("DT01_unique_combination", lambda t: unique(t.lineitem, ["l_orderkey", "l_linenumber"]), "select l_orderkey from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
_count("DT02_not_null", lambda t: not_null(t.vrec, ["heart_rate", "run_id"]), "select 1 from {vrec} r where heart_rate is null or run_id is null")
_count("DT02_accepted_values", lambda t: accepted(t.events, "event_type", ["view", "click", "purchase"]), "select 1 from events where event_type not in ('view', 'click', 'purchase')")
_count("DT02_relationships", lambda t: relationship(t.lineitem, "l_orderkey", t.orders.where("o_orderkey % 10 > 0"), "o_orderkey"), "select 1 from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 > 0)")
_count("DT03_key_parity", lambda t: key_parity(t.vrec, t.vgeo.where("k % 9 > 0"), ["run_id", "record_index"]), "select 1 from {vrec} r where k % 9 = 0")
_count("DT03_ordered", lambda t: gaps_in_order(telemetry.sequence_records(t.vgeo).where("record_index % 7 > 0"), "run_id", "record_index"), f"select 1 from (select record_index, lag(record_index) over (partition by run_id order by record_index) as p from {telemetry.SEQ} s where record_index % 7 > 0) y where record_index <> coalesce(p + 1, 1)")
_count("DT04_baseline_validity", lambda t: breaks(signals.fitness_signals(t.vnat), (C("recovery_count") >= 4) | (C("recovery_median").isNull() & C("recovery_q1").isNull())), f"select 1 from {signals.FIT} f where not (recovery_count >= 4 or (recovery_median is null and recovery_q1 is null))")
_count("DT05_sample_limit", lambda t: telemetry.downsample_even(t.vrec, 5).groupBy("run_id").agg(F.count("*").alias("n")).where("n > 5"), "select run_id from (select run_id, record_index, count(*) over (partition by run_id) as n from {vrec} r) y where n <= 5 or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1) group by run_id having count(*) > 5")
_count("DT05_sample_keys", lambda t: telemetry.downsample_even(t.vrec, 5).join(t.vrec.where("k % 50 > 0"), ["run_id", "record_index"], "left_anti"), "select 1 from (select k, record_index, count(*) over (partition by run_id) as n from {vrec} r) y where k % 50 = 0 and (n <= 5 or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1))")
_count("DT07_decoupling_consistency", lambda t: breaks(signals.decoupling_of(t), (F.abs(C("m1") - C("m2")) <= 0.001) & ((C("status") == "eligible") == C("reason").isNull()) & F.coalesce(F.abs(C("decoupling") - (C("eff1") / C("eff2") - 1)) < 1e-9, F.lit(True))),
       f"select 1 from {signals.DEC} d where not (abs(m1 - m2) <= 0.001 and ((status = 'eligible') = (reason is null)) and coalesce(abs(decoupling - (eff1 / eff2 - 1)) < 1e-9, true))")
_count("DT08_segments_reconcile", lambda t: reconciliation(segments.segments_of(t), t.vgeo), f"""select 1 from (select run_id, length_m, sum(distance_m) as dm, sum(seconds) as ds, max(segment) as last from {segments.SEG} s group by run_id, length_m) a
 join (select run_id, greatest(max(record_distance_m), 0.0) as m, max(elapsed_seconds) - min(elapsed_seconds) as s from {{vgeo}} g group by run_id) b on a.run_id = b.run_id where abs(dm - m) > 1e-6 * greatest(1.0, m) or abs(ds - s) > 1e-6 * greatest(1.0, s) or last <> greatest(cast(ceil(m / length_m) as bigint), 1)""")
_count("DT08_positive_distance_pace", lambda t: breaks(segments.segments_of(t), (C("distance_m") <= 0) | C("pace").isNotNull()), f"select 1 from {segments.SEG} s where not (distance_m <= 0 or pace is not null)")
_count("DT08_boundaries", lambda t: breaks(segments.segments_of(t), C("distance_m") <= C("length_m") + 1e-6), f"select 1 from {segments.SEG} s where distance_m > length_m + 1e-6")
_count("DT09_resolutions", lambda t: t.vrun.crossJoin(F.broadcast(segments.segment_resolutions(t.spark))).groupBy("run_id").agg(F.count_if("is_canonical").alias("n"), F.min("segment_length_m").alias("least")).where("n <> 1 or least <= 0"), f"select run_id from {{vrun}} v cross join {segments._RES} r group by run_id having count(*) filter (where is_canonical) <> 1 or min(segment_length_m) <= 0")
_count("DT10_range_sanity", lambda t: breaks(t.vrec, C("running_cadence").between(0, 170) & C("heart_rate").between(0, 180)), "select 1 from {vrec} r where not (running_cadence between 0 and 170 and heart_rate between 0 and 180)")


def _links_out_of_range(t) -> DataFrame:
    """Links with a similarity not between 0 and 1. All links of two forms have the same, so only those of forms that break the rule are spelled out."""
    obs, links = routes.forms_graph(t)
    return routes.linked(obs, breaks(links, C("similarity").between(0, 1))).agg(F.count("*").alias("violation_count"))


R.query("DT06_similarity_range", f"select count(*) as violation_count from (select 1 from {routes.EDGES} e where similarity not between 0 and 1) x")(_links_out_of_range)
