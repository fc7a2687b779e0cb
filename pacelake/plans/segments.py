"""Proportional allocation of records to distance segments of several lengths at once.

Each interval between two records names the segments it crosses by its own ends, so segments are generated from
the interval and never joined to it; the cost is linear in intervals and crossings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..registry import Registry

R = Registry()
C = F.col
#: Unit system, length in its unit, length in metres, label; the first is the canonical one.
RESOLUTIONS = (
    ("metric", "0.25", 250.0, "250 m"), ("metric", "0.50", 500.0, "500 m"), ("metric", "1.00", 1000.0, "1 km"),
    ("imperial", "0.25", 402.336, "0.25 mi"), ("imperial", "0.50", 804.672, "0.5 mi"), ("imperial", "1.00", 1609.344, "1 mi"),
)


def segment_resolutions(spark) -> DataFrame:
    rows = [(u, v, m, label, i == 0) for i, (u, v, m, label) in enumerate(RESOLUTIONS)]
    return spark.createDataFrame(rows, "unit_system string, value string, segment_length_m double, label string, is_canonical boolean").withColumn("value", C("value").cast("decimal(4,2)"))


_RES = "(select * from (values " + ", ".join(f"('{u}', cast({v} as decimal(4,2)), cast({m} as double), '{label}', {str(i == 0).lower()})" for i, (u, v, m, label) in enumerate(RESOLUTIONS)) + ") v(unit_system, value, segment_length_m, label, is_canonical))"
R.query("MD11_segment_resolutions", f"select run_id, label, is_canonical, value, greatest(cast(ceil(distance_km * 1000 / segment_length_m) as bigint), 1) as n_segments from {{vrun}} v cross join {_RES} r")(
    lambda t: t.vrun.crossJoin(F.broadcast(segment_resolutions(t.spark))).select("run_id", "label", "is_canonical", "value", F.greatest(F.ceil(C("distance_km") * 1000 / C("segment_length_m")), F.lit(1)).cast("long").alias("n_segments")))


def _between(name: str, at: Column) -> Column:
    """Value at a fraction of the interval where both ends have one, else the end that has."""
    a, b = C(f"_p.{name}"), C(name)
    return F.when(a.isNotNull() & b.isNotNull(), a + (b - a) * at)


def distance_segments(records: DataFrame, lengths: list[float]) -> DataFrame:
    """One row for each run, segment length and segment: distance, seconds, pace, speed, heart rate, cadence, altitude, coordinates.

    Distance is made monotone; an interval (a, b] gives each crossed segment its share of distance and seconds; an
    interval without distance gives all its seconds to the segment of its end. Measures are interpolated at the
    middle of a share and weighted by its seconds (else its distance, else 1).

    Shares of a segment follow each other as their records do, so first and last are told by a row's place in its run, and a record
    counts where no row of its number before it has a share; with one number as order the sums need no sort.
    """
    run = Window.partitionBy("run_id").orderBy("record_index")
    rows = records.withColumn("_m", F.greatest(F.coalesce(F.max("record_distance_m").over(run.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), F.lit(0.0)))
    kept = ("elapsed_seconds", "heart_rate", "running_cadence", "altitude_m", "lat", "lon")
    rows = rows.withColumn("_p", F.lag(F.struct("_m", "record_index", *kept)).over(run)).withColumn("_k", F.row_number().over(run))
    rows = rows.withColumns({"a": F.coalesce("_p._m", F.lit(0.0)), "b": C("_m"), "sec": F.greatest((C("elapsed_seconds") - F.coalesce("_p.elapsed_seconds", "elapsed_seconds")).cast("double"), F.lit(0.0))})
    rows = rows.withColumn("length_m", F.explode(F.array(*[F.lit(float(x)) for x in lengths])))
    moving = C("b") > C("a")
    own = F.greatest(F.ceil(C("b") / C("length_m")), F.lit(1))
    last = F.greatest(F.ceil(C("b") / C("length_m")), F.lit(1))
    first = F.least(F.floor(C("a") / C("length_m")) + 1, last)
    rows = rows.withColumn("segment", F.explode(F.when(moving, F.sequence(first, last)).otherwise(F.array(own))))
    lo = F.when(moving, F.greatest("a", (C("segment") - 1) * C("length_m"))).otherwise(C("b"))
    hi = F.when(moving, F.least("b", C("segment") * C("length_m"))).otherwise(C("b"))
    rows = rows.withColumns({"lo": lo, "hi": hi}).where(~moving | (C("hi") > C("lo")))
    span = C("b") - C("a")
    rows = rows.withColumns({"part": C("hi") - C("lo"), "f0": F.when(moving, (C("lo") - C("a")) / span).otherwise(0.0), "f1": F.when(moving, (C("hi") - C("a")) / span).otherwise(1.0)})
    rows = rows.withColumn("s", F.when(moving, C("sec") * C("part") / span).otherwise(C("sec"))).withColumn("_mid", (C("f0") + C("f1")) / 2.0)
    rows = rows.withColumns({"w": F.when(C("s") > 0, C("s")).when(C("part") > 0, C("part")).otherwise(1.0), **{f"{n}_mid": F.coalesce(_between(n, C("_mid")), C(n), C(f"_p.{n}")) for n in ("heart_rate", "running_cadence")},
                             **{f"{n}_0": F.coalesce(_between(n, C("f0")), C(f"_p.{n}"), C(n)) for n in ("heart_rate", "altitude_m", "lat", "lon")}, **{f"{n}_1": F.coalesce(_between(n, C("f1")), C(n), C(f"_p.{n}")) for n in ("heart_rate", "altitude_m", "lat", "lon")}})
    mean = lambda n: ratio(F.sum(C(f"{n}_mid") * C("w")), F.sum(F.when(C(f"{n}_mid").isNotNull(), C("w"))))
    done = F.when(C("_p.record_index") == C("record_index"), F.greatest(F.ceil(C("a") / C("length_m")), F.lit(1)))  # last segment of an equal number before
    counted = C("record_index").isNotNull() & F.coalesce(C("segment") > done, F.lit(True))
    out = rows.groupBy("run_id", "length_m", "segment").agg(
        F.sum("part").alias("distance_m"), F.sum("s").alias("seconds"), mean("heart_rate").alias("avg_heart_rate"), F.max(F.greatest("heart_rate_0", "heart_rate_1")).alias("max_heart_rate"), mean("running_cadence").alias("avg_cadence"),
        F.min(F.least("altitude_m_0", "altitude_m_1")).alias("min_altitude_m"), F.max(F.greatest("altitude_m_0", "altitude_m_1")).alias("max_altitude_m"), (F.max_by("altitude_m_1", "_k") - F.min_by("altitude_m_0", "_k")).alias("elevation_change_m"),
        F.min_by("lat_0", "_k").alias("start_lat"), F.min_by("lon_0", "_k").alias("start_lon"), F.max_by("lat_1", "_k").alias("end_lat"), F.max_by("lon_1", "_k").alias("end_lon"), F.count_if(counted).alias("record_count"),
    )
    return out.withColumns({"pace": F.when(C("distance_m") > 0, C("seconds") / 60.0 / (C("distance_m") / 1000.0)), "speed_kmh": F.when(C("seconds") > 0, C("distance_m") / C("seconds") * 3.6), "grade": F.when(C("distance_m") > 0, C("elevation_change_m") / C("distance_m"))})


def _mid(n, f, order):
    return f"coalesce(p_{n} + ({n} - p_{n}) * {f}, {order})"


SEG_LENGTHS = (250.0, 402.336, 500.0)
_MEASURES = ("distance_m", "seconds", "avg_heart_rate", "max_heart_rate", "avg_cadence", "min_altitude_m", "max_altitude_m", "elevation_change_m", "start_lat", "start_lon", "end_lat", "end_lon", "pace", "speed_kmh", "grade")
_SLOTS = ("heart_rate", "altitude_m", "lat", "lon")
SEG = f"""(select *, case when distance_m > 0 then seconds / 60.0 / (distance_m / 1000.0) end as pace, case when seconds > 0 then distance_m / seconds * 3.6 end as speed_kmh, case when distance_m > 0 then elevation_change_m / distance_m end as grade from
 (select run_id, length_m, segment, sum(part) as distance_m, sum(s) as seconds, sum(hm * w) / nullif(sum(case when hm is not null then w end), 0) as avg_heart_rate, max(greatest(heart_rate_0, heart_rate_1)) as max_heart_rate, sum(cm * w) / nullif(sum(case when cm is not null then w end), 0) as avg_cadence,
 min(least(altitude_m_0, altitude_m_1)) as min_altitude_m, max(greatest(altitude_m_0, altitude_m_1)) as max_altitude_m, max(case when lr = 1 then altitude_m_1 end) - max(case when fr = 1 then altitude_m_0 end) as elevation_change_m, max(case when fr = 1 then lat_0 end) as start_lat, max(case when fr = 1 then lon_0 end) as start_lon,
 max(case when lr = 1 then lat_1 end) as end_lat, max(case when lr = 1 then lon_1 end) as end_lon, count(distinct record_index) as record_count from
 (select *, case when s > 0 then s when part > 0 then part else 1.0 end as w, row_number() over (partition by run_id, length_m, segment order by lo, record_index) as fr, row_number() over (partition by run_id, length_m, segment order by hi desc, record_index desc) as lr,
  {_mid("heart_rate", "(f0 + f1) / 2", "heart_rate, p_heart_rate")} as hm, {_mid("running_cadence", "(f0 + f1) / 2", "running_cadence, p_running_cadence")} as cm,
  {", ".join(f"{_mid(n, 'f0', f'p_{n}, {n}')} as {n}_0, {_mid(n, 'f1', f'{n}, p_{n}')} as {n}_1" for n in _SLOTS)} from
 (select *, hi - lo as part, case when b > a then (lo - a) / (b - a) else 0.0 end as f0, case when b > a then (hi - a) / (b - a) else 1.0 end as f1, case when b > a then sec * (hi - lo) / (b - a) else sec end as s from
 (select *, case when b > a then greatest(a, (segment - 1) * length_m) else b end as lo, case when b > a then least(b, segment * length_m) else b end as hi from
 (select *, unnest(case when b > a then range(cast(floor(a / length_m) as bigint) + 1, cast(ceil(b / length_m) as bigint) + 1) else [greatest(cast(ceil(b / length_m) as bigint), 1)] end) as segment from
 (select x.*, coalesce(lag(b) over w, 0.0) as a, greatest(cast(elapsed_seconds - coalesce(lag(elapsed_seconds) over w, elapsed_seconds) as double), 0.0) as sec, {", ".join(f"lag({n}) over w as p_{n}" for n in (*_SLOTS, "running_cadence"))} from
 (select *, greatest(coalesce(max(record_distance_m) over (partition by run_id order by record_index), 0.0), 0.0) as b from {{vgeo}} r) x window w as (partition by run_id order by record_index)) y
 cross join (select unnest([{", ".join(map(str, SEG_LENGTHS))}]::double[]) as length_m) l) z) z2 where b <= a or hi > lo) z3) z4 group by 1, 2, 3) z5)"""


def segments_of(t, lengths: tuple[float, ...] = SEG_LENGTHS) -> DataFrame:
    return distance_segments(t.vgeo, list(lengths))


R.query("MD14_distance_segments", f"select run_id, length_m, segment, record_count, {', '.join(f'round({c}, 5) as {c}' for c in _MEASURES)} from {SEG} s")(
    lambda t: segments_of(t).select("run_id", "length_m", "segment", "record_count", *[F.round(c, 5).alias(c) for c in _MEASURES]))
