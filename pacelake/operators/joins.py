"""Joins that a plain equality can't express, rewritten so that none becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km


def trailing_sum(days: DataFrame, key: str, day: str, value: str, first: int, last: int) -> Column:
    """Sum of `value` over days [day - first, day - last] of the same key, by a range window over day numbers."""
    number = F.unix_date(F.col(day).cast("date")).cast("long")
    return F.sum(value).over(Window.partitionBy(key).orderBy(number).rangeBetween(-first, -last))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], position: str, tolerance: int, prefix: str = "r_") -> DataFrame:
    """Rows of equal keys whose positions differ by `tolerance` at most: right rows are repeated at each position they may meet."""
    shifts = F.explode(F.sequence(F.col(position) - tolerance, F.col(position) + tolerance))
    other = right.select(*[F.col(c).alias(prefix + c) for c in right.columns], shifts.alias("_at"))
    on = [F.col(k) == F.col(prefix + k) for k in keys] + [F.col(position) == F.col("_at")]
    return left.join(other, on).drop("_at")


def interval_overlap(left: DataFrame, right: DataFrame, key: str, bounds: tuple[str, str], windows: tuple[str, str], width: int | None = None) -> DataFrame:
    """`left` rows, repeated ones too, with `overlap`: how much of (start, end] windows of the same key cover.

    With `width`, both sides are cut into slices of that many units, so that a key with long histories joins
    within slices; overlaps of slices add up.
    """
    (a, b), (c, d) = bounds, windows
    windows_of = right.select(F.col(key).alias("_key"), F.col(c).alias("_c"), F.col(d).alias("_d"))
    numbered = left.withColumn("_row", F.monotonically_increasing_id())
    rows, on = numbered, (F.col(key) == F.col("_key")) & (F.col(a) < F.col("_d")) & (F.col(b) > F.col("_c"))
    low, high = F.greatest(F.col(a), F.col("_c")), F.least(F.col(b), F.col("_d"))
    if width:
        slices = lambda x, y: F.explode_outer(F.sequence(F.floor(x / width), F.floor(y / width)))
        rows = numbered.withColumn("_slice", slices(F.col(a), F.col(b)))
        windows_of = windows_of.withColumn("_slice2", slices(F.col("_c"), F.col("_d")))
        on = on & (F.col("_slice") == F.col("_slice2"))
        low, high = F.greatest(low, F.col("_slice") * width), F.least(high, (F.col("_slice") + 1) * width)
    shared = F.when(F.col("_c").isNotNull(), F.greatest(high - low, F.lit(0)))
    return rows.join(windows_of, on, "left").groupBy("_row", *left.columns).agg(F.coalesce(F.sum(shared), F.lit(0)).cast("double").alias("overlap")).drop("_row")


def largest_places(places: DataFrame) -> DataFrame:
    """Of the places at each coordinate the one with the largest population, then name."""
    won = F.max_by(F.struct("name", "population"), F.struct("population", "name")).alias("_w")
    return places.groupBy("p_lat", "p_lon").agg(won).select("p_lat", "p_lon", "_w.*")


def nearest_place(points: DataFrame, places: DataFrame, point_id: str, lat: float | str = "lat", lon: str = "lon", d_lat: float = 0.5, d_lon: float = 0.7, tie_km: float = 0.001) -> DataFrame:
    """For each point the nearest of `places` (name, p_lat, p_lon, population) in a box, ties within a metre to the larger population.

    Points look into the 3 x 3 grid cells around their own, so the join is on equal cells. Of places at one coordinate, which are as near
    as each other to every point, only the one that wins the tie is looked at.
    """
    cell = lambda la, lo: (F.floor(F.col(la) / d_lat), F.floor(F.col(lo) / d_lon))
    pa, po = cell(lat, lon)
    around = F.array(*[F.struct((pa + i).alias("ca"), (po + j).alias("co")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asked = points.select(point_id, F.col(lat).alias("_la"), F.col(lon).alias("_lo"), F.explode(around).alias("_c"))
    qa, qo = cell("p_lat", "p_lon")
    known = largest_places(places).withColumn("_ca", qa).withColumn("_co", qo)
    met = asked.join(known, (F.col("_c.ca") == F.col("_ca")) & (F.col("_c.co") == F.col("_co")))
    met = met.where((F.abs(F.col("_la") - F.col("p_lat")) <= d_lat) & (F.abs(F.col("_lo") - F.col("p_lon")) <= d_lon))
    met = met.withColumn("distance_km", haversine_km(F.col("_la"), F.col("_lo"), F.col("p_lat"), F.col("p_lon")))
    near = met.withColumn("_least", F.min("distance_km").over(Window.partitionBy(point_id))).where(F.col("distance_km") <= F.col("_least") + tie_km)
    best = near.groupBy(point_id).agg(F.max_by(F.struct("name", "distance_km", "population"), F.struct("population", -F.col("distance_km"), "name")).alias("b"))
    return best.select(point_id, "b.name", "b.distance_km", "b.population")


def nearest_value(rows: DataFrame, asked: DataFrame, key: str, position: str, value: str, tolerance: float) -> DataFrame:
    """For each (key, position) asked, the value at the nearest position within the tolerance, the earlier of two as near.

    Both sides are laid on one line per key; the last value before and the first after come from one window each.
    """
    line = rows.select(key, F.col(position).alias("_p"), F.struct(F.col(position).alias("p"), F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_ask"))
    line = line.unionByName(asked.select(key, F.col(position).alias("_p"), F.lit(1).alias("_ask")), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_p", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("_p", F.col("_ask").desc()).rowsBetween(0, Window.unboundedFollowing)
    found = line.withColumn("_b", F.last("_v", True).over(before)).withColumn("_a", F.first("_v", True).over(after)).where("_ask = 1")
    d_b, d_a = F.col("_p") - F.col("_b.p"), F.col("_a.p") - F.col("_p")
    pick = F.when(d_b.isNotNull() & (d_a.isNull() | (d_b <= d_a)), F.col("_b")).otherwise(F.col("_a"))
    gap = F.least(d_b, d_a)
    return found.select(key, F.col("_p").alias(position), F.when(gap <= tolerance, pick["v"]).alias(value))
