"""Column functions: distance, cells, units, bands, deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_KM = 6371.0
MILES_PER_KM = 0.621371192237334
DEGREES_PER_SEMICIRCLE = 180.0 / 2**31


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon) * F.sin(d_lon)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def grid_cell(lat: Column, lon: Column, step: float) -> Column:
    """Number of the grid cell of a coordinate; null where either is missing."""
    return F.floor(lat / step).cast("long") * 100000 + F.floor(lon / step).cast("long")


#: Shifts and masks that lay 32 bits on every other bit of 64.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def z_cell(lat: Column, lon: Column, step: float) -> Column:
    """Hierarchical code of the grid cell of a coordinate: the bits of its row and column, interleaved. The cell of twice the step that
    holds it is `z_parent` of it, so cells near each other share leading bits. Null where a coordinate is missing."""

    def spread(x: Column) -> Column:
        for shift, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    row, column = (F.floor((x + edge) / step).cast("long") for x, edge in ((lat, 90), (lon, 180)))
    return F.shiftleft(spread(row), 1).bitwiseOR(spread(column))


def z_parent(cell: Column, levels: int = 1) -> Column:
    """The cell that holds `cell`, `levels` levels up."""
    return F.shiftright(cell, 2 * levels)


def z_cell_sql(lat: str, lon: str, step: float) -> str:
    """`z_cell` as SQL text for comparison."""

    row, column = (f"cast(floor(({x} + {edge}) / {step}) as bigint)" for x, edge in ((lat, 90), (lon, 180)))
    pick = lambda n: f"list_reduce([{n}, 16, 8, 4, 2, 1], lambda a, s: (a | (a << s)) & case s when 16 then {_SPREAD[0][1]} when 8 then {_SPREAD[1][1]} when 4 then {_SPREAD[2][1]} when 2 then {_SPREAD[3][1]} else {_SPREAD[4][1]} end)"
    return f"(({pick(row)} << 1) | {pick(column)})"


def wkt_point(lat: Column, lon: Column) -> Column:
    """Well-known text of a valid coordinate, else null."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def degrees(semicircles: Column) -> Column:
    """Degrees of an angle in semicircles; what isn't a number is null."""
    return semicircles.try_cast("double") * DEGREES_PER_SEMICIRCLE


def ratio(over: Column, under: Column) -> Column:
    """A quotient that is null where the divisor is 0."""
    return over / F.nullif(under, F.lit(0).cast("double"))


def pace_min_per_km(seconds: Column, km: Column) -> Column:
    return F.when((km > 0) & (seconds > 0), seconds / 60.0 / km)


def heart_rate_band(rate: Column) -> Column:
    """Bands of ten from 100 to 169 with whole-number ends; what lies between two bands, or outside, is 'other'."""
    out = None
    for low in range(100, 170, 10):
        hit = rate.between(low, low + 9)
        out = F.when(hit, f"{low}-{low + 9}") if out is None else out.when(hit, f"{low}-{low + 9}")
    return out.otherwise("other")


def levels(value: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound that the value is below, else the last name; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in zip(bounds, names, strict=False):
        out = out.when(value < bound, name)
    return out.otherwise(names[-1])


def trend(now: Column, before: Column) -> Column:
    """Struct of direction, difference, and change relative to a baseline that is neither null nor 0."""
    diff = now - before
    return F.struct(F.when(diff > 0, "up").when(diff < 0, "down").when(diff == 0, "flat").alias("direction"), diff.alias("diff"), F.when(before != 0, diff / before).alias("relative"))


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", day).cast("date")


def sunday_week_start(day: Column) -> Column:
    """Sunday of the week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def local_today(now: Column, zone: str) -> Column:
    """Calendar date of an instant (UTC) in a zone."""
    return F.from_utc_timestamp(now, zone).cast("date")


def instant(text: Column) -> Column:
    """Timestamp of ISO text, or of an epoch in seconds or milliseconds; else null."""
    number = text.try_cast("double")
    epoch = F.timestamp_millis(F.when(number > 1e11, number).otherwise(number * 1000).cast("long"))
    return F.when(text.rlike(r"^[0-9]+$"), epoch).otherwise(text.try_cast("timestamp"))


def exact_mean(column: str, digits: int, window=None):
    """Mean of numbers of `digits` decimals, null without any: summed as decimals and divided once, so it doesn't depend on the order of rows."""
    total, n = F.sum(F.col(column).cast(f"decimal(38,{digits})")), F.count(column)
    if window is not None:
        total, n = total.over(window), n.over(window)
    return total.cast("double") / F.nullif(n, F.lit(0))
