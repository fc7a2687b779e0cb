"""Order statistics and running values of groups that may be as large as the table.

A window function sorts a group in one task, and a percentile buffers its values. Here rows are cut into ranges of
(group, order) at sampled places, so a large group lies in many ranges; each range works by itself, and one row for
each range and group carries counts, sums or last values from earlier ranges to later ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

C = F.col
#: Rows of one range, on average.
RANGE_ROWS = 200_000


def _ranged(df: DataFrame, order: Sequence[str | Column], range_rows: int) -> DataFrame:
    """`df` in ranges of `order`, with the number of each row's range; written once, as another sample would cut elsewhere."""
    rows = cut(df)
    parts = max(1, -(-rows.count() // range_rows))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def _same(a: Sequence[str], b: Sequence[str]) -> list[Column]:
    return [C(x).eqNullSafe(C(y)) for x, y in zip(a, b, strict=True)]


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float], discrete: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, n, one column for each of `qs`): exact quantiles of the known values of each group, by distributed selection.

    Equal values are counted first. Counts of ranges tell which range holds a wanted place, and only such ranges are
    ordered. Continuous quantiles are interpolated between the two values next to the place; discrete ones are the first value
    with at least that share of values up to it. Groups without a known value, and an empty table, give no row; null
    keys form a group. Values are compared as they are; NaN is the largest.
    """
    by = list(by)
    counted = df.where(C(value).isNotNull()).groupBy(*by, C(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = _ranged(counted, [*by, "_v"], range_rows)
    each = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))  # one row a range and group
    along = Window.partitionBy(*by).orderBy("_range")
    each = each.withColumn("_before", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - C("_n")).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    wanted = []
    for name, q in qs.items():
        at = (C("_total") - 1) * F.lit(float(q))
        low = F.greatest(F.ceil(C("_total") * F.lit(float(q))), F.lit(1)) if discrete else F.floor(at) + 1
        places = [("low", low)] if discrete else [("low", low), ("high", F.ceil(at) + 1)]
        wanted += [F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), place.cast("long").alias("place"), (at - F.floor(at)).alias("part")) for side, place in places]
    asked = each.select(*by, "_range", "_before", "_n", "_total", F.explode(F.array(*wanted)).alias("w")).where((C("w.place") > C("_before")) & (C("w.place") <= C("_before") + C("_n")))
    names = [f"_k{i}" for i in range(len(by))]
    asked = asked.select(*[C(b).alias(n) for b, n in zip(by, names, strict=True)], C("_range").alias("_r"), "_total", "w.q", "w.side", "w.part", (C("w.place") - C("_before")).alias("_at"))
    held = asked.select(*names, "_r").distinct()
    on = [*_same(by, names), C("_range") == C("_r")]
    near = ranged.join(held, on, "left_semi")
    upto = F.sum("_c").over(Window.partitionBy("_range", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_upto", upto).join(asked, [*on, C("_at") > C("_upto") - C("_c"), C("_at") <= C("_upto")])
    pick = lambda q, side: F.max(F.when((C("q") == q) & (C("side") == side), C("_v")))
    out = []
    for name in qs:
        low = pick(name, "low")
        if not discrete:
            part = F.max(F.when(C("q") == name, C("part")))
            low, high = low.cast("double"), pick(name, "high").cast("double")
            low = F.when(low == high, low).otherwise(low + (high - low) * part)
        out.append(low.alias(name))
    return found.groupBy(*by).agg(F.max("_total").alias("n"), *out)


def window_ranks(rank: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rank at a weighted place (from 1) among rows low to high - 1, for many such windows, by prefix counts over ranked values.

    A level for each bit of the ranks, highest first: weights of rows whose bit is 0 are summed along the rows, so a window
    knows its zeros from two of the sums; it goes on among these or among the others, each kept in order.
    """
    out, low, high, place = np.zeros(len(low), np.int64), low.copy(), high.copy(), place.copy()
    for bit in range(max(1, int(rank.max(initial=0)).bit_length()) - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        zeros = np.append(0, np.cumsum(zero))
        sums = np.append(0, np.cumsum(np.where(zero, weight, 0)))
        inside = sums[high] - sums[low]
        left = place <= inside
        out += np.where(left, 0, 1 << bit)
        place = np.where(left, place, place - inside)
        low = np.where(left, zeros[low], zeros[-1] + low - zeros[low])
        high = np.where(left, zeros[high], zeros[-1] + high - zeros[high])
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, weight = rank[order], weight[order]
    return out


def sliding_quantiles(df: DataFrame, by: Sequence[str], day: str, value: str, qs: dict[str, float], days: int = 90, bucket_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, day, n, one column for each of `qs`): discrete quantiles of a group's known values over the `days` days before each of its days.

    `day` is a whole number and `value` numeric; `n` counts the values of a window, and quantiles of an empty one are null.
    A history is cut into slices of `days` days, of which each window meets two, so a long history is spread over tasks;
    within a task the work grows with its rows times the logarithm of their number of values. Every (group, day) of `df`
    is answered, days without a known value too; rows with a null day are not. Null keys form a group.
    """
    by = list(by)
    rows = df.where(C(day).isNotNull()).groupBy(*by, C(day).cast("long").alias("_day"), C(value).cast("double").alias("_v")).agg(F.count("*").alias("_w"))
    rows = cut(rows)
    buckets = max(1, -(-2 * rows.count() // bucket_rows))
    own = F.floor(C("_day") / days).cast("long")
    sliced = rows.withColumn("_slice", F.explode(F.array(own, own + 1))).withColumn("_own", own == C("_slice"))
    sliced = sliced.withColumn("_bucket", F.pmod(F.xxhash64(*by, "_slice"), F.lit(buckets)))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{b}` {kinds[b]}" for b in by), f"`{day}` long", "n long", *(f"`{n}` double" for n in qs)])

    def run(table: pa.Table) -> pa.Table:
        codes = [np.asarray(table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1)) for c in (*by, "_slice")]
        d, v, w, mine = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_day", "_v", "_w", "_own"))
        order = np.lexsort((d, *codes))
        d, v, w, mine, codes = d[order], v[order], np.where(np.isnan(v[order]), 0, w[order]), mine[order].astype(bool), [c[order] for c in codes]
        first = np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0)) if len(d) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        start = np.flatnonzero(first)
        # Rows of a group are in order of days; a place on one line for all groups lets one search answer every window.
        span = int(d.max() - d.min()) + 2 * days + 2
        line = group * span + (d - d.min()) + days + 1
        asked = np.flatnonzero(mine & np.append(True, line[1:] != line[:-1]))
        low, high = np.maximum(np.searchsorted(line, line[asked] - days, "left"), start[group[asked]]), np.searchsorted(line, line[asked], "left")
        values, rank = np.unique(v, return_inverse=True)
        sums = np.append(0, np.cumsum(w))
        n = sums[high] - sums[low]
        out = [table.column(b).take(pa.array(order[asked])) for b in by] + [pa.array(d[asked]), pa.array(n)]
        some = np.flatnonzero(n > 0)
        for q in qs.values():
            got = np.full(len(asked), np.nan)
            got[some] = values[window_ranks(rank, w, low[some], high[some], np.maximum(1, np.ceil(n[some] * q)).astype(np.int64))]
            out.append(pa.array(got, mask=n == 0))
        return pa.table(out, [*by, day, "n", *qs])

    return sliced.groupBy("_bucket").applyInArrow(run, schema)


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, str, bool]], range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with running values of each group in order: name -> (kind, column, whether the row itself counts).

    Kinds are `sum`, `max`, `min`, `count` (of known values) and `last` (the last known value). `order` must be total within a
    group. Each range of (by, order) runs its own windows; what a range and group sum up to is carried to the later
    ranges of the group, so no task holds more than a range. Nothing known yet is null, a count 0; null keys form a group.
    """
    by, order = list(by), list(order)
    ranged = _ranged(df, [*by, *order], range_rows)
    along = Window.partitionBy("_range", *by).orderBy(*order)
    whole = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.max_by(c, F.when(C(c).isNotNull(), F.struct(*order)))}
    over = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, True)}
    names = [f"_k{i}" for i in range(len(by))]
    totals = ranged.groupBy(*by, "_range").agg(*[whole[kind](column).alias(f"_t_{name}") for name, (kind, column, _) in values.items()])  # one row a range and group
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[C(b).alias(n) for b, n in zip(by, names, strict=True)], C("_range").alias("_r"), *[over["sum" if kind == "count" else kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _, _) in values.items()])
    rows = ranged.withColumns({f"_o_{name}": over[kind](column).over(along.rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)) for name, (kind, column, with_own) in values.items()})
    met = rows.join(carried, [*_same(by, names), C("_range") == C("_r")])
    join = {
        "sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b),
        "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "last": lambda a, b: F.coalesce(b, a),
    }
    return met.select(*df.columns, *[join[kind](C(f"_c_{name}"), C(f"_o_{name}")).alias(name) for name, (kind, _, _) in values.items()])


def nearest_value_ranged(rows: DataFrame, asked: DataFrame, key: str, position: str, value: str, tolerance: float, range_rows: int = RANGE_ROWS) -> DataFrame:
    """As `joins.nearest_value`, for keys with any number of rows: last value before and first value after by running values over ranges."""
    line = rows.select(key, C(position).alias("_p"), F.struct(C(position).alias("p"), C(value).alias("v")).alias("_v"), F.lit(0).alias("_ask"), F.monotonically_increasing_id().alias("_n"))
    line = line.unionByName(asked.select(key, C(position).alias("_p"), F.lit(1).alias("_ask"), F.monotonically_increasing_id().alias("_n")), allowMissingColumns=True)
    line = cut(line.withColumn("_m", -C("_p")))
    before = running(line, [key], ["_p", "_ask", "_n"], {"_b": ("last", "_v", True)}, range_rows)
    both = running(before, [key], ["_m", "_ask", "_n"], {"_a": ("last", "_v", True)}, range_rows).where("_ask = 1")
    d_b, d_a = C("_p") - C("_b.p"), C("_a.p") - C("_p")
    pick = F.when(d_b.isNotNull() & (d_a.isNull() | (d_b <= d_a)), C("_b")).otherwise(C("_a"))
    return both.select(key, C("_p").alias(position), F.when(F.least(d_b, d_a) <= tolerance, pick["v"]).alias(value))
