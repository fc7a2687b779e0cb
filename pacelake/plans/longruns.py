"""Telemetry of long runs at full thresholds: 500 sampled points, and gates of 20 minutes, 5 km and eight segments."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import Registry
from . import signals, telemetry

R = Registry()
C = F.col


def of(t) -> SimpleNamespace:
    """The long runs of `t` under the names that telemetry plans read."""
    return SimpleNamespace(spark=t.spark, vrec=t.lrec, vgeo=t.lrec, vevt=t.levt, vrun=t.lrun)


def _long(sql: str) -> str:
    for name, other in (("vrec", "lrec"), ("vgeo", "lrec"), ("vevt", "levt"), ("vrun", "lrun")):
        sql = sql.replace(f"{{{name}}}", f"{{{other}}}")
    return sql


def sampled(t) -> DataFrame:
    return telemetry.downsample_even(t.lrec).select("run_id", "record_index")


R.query("MD13_downsample_long", "select run_id, record_index from (select run_id, record_index, count(*) over (partition by run_id) as n from {lrec} r) x where n <= 500 or exists (select 1 from range(500) p(i) where record_index = cast(floor(p.i * (n - 1) / 499.0) as bigint) + 1)")(sampled)
_COLS = ("decoupling", "seconds", "distance_m", "coverage", "max_gap", "speed1", "speed2", "hr1", "hr2")
R.query("MD17_gates_long", _long(f"select run_id, status, reason, failed_gates, n_segments, {', '.join(f'round({c}, 5) as {c}' for c in _COLS)} from {signals.dec_sql(signals.Gates())} d"))(
    lambda t: signals.decoupling_of(of(t), signals.Gates()).select("run_id", "status", "reason", "failed_gates", "n_segments", *[F.round(c, 5).alias(c) for c in _COLS]))
