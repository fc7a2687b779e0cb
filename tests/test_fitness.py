"""The fitness mart and the run list over whole sessions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pacelake.binding import Tables
from pacelake.plans import context, fitness, reads, routes

#: The run list's sort keys.
KEYS = ("date", "distance_km", "pace", "heart_rate", "ascent", "prior_7d", "prior_28d", "route_id", "coverage", "distance_economy", "elevation_economy", "decoupling", "efficiency")


@pytest.fixture(scope="module")
def sessions(spark, data):
    rows = context.whole_sessions_of(Tables(spark, data)).cache()
    rows.count()
    yield rows
    rows.unpersist()


@pytest.mark.parametrize("key", KEYS)
def test_every_sort_key_runs(sessions, key):
    column = reads.SORT_KEYS[key]
    for descending in (True, False):
        page = reads.run_page(sessions, key, descending, 30, 0).collect()
        values = [r[column] for r in page]
        known = [v for v in values if v is not None]
        assert len(page) == 30 and known == sorted(known, reverse=descending) and values[: len(known)] == known
        assert page[0].total_count == sessions.count()


def test_sessions_hold_the_extent_of_their_records(spark, sessions, data):
    t = Tables(spark, data)
    assert sessions.count() == t.vrun.count() == sessions.select("run_id").distinct().count()
    row = sessions.where("gps_record_count > 3").first()
    records = sorted(t.vgeo.where(F.col("run_id") == row.run_id).collect(), key=lambda r: r.record_index)
    placed = [r for r in records if r.lat is not None]
    assert (row.start_lat, row.end_lat, row.gps_record_count) == (placed[0].lat, placed[-1].lat, len(placed))
    assert (row.first_record, row.last_record) == (records[0].record_timestamp, records[-1].record_timestamp)
    span = max(r.record_distance_m for r in records) - min(r.record_distance_m for r in records)
    assert abs(row.record_distance_km - span / 1000) < 1e-9 and abs(row.distance_coverage - row.record_distance_km / row.distance_km) < 1e-9


def test_decoupling_baseline_needs_four_values(spark):
    days = [date(2024, 1, 1 + 3 * k) for k in range(7)] + [date(2024, 6, 1)]
    runs = spark.createDataFrame([("s", f"r{k}", d, 10.0, 3000, 140.0, 150.0, 30.0, 2.0) for k, d in enumerate(days)], "subject string, run_id string, activity_date date, distance double, duration_seconds long, avg_heart_rate double, ending_heart_rate double, recovery_drop double, distance_km double")
    halves = spark.createDataFrame([(f"r{k}", None if k == 2 else k / 100, "eligible", None, "", *[1.0] * 10) for k in range(8)], "run_id string, decoupling double, status string, reason string, failed_gates string, " + ", ".join(f"{c} double" for c in fitness.HALVES))
    economy = spark.createDataFrame([(f"r{k}", 1.0 + k, None if k % 2 else 0.5 + k) for k in range(8)], "run_id string, m_per_beat double, climb_per_beat double")
    traces = spark.createDataFrame([("r1", 40, 2000)], "run_id string, valid_samples long, seconds long")
    got = {r.run_id: r for r in fitness.fitness_mart(runs, halves, economy, traces).collect()}
    assert [got[f"r{k}"].decoupling_count for k in range(8)] == [0, 1, 2, 2, 3, 4, 5, 0]
    assert [got[f"r{k}"].decoupling_median for k in range(5)] == [None] * 5 and got["r5"].decoupling_median == 1.0 and (got["r6"].decoupling_q1, got["r6"].decoupling_q3) == (1.0, 4.0)
    assert [got[f"r{k}"].previous_decoupling for k in range(4)] == [None, 0.0, 1.0, 1.0] and got["r3"].previous_climb_per_beat == 2.5
    assert (got["r1"].drift_samples, got["r0"].drift_samples) == (40, None) and got["r4"].score == 200.0


def test_members_of_areas_are_rows(spark):
    points = spark.createDataFrame([(k, None if k == 3 else "x", float(k), 1.0) for k in range(5)], "route_id int, city string, lat double, lon double")
    got = routes.geo_areas(points, ["city"], "lat", "lon", ident="route_id").collect()
    assert sorted((r.city, r.route_id) for r in got) == [("unknown", 3), ("x", 0), ("x", 1), ("x", 2), ("x", 4)]
    assert {r.city: (r.low_lat, r.high_lat) for r in got}["x"] == (-0.64, 4.64)
