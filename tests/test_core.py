"""Hand-computed fixtures, properties, and the rules that plans must keep."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pacelake import binding
from pacelake.catalog import REGISTRIES
from pacelake.functions import scalars
from pacelake.operators import joins, windows
from pacelake.plans import assertions, context, rollups, routes, segments, signals, telemetry
from pacelake.sources import ingest
from pacelake.streaming import replace

D = dt.date


def test_segments_of_the_hand_computed_run(spark):
    rows = spark.createDataFrame([("r", 1, 0, 0.0), ("r", 2, 100, 600.0), ("r", 3, 160, 600.0), ("r", 4, 200, 1000.0)], "run_id string, record_index long, elapsed_seconds long, record_distance_m double")
    for c in ("heart_rate", "running_cadence", "altitude_m", "lat", "lon"):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    got = {r.segment: (r.distance_m, round(r.seconds, 3), r.record_count) for r in segments.distance_segments(rows, [250.0]).collect()}
    assert got == {1: (250.0, 41.667, 2), 2: (250.0, 41.667, 1), 3: (250.0, 91.667, 3), 4: (250.0, 25.0, 1)}


def test_segments_count_repeated_numbers_once_and_are_summed_without_a_sort(spark):
    """Two rows of number 2 share segment 2, which counts it once; the sums keep no row order beside one number."""
    found = [("r", 1, 0, 0.0, 1.0), ("r", 2, 10, 300.0, 2.0), ("r", 2, 20, 600.0, 3.0), ("r", 3, 30, 600.0, 4.0), ("r", None, 0, 0.0, 5.0)]
    rows = spark.createDataFrame(found, "run_id string, record_index long, elapsed_seconds long, record_distance_m double, altitude_m double").withColumns({c: F.lit(None).cast("double") for c in ("heart_rate", "running_cadence", "lat", "lon")})
    cells = segments.distance_segments(rows, [250.0])
    assert {r.segment: r.record_count for r in cells.collect()} == {1: 2, 2: 1, 3: 2}
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "distinct" not in plan


def test_segments_conserve_distance_and_time(spark, data):
    t = binding.Tables(spark, data)
    assert assertions.reconciliation(segments.distance_segments(t.vgeo, [250.0, 402.336, 1609.344]), t.vgeo).count() == 0


def graph(spark, edges, n):
    both = [(str(a), str(b), 1.0) for a, b in edges] + [(str(b), str(a), 1.0) for a, b in edges]
    return spark.createDataFrame([(str(i), D(2024, 1, i)) for i in range(1, n + 1)], "run_id string, activity_date date"), spark.createDataFrame(both, "run_id string, connected_run_id string, similarity double")


def test_roots_are_not_components(spark):
    obs, edges = graph(spark, [(1, 3), (2, 3)], 3)
    assert dict(map(tuple, routes.chronological_roots(obs, edges).collect())) == {"1": "1", "2": "2", "3": "1"}
    assert dict(map(tuple, routes.connected_components(obs, edges).collect())) == {"1": "1", "2": "1", "3": "1"}


def test_components_of_a_chain(spark):
    obs, edges = graph(spark, [(i, i + 1) for i in range(1, 25)], 27)
    got = dict(map(tuple, routes.connected_components(obs, edges).collect()))
    assert {got[str(i)] for i in range(1, 26)} == {"1"} and got["27"] == "27"


def test_even_sampling(spark):
    rows = spark.range(1, 1002).select(F.lit("r").alias("run_id"), F.col("id").alias("record_index"))
    got = [r.record_index for r in telemetry.downsample_even(rows, 500).orderBy("record_index").collect()]
    assert got == [i * 1000 // 499 + 1 for i in range(500)] and got[0] == 1 and got[-1] == 1001
    assert telemetry.downsample_even(rows.limit(300), 500).count() == 300


def test_change_plan(spark):
    ts = lambda d: dt.datetime(2026, 1, d)
    source = spark.createDataFrame([(1, 100, ts(1)), (2, 200, ts(1)), (3, 300, ts(1)), (4, 5, None)], "key long, size long, mtime timestamp")
    old = spark.createDataFrame([(1, 100, ts(1)), (2, 199, ts(1)), (4, 5, None)], "key long, size long, mtime timestamp")
    assert {r.key: r.action for r in ingest.change_plan(source, old, ["key"]).collect()} == {1: "skipped", 2: "changed", 3: "parse", 4: "changed"}
    assert {r.action for r in ingest.change_plan(source, old, ["key"], True).collect()} == {"changed", "parse"}


def test_keyed_replace_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "x")], "k long, v string")
    once = ingest.keyed_replace(now, new, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, ingest.keyed_replace(once, new, ["k"]).collect())) == [(1, "x"), (2, "c")]


def test_fingerprint_ignores_order(spark, data):
    orders = binding.Tables(spark, data).orders
    assert ingest.fingerprint(orders).first() == ingest.fingerprint(orders.repartition(7).orderBy("o_totalprice")).first()
    assert tuple(ingest.fingerprint(orders.where("false")).first()) == (0, None)
    assert ingest.fingerprint(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)).first() != ingest.fingerprint(orders).first()


def test_nearest_place_prefers_population_among_ties(spark):
    points = spark.createDataFrame([(1, 52.3676, 4.9041), (2, 0.0, 0.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([("Amsterdam", 52.37403, 4.88969, 741636), ("Village", 52.37403, 4.88969, 10), ("Far", 53.5, 6.0, 9)], "name string, p_lat double, p_lon double, population long")
    assert [(r.id, r.name) for r in joins.nearest_place(points, places, "id").select("id", "name").collect()] == [(1, "Amsterdam")]


def test_places_at_one_coordinate_are_looked_at_once(spark):
    points = spark.range(200).select("id", F.lit(52.0).alias("lat"), F.lit(4.9).alias("lon"))
    places = spark.createDataFrame([(f"p{k:04}", 52.1, 4.9, k // 2) for k in range(1000)] + [("q", 52.2, 4.9, 10**6)], "name string, p_lat double, p_lon double, population long").repartition(4)
    assert sorted((r.name, r.population) for r in joins.largest_places(places).collect()) == [("p0999", 499), ("q", 10**6)]
    best = joins.nearest_place(points, places, "id").collect()
    assert len(best) == 200 and {(r.name, r.population) for r in best} == {("p0999", 499)}


def test_week_context_of_a_short_history(spark):
    days = [("s", D(2026, 7, 19), 8.0), ("s", D(2026, 7, 20), 5.5)]
    runs = spark.createDataFrame(days, "subject string, activity_date date, distance double").withColumn("distance", F.col("distance").cast("decimal(18,2)")).withColumn("duration_seconds", F.lit(600).cast("long"))
    row = rollups.current_week(rollups.daily_mart(runs, "2026-07-21"), "2026-07-21").first()
    assert (row.week_start_date, row.run_count, row.distance, row.active_days, row.days_so_far) == (D(2026, 7, 20), 1, 5.5, 1, 2)


def test_first_partial_week_is_neither_active_nor_missed(spark):
    runs = spark.createDataFrame([("s", D(2026, 7, 16), 5.0), ("s", D(2026, 7, 28), 2.0)], "subject string, activity_date date, distance double").withColumn("distance", F.col("distance").cast("decimal(18,2)")).withColumn("duration_seconds", F.lit(600).cast("long"))
    weeks = rollups.weekly_mart(rollups.daily_mart(runs, "2026-08-04"), "2026-08-04").orderBy("week_start_date").collect()
    assert [(w.n_days, w.active_week, w.missed_week, w.active_week_streak) for w in weeks] == [(4, False, False, None), (7, False, True, 0), (7, True, False, 1), (2, False, False, 1)]


def test_bands_leave_gaps(spark):
    got = [r[0] for r in spark.createDataFrame([(109.0,), (109.5,), (99.0,), (170.0,), (None,)], "h double").select(scalars.heart_rate_band(F.col("h"))).collect()]
    assert got == ["100-109", "other", "other", "other", "other"]


def test_recovery_classes(spark):
    rows = [("s", i, D(2026, 6, 29), d, 47.0, n, 45.0, 50.0) for i, (d, n) in enumerate([(51.0, 9), (50.0, 9), (43.0, 9), (51.0, 3)])]
    df = spark.createDataFrame(rows, "subject string, run_id long, activity_date date, recovery_drop double, recovery_median double, recovery_count long, recovery_q1 double, recovery_q3 double")
    assert [r.recovery_class for r in signals.recovery_trend(df).orderBy("run_id").collect()] == ["better", "typical", "worse", "unavailable"]


def test_comparison_windows(spark):
    df = windows.comparison_windows(spark.createDataFrame([(D(2026, 7, 24),)], "as_of date"))
    got = {r.preset: (r.from_date, r.previous_from, r.previous_to, r.year_ago_from, r.year_ago_to) for r in df.collect()}
    assert got["year_to_date"][0] == D(2026, 1, 1) and got["year_to_date"][3:] == (D(2025, 1, 1), D(2025, 7, 24))
    assert got["last_4_weeks"][:3] == (D(2026, 6, 27), D(2026, 5, 30), D(2026, 6, 26))


def test_half_split_of_an_even_run(spark):
    rows = spark.createDataFrame([("r", i + 1, 10 * i, 100.0 * i, 150.0) for i in range(11)], "run_id string, record_index long, elapsed_seconds long, record_distance_m double, heart_rate double")
    events = spark.createDataFrame([("r", 1, 0, "start"), ("r", 2, 100, "stop_all")], "run_id string, record_index long, t long, et string")
    row = telemetry.half_split(telemetry.half_intervals(rows, telemetry.timer_windows(events), 30)).first()
    assert (row.distance_m, row.seconds, row.m1, row.m2, row.s1, row.s2, row.coverage1, row.hr2, row.max_gap) == (1000.0, 100.0, 500.0, 500.0, 50.0, 50.0, 1.0, 150.0, 0.0)


def test_interval_slices_add_up(spark):
    rows = spark.createDataFrame([("k", 0, 1000), ("k", 1000, 1500), ("j", 0, 10)], "k string, a long, b long")
    wins = spark.createDataFrame([("k", 100, 1200), ("k", 1300, 1301)], "k string, c long, d long")
    for width in (None, 7, 100, 5000):
        got = {(r.k, r.a): r.overlap for r in joins.interval_overlap(rows, wins, "k", ("a", "b"), ("c", "d"), width).collect()}
        assert got == {("k", 0): 900.0, ("k", 1000): 201.0, ("j", 0): 0.0}


def test_global_order_equals_one_window(spark, data):
    orders = binding.Tables(spark, data).orders
    got = [r.o_orderkey for r in windows.global_order(orders, ["o_orderdate", "o_orderkey"], "p").orderBy("p").collect()]
    want = [r.o_orderkey for r in orders.orderBy("o_orderdate", "o_orderkey").collect()]
    assert got == want
    flat = orders.withColumn("o_orderdate", F.lit("same"))  # a constant first key is cut by the second
    ranked = windows.global_order(flat, ["o_orderdate", "o_orderkey"], "p", cell_rows=100)
    assert [r.o_orderkey for r in ranked.orderBy("p").collect()] == sorted(want) and [r.p for r in ranked.select("p").orderBy("p").collect()] == list(range(1, len(want) + 1))
    assert windows.global_order(orders.limit(0), ["o_orderkey"], "p").count() == 0


@pytest.mark.parametrize("name", ["JN11_date_range", "JN12_interval_overlap", "JN17_nearest_place", "MD14_distance_segments", "MD23_route_similarity", "MD05_daily_mart", "MD20_fitness_signals"])
def test_plans_have_no_nested_loop(spark, data, name):
    plan = __spark_entry__.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = __spark_entry__.queries()["FLT02_between"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_every_query_is_registered_once():
    names = list(__spark_entry__.queries())
    assert len(names) == len(set(names)) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_every_core_query_runs_on_empty_tables(spark, data, tmp_path):
    for name in binding.NAMES:
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    def run(query):
        try:
            query[1](spark, str(tmp_path)).collect()
        except Exception as e:
            return query[0], str(e)[:200]

    with ThreadPoolExecutor(4) as pool:
        assert not [x for x in pool.map(run, [q for r in REGISTRIES for q in r.queries.items()]) if x]


def test_exact_mean_and_session_context(spark, data):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.4), ("b", None)], "k string, x double")
    assert dict(map(tuple, rows.groupBy("k").agg(scalars.exact_mean("x", 2).alias("m")).collect())) == {"a": 0.7 / 3, "b": None}
    t = binding.Tables(spark, data)
    sessions = context.sessions_of(t).cache()
    assert sessions.count() == t.vrun.count() == sessions.select("run_id").distinct().count()
    summary = context.route_summary(sessions)
    assert summary.agg(F.sum("run_count")).first()[0] == sessions.where("route_id is not null").count()
    assert context.attempt_features(sessions, summary).where("prior_attempts = 0 and prior_seconds is not null or lifetime_runs <= prior_attempts").count() == 0


def test_stream_keeps_the_highest_version(spark, tmp_path):
    schema = "k long, v long, version long"
    for part in ([(1, 10, 5), (2, 20, 1)], [(1, 11, 4), (2, 21, 1), (3, 30, 0)], [(3, 31, 2), (1, 12, 3)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    replace.stream_replace(source, f"{tmp_path}/out", f"{tmp_path}/state", ["k"], "version")
    assert sorted(map(tuple, replace.latest_generation(spark, f"{tmp_path}/out").collect())) == [(1, 10, 5), (2, 21, 1), (3, 31, 2)]
    assert len([x for x in (tmp_path / "out").iterdir()]) == 2


def test_entry_works_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/pacelake", tmp_path / "pacelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_whole_table_queries(spark, data):
    t, q = binding.Tables(spark, data), __spark_entry__.queries()
    run = lambda name: q[f"{name}_whole"](spark, data)
    rows = t.vrec.where("record_distance_m is not null").select("run_id", "subject", "k", "record_distance_m").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.subject, int(r.k)), []).append((r.run_id, int(r.record_distance_m // 250)))
    want = sorted((a, b, cell, x, y) for (_, cell), g in groups.items() for a, x in g for b, y in g if a < b and abs(x - y) <= 1)
    got = sorted(map(tuple, run("JN10_band").collect()))
    assert got == want and any(r[2] % 10 >= 3 for r in got)
    lines = t.lineitem.select("l_orderkey", "l_linenumber").collect()
    assert sorted(map(tuple, run("GN01_sequence").collect())) == sorted((r[0], r[1], i) for r in lines for i in range(1, r[1] + 1))
    price = dict(map(tuple, t.orders.select("o_orderkey", "o_totalprice").collect()))
    assert sorted(map(tuple, run("JN19_using").collect())) == sorted((k, n, price[k]) for k, n in lines if k in price)
    assert sorted(map(tuple, run("GN03_posexplode").collect())) == sorted((v, i, float(x)) for v, e in t.embeddings.select("vec_id", "embedding").collect() for i, x in enumerate(e or []))
    last = lambda name: [r[1] is None for r in run(name).collect()]
    for name, size in (("SO02_nulls_last", t.vrec.count()), ("SO07_directed", t.vrun.count())):
        nulls = last(name)
        assert len(nulls) == size and nulls == sorted(nulls)
    assert any(last("SO02_nulls_last"))


def test_halves_are_summed_in_one_pass(spark):
    """The longest stretch without heart rate comes from running sums, not from a second pass over the intervals that is joined."""
    found = [("r", 1, 5.0, True), ("r", 2, 3.0, False), ("r", 3, 4.0, False), ("r", 4, 0.0, False), ("r", 5, 2.0, True), ("r", 6, 6.0, False), ("s", 1, 9.0, False), ("t", 1, 1.0, True)]
    rows = spark.createDataFrame(found, "run_id string, record_index long, sec double, has_hr boolean").withColumns({c: F.lit(1.0) for c in ("m", "m1", "m2", "s1", "s2", "hr")})
    halves = telemetry.half_split(rows)
    assert {r.run_id: r.max_gap for r in halves.collect()} == {"r": 7.0, "s": 9.0, "t": 0.0}
    assert "Join" not in halves._jdf.queryExecution().executedPlan().toString()
