"""Distributed quantiles, sliding quantiles, running values, leaf paths and route candidates against plain versions."""

import json
import math
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake import binding
from pacelake.functions import scalars
from pacelake.operators import distributed as D
from pacelake.operators.joins import nearest_value
from pacelake.operators.relational import leaf_paths
from pacelake.plans import routes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    found = [(int(g), None if v is None else float(v), int(k)) for k, (g, v) in enumerate(zip(r.choice([1, 1, 1, 1, 1, 1, 2, 3], 6000), r.integers(0, 900, 6000)))]
    found += [(None, float(k % 7), 6000 + k) for k in range(40)] + [(9, None, 7000), (8, 5.5, 7001), (7, 1.0, 7002), (7, 2.0, 7003)]
    return found, spark.createDataFrame(found, "g int, v double, k long").repartition(5)


@pytest.mark.parametrize("range_rows", [50, 200_000])
def test_quantiles_equal_sorting(rows, range_rows):
    found, df = rows
    qs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p99": 0.99, "high": 1.0}
    groups = defaultdict(list)
    for g, v, _ in found:
        if v is not None:
            groups[g].append(v)
    exact = D.quantiles(df, ["g"], "v", qs, range_rows=range_rows)
    assert {r.g: [r.n, *(round(r[q], 9) for q in qs)] for r in exact.collect()} == {g: [len(v), *(round(float(np.quantile(v, q)), 9) for q in qs.values())] for g, v in groups.items()}
    disc = D.quantiles(df, ["g"], "v", qs, discrete=True, range_rows=range_rows).collect()
    assert {r.g: [r[q] for q in qs] for r in disc} == {g: [sorted(v)[max(1, math.ceil(len(v) * q)) - 1] for q in qs.values()] for g, v in groups.items()}
    assert "percentile" not in plan_of(exact) and "collect_list" not in plan_of(exact)
    whole = D.quantiles(df, [], "v", {"mid": 0.5}, range_rows=range_rows).collect()
    assert [r.mid for r in whole] == [float(np.median([v for _, v, _ in found if v is not None]))]


def test_quantiles_of_nothing(spark):
    assert D.quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", {"q": 0.5}).count() == 0


def test_one_group_lies_in_many_ranges(spark):
    ranged = D._ranged(spark.range(20_000).select(F.lit(1).alias("g"), "id"), ["g", "id"], 1000)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000


@pytest.mark.parametrize("bucket_rows", [300, 200_000])
def test_sliding_quantiles_equal_windows(spark, bucket_rows):
    r = np.random.default_rng(3)
    found = [(int(g), "ab"[int(g) % 2] if g < 3 else None, int(d), None if v < 3 else float(v)) for g, d, v in zip(r.integers(0, 4, 2500), r.integers(-400, 900, 2500), r.integers(0, 60, 2500))]
    df = spark.createDataFrame([*found, (1, "b", None, 5.0)], "g int, band string, day int, v double").repartition(4)
    qs = {"q1": 0.25, "mid": 0.5, "q3": 0.75}
    got = {(x.g, x.band, x.day): (x.n, x.q1, x.mid, x.q3) for x in D.sliding_quantiles(df, ["g", "band"], "day", "v", qs, 90, bucket_rows).collect()}
    by = defaultdict(list)
    for g, band, d, v in found:
        by[(g, band)].append((d, v))
    want = {}
    for key, x in by.items():
        for d in {d for d, _ in x}:
            inside = sorted(v for e, v in x if v is not None and d - 90 <= e <= d - 1)
            want[(*key, d)] = (len(inside), *(inside[math.ceil(len(inside) * q) - 1] if inside else None for q in qs.values()))
    assert got == want
    assert D.sliding_quantiles(spark.createDataFrame([], "g int, day int, v double"), ["g"], "day", "v", qs).count() == 0


def test_window_ranks_are_order_statistics():
    r = np.random.default_rng(1)
    rank, weight = r.integers(0, 37, 500), r.integers(0, 4, 500)
    low = r.integers(0, 400, 200)
    high = low + r.integers(1, 100, 200)
    sums = np.append(0, np.cumsum(weight))
    fine = sums[high] > sums[low]
    low, high = low[fine], high[fine]
    place = r.integers(1, sums[high] - sums[low] + 1)
    got = D.window_ranks(rank, weight, low, high, place)
    assert got.tolist() == [sorted(np.repeat(rank[a:b], weight[a:b]))[p - 1] for a, b, p in zip(low, high, place)]


@pytest.mark.parametrize("range_rows", [100, 200_000])
def test_running_equals_windows(spark, range_rows):
    r = np.random.default_rng(2)
    found = [(None if k % 50 == 0 else "hot" if k % 5 else f"s{k % 7}", int(k), None if x < 20 else int(x), None if x < 85 else float(x)) for k, x in enumerate(r.integers(0, 100, 4000))]
    df = spark.createDataFrame(found, "g string, k long, a int, b double").repartition(6)
    asked = {"total": ("sum", "a", True), "top": ("max", "a", True), "least": ("min", "b", False), "n": ("count", "a", False), "known": ("last", "b", False), "upto": ("last", "b", True)}
    got = {x.k: tuple(x[c] for c in asked) for x in D.running(df, ["g"], ["k"], asked, range_rows).collect()}
    state, want = defaultdict(list), {}
    for g, k, a, b in found:
        seen, now = state[g], [*state[g], (a, b)]
        of = lambda x, i: [y[i] for y in x if y[i] is not None]
        want[k] = (sum(of(now, 0)) if of(now, 0) else None, max(of(now, 0), default=None), min(of(seen, 1), default=None), len(of(seen, 0)), (of(seen, 1) or [None])[-1], (of(now, 1) or [None])[-1])
        state[g] = now
    assert got == want


def test_nearest_value_over_ranges(spark):
    r = np.random.default_rng(5)
    held = spark.createDataFrame([(int(g), float(p), float(k)) for k, (g, p) in enumerate({(int(a), int(b)) for a, b in zip(r.integers(0, 2, 900), r.integers(0, 4000, 900))})], "g int, p double, v double")
    asked = spark.createDataFrame([(int(g), float(p) + 0.5) for g, p in zip(r.integers(0, 3, 600), r.integers(-50, 4100, 600))], "g int, p double")
    want = sorted(map(repr, nearest_value(held, asked, "g", "p", "v", 3.0).collect()))
    assert sorted(map(repr, D.nearest_value_ranged(held, asked, "g", "p", "v", 3.0, 100).collect())) == want


def plain_leaves(x, path="$"):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from plain_leaves(v, f"{path}.{k}")
    elif isinstance(x, list) and x:
        for v in x:
            yield from plain_leaves(v, f"{path}[]")
    else:
        yield path


def test_leaf_paths_walk_all_levels(spark):
    docs = ['{"a":{"b":{"c":{"d":[1,[2,{"e":null}]]}}}}', '{"a":{"b":7},"z":{}}', "[]", "3", '{"l":[],"m":[{},{"n":[[]]}]}', "null", '{"a":{"b":7}}']
    found = [(("x", "y")[k % 2], k, d) for k, d in enumerate(docs)] + [("x", 90, None), ("y", 91, "not json {")]
    got = {(r.kind, r.path): r.n for r in leaf_paths(spark.createDataFrame(found, "kind string, id int, doc string"), "kind", "id", "doc").collect()}
    want = defaultdict(set)
    for kind, k, d in found[: len(docs)]:
        for p in plain_leaves(json.loads(d)):
            want[(kind, p)].add(k)
    assert got == {k: len(v) for k, v in want.items()}
    assert leaf_paths(spark.createDataFrame([], "kind string, id int, doc string"), "kind", "id", "doc").count() == 0


def test_z_cells_nest(spark):
    r = np.random.default_rng(4)
    points = [(float(a), float(b)) for a, b in zip(r.uniform(-90, 90, 300), r.uniform(-180, 180, 300))] + [(None, 1.0), (1.0, None)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = df.select("lat", "lon", scalars.z_cell(F.col("lat"), F.col("lon"), 0.002).alias("fine"), scalars.z_parent(scalars.z_cell(F.col("lat"), F.col("lon"), 0.002)).alias("up")).collect()
    for x in got:
        if x.lat is None or x.lon is None:
            assert x.fine is None and x.up is None
            continue
        row, column = math.floor((x.lat + 90) / 0.002), math.floor((x.lon + 180) / 0.002)
        code = sum(((row >> i & 1) << 2 * i + 1) | ((column >> i & 1) << 2 * i) for i in range(32))
        coarse = sum(((row // 2 >> i & 1) << 2 * i + 1) | ((column // 2 >> i & 1) << 2 * i) for i in range(32))
        assert (x.fine, x.up) == (code, coarse)


def plain_edges(paths, least):
    out = {}
    for l_id, l in paths.items():
        for r_id, r in paths.items():
            if l_id < r_id:
                a = sum(any((p + s, c) in r for s in (-1, 0, 1)) for p, c in l)
                b = sum(any((p + s, c) in l for s in (-1, 0, 1)) for p, c in r)
                if a and min(a / len(l), b / len(r)) >= least:
                    out[(l_id, r_id)] = round(min(a / len(l), b / len(r)), 9)
    return out


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_candidates_lose_no_edge(spark, least):
    r = np.random.default_rng(int(least * 100))
    base = [[int(x) for x in r.integers(0, 12, 14)] for _ in range(4)]
    paths = {}
    for k in range(90):
        p = [c if r.random() > 0.12 else int(r.integers(0, 12)) for c in base[k % 4]][: int(r.integers(8, 15))]
        shift = int(r.integers(0, 2))
        paths[f"r{k:03}"] = {(i + shift, c) for i, c in enumerate(p)}
    obs = spark.createDataFrame([(k, 5.0, 1, 2, 3, len(p), sorted(p)) for k, p in paths.items()], "run_id string, distance_km double, bucket int, start_cell long, end_cell long, n long, path array<struct<pos:long,cell:long>>")
    got = {(x.run_id, x.connected_run_id): round(x.similarity, 9) for x in routes.similarity(obs, least).collect()}
    want = plain_edges(paths, least)
    assert {k: v for k, v in got.items() if k[0] < k[1]} == want and len(got) == 2 * len(want)


def test_many_runs_of_one_start_are_not_all_paired(spark):
    """5,000 runs leave one place over the same first cells and then go their own ways, by twos."""
    found = [(f"r{k:05}", 5.0, 1, 2, 3, 12, [(i, i if i < 2 else 1000 + (k // 2) * 20 + i) for i in range(12)]) for k in range(5000)]
    obs = spark.createDataFrame(found, "run_id string, distance_km double, bucket int, start_cell long, end_cell long, n long, path array<struct<pos:long,cell:long>>")
    assert routes.candidate_pairs(obs, 0.8, ("bucket", "start_cell", "end_cell")).count() == 2500
    assert routes.similarity(obs, 0.8).count() == 5000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    r = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in zip(r.integers(0, 400, 260), r.integers(0, 400, 260)) if a != b} | {(k, k + 1) for k in range(500, 560)}
    top = {k: k for k in range(600)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in sorted(pairs):
        x, y = sorted((find(a), find(b)), key=str)
        top[y] = x
    nodes = spark.createDataFrame([(str(k),) for k in range(600)], "run_id string")
    edges = spark.createDataFrame([(str(x), str(y)) for a, b in pairs for x, y in ((a, b), (b, a))], "run_id string, connected_run_id string").repartition(5)
    assert dict(map(tuple, routes.connected_components(nodes, edges).collect())) == {str(k): str(find(k)) for k in range(600)}


def test_copies_of_runs_are_one_class(spark):
    """2,000 runs of each of three paths: two paths share nine cells of ten, the third none; one run differs in distance, one is too far."""
    ways = {"a": [(i, i) for i in range(10)], "b": [(i, i if i < 9 else 50) for i in range(10)], "c": [(i, 100 + i) for i in range(10)]}
    found = [(f"{w}{k:04}", date(2024, 1, 1 + k % 9), 5.0, 1, "2", "3", 10, "x", p) for w, p in ways.items() for k in range(2000)]
    found += [("d", date(2023, 1, 1), 5.4, 1, "2", "3", 10, "x", ways["a"]), ("e", date(2023, 1, 1), 6.0, 1, "2", "3", 10, "x", ways["a"])]
    rows = spark.createDataFrame(found, "run_id string, activity_date date, distance_km double, bucket int, start_cell string, end_cell string, n long, signature string, path array<struct<pos:long,cell:long>>")
    obs = routes.classed(rows)
    classes = routes.classes_of(obs)
    edges = routes.similarity(classes, 0.9, routes.KEYS).cache()
    assert classes.count() == 5 and edges.count() == 6
    got = {r.run_id: (r.class_id, r.n_links, r.best_similarity) for r in routes.link_counts(obs, classes, edges).collect()}
    assert len(got) == 6002 and got["a0007"] == ("a0000", 4000, 1.0) and got["b0007"] == ("b0000", 4000, 1.0) and got["c0007"] == ("c0000", 1999, 1.0)
    assert got["d"] == ("d", 4000, 1.0) and got["e"] == ("e", 0, None)
    assert {r.run_id: r.root_run_id for r in routes.chronological_roots(classes, edges).collect()} == {"a0000": "d", "b0000": "d", "c0000": "c0000", "d": "d", "e": "e"}


def test_copied_events_agree_with_their_pairs(spark, data, tmp_path):
    """Events repeated under other users: links, roots, components and clusters by classes are those of all pairs of runs."""
    events = spark.read.parquet(f"{data}/events.parquet")
    copies = events.crossJoin(spark.range(3).select(F.col("id").alias("i"))).withColumns({"user_id": F.col("user_id") + F.col("i") * 800, "event_id": F.col("event_id") + F.col("i") * 10**6})
    copies.select(*events.columns).write.parquet(f"{tmp_path}/events.parquet")
    t = binding.Tables(spark, str(tmp_path))
    obs = routes.observed(t).cache()
    edges = routes.similarity(obs, 0.5, routes.KEYS).cache()
    counts = edges.groupBy("run_id").agg(F.count("*").alias("links"), F.max("similarity").alias("s"))
    want = {r.run_id: (r.links, r.s) for r in obs.join(counts, "run_id", "left").select("run_id", F.coalesce("links", F.lit(0)).alias("links"), "s").collect()}
    assert {r.run_id: (r.n_links, r.best_similarity) for r in routes.link_counts(*routes.graph_of(t)).collect()} == want
    roots = routes.chronological_roots(obs, edges)
    assert sorted(map(tuple, routes.roots_of(t).collect())) == sorted(map(tuple, roots.collect()))
    assert sorted(map(tuple, routes.components_of(t).collect())) == sorted(map(tuple, routes.connected_components(obs, edges).collect()))
    assert sorted(map(str, routes.clusters_of(t).collect())) == sorted(map(str, routes.route_clusters(obs, edges, roots).collect()))
