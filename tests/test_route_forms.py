"""Pairs, roots, components and clusters of runs by forms (keys and path) and distances, against plain loops over all pairs."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake import binding
from pacelake.plans import assertions, context, routes

SCHEMA = "run_id string, subject string, activity_date date, distance_km double, bucket double, n long, start_cell string, end_cell string, signature string, path array<struct<pos:long,cell:long>>"


def runs_of(seed, count):
    """Runs of two starts over a few paths, with distances a tenth apart to the last digit, copies, and some far from all."""
    r = np.random.default_rng(seed)
    ways = [[(i, i) for i in range(6)], [(i, i if i < 4 else 50 + i) for i in range(6)], [(i, i if i < 2 else 70 + i) for i in range(6)], [(i, 100 + i) for i in range(5)]]
    steps = [1.0, 1.1, 1.0 * 1.1, 1.21, 1.1 * 1.1, 1.331, 0.99, 0.909, 0.91, 2.0, 2.2, 2.4200000000000004, 5.0]
    out = []
    for k in range(count):
        way, start = ways[int(r.integers(0, 4))], str(int(r.integers(0, 2)))
        km = steps[int(r.integers(0, len(steps)))] if r.random() < 0.7 else round(float(r.uniform(0.5, 6)), 2)
        out.append((f"r{int(r.integers(0, 10**6)):06}-{k}", "s", date(2024, 1, 1) + timedelta(int(r.integers(0, 9))), km, 1.0, len(way), start, str(way[-1][1]), f"{start}>{way[-1][1]}>{int(r.integers(0, 2))}", way))
    return out


def plain_pairs(rows, least, keys=(4, 6)):
    found = {}
    for l in rows:
        for x in rows:
            if l[0] < x[0] and all(l[k] == x[k] for k in keys) and abs(l[3] - x[3]) <= 0.10 * min(l[3], x[3]):
                a, b = (sum(any((p + s, c) in other for s in (-1, 0, 1)) for p, c in own) / len(own) for own, other in ((l[9], x[9]), (x[9], l[9])))
                if min(a, b) >= least:
                    found[l[0], x[0]] = found[x[0], l[0]] = round(min(a, b), 9)
    return found


@pytest.fixture
def observed(spark, monkeypatch):
    def put(rows):
        obs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
        monkeypatch.setattr(routes, "observed", lambda t: obs)
        return rows

    return put


@pytest.mark.parametrize("least, keys, columns", [(0.5, routes.KEYS, (4, 6)), (0.9, routes.STRICT_KEYS, (4, 6, 7))])
def test_pairs_are_listed_both_ways(observed, least, keys, columns):
    rows = observed(runs_of(1, 90))
    got = [((x.run_id, x.connected_run_id), round(x.similarity, 9)) for x in routes.edges_of(None, least, keys).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain_pairs(rows, least, columns)


@pytest.mark.parametrize("name, least, keys", [("MD23_route_similarity", 0.5, routes.KEYS), ("MD23_route_similarity_strict", 0.9, routes.STRICT_KEYS)])
def test_queries_list_pairs_of_copied_events(spark, data, tmp_path, name, least, keys):
    """Each run of each copy is a row with each of its links, not counted."""
    events = spark.read.parquet(f"{data}/events.parquet")
    copies = events.crossJoin(spark.range(3).select(F.col("id").alias("i"))).withColumns({"user_id": F.col("user_id") + F.col("i") * 800, "event_id": F.col("event_id") + F.col("i") * 10**6})
    copies.select(*events.columns).write.parquet(f"{tmp_path}/events.parquet")
    want = routes.similarity(routes.observed(binding.Tables(spark, str(tmp_path))), least, keys).withColumn("similarity", F.round("similarity", 9))
    got = routes.R.queries[name](spark, str(tmp_path))
    assert got.columns == ["run_id", "connected_run_id", "similarity"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distances_of_one_path_are_not_paired(spark, observed):
    """4,000 runs of one path and as many of another half alike, all of different distances: two forms, three links."""
    ways = {"a": [(i, i) for i in range(6)], "b": [(i, i if i < 3 else 50) for i in range(6)]}
    observed([(f"{w}{k:04}", "s", date(2024, 1, 1), 1.0 + k / 100000, 1.0, 6, "1", "2", w, p) for w, p in ways.items() for k in range(4000)])
    obs, links = routes.forms_graph(None)
    assert sorted(x.similarity for x in links.collect()) == [0.5, 0.5, 1.0, 1.0]
    assert obs.select("form").distinct().count() == 2 and routes.members_of(obs).count() == 8000


def plain_roots(rows, pairs):
    order = {x[0]: (x[2], x[0]) for x in rows}
    up = {x: min([x, *(b for a, b in pairs if a == x)], key=order.get) for x in order}
    for _ in range(12):
        up = {x: up[up[x]] for x in up}
    return up


@pytest.mark.parametrize("seed", [2, 3])
def test_roots_by_forms(observed, seed):
    rows = observed(runs_of(seed, 140))
    assert dict(map(tuple, routes.roots_of(None).collect())) == plain_roots(rows, plain_pairs(rows, 0.5))


def test_pointers_are_followed_for_some_rounds(spark):
    """A chain of 20 runs, each pointing at the one before: k rounds follow 2^k pointers, and rounds enough all."""
    near = spark.createDataFrame([(f"{k:02}", f"{max(k - 1, 0):02}") for k in range(20)], "run_id string, up string")
    for rounds in (1, 2, 3, 12):
        assert dict(map(tuple, routes.followed(near, rounds).collect())) == {f"{k:02}": f"{max(k - 2**rounds, 0):02}" for k in range(20)}


def test_reach_is_told_by_the_rule_itself():
    km = np.unique([a * b for a in (0.3, 1.0, 1.1, 1.21, 2.2, 4.84) for b in (1.0, 1.1, 1 / 1.1, 1.1 - 2e-16, 1.1 + 4e-16, 0.9)])
    low, high = routes._reach(km)
    for i, x in enumerate(km):
        inside = [j for j, y in enumerate(km) if abs(x - y) <= 0.10 * min(x, y)]
        assert (low[i], high[i]) == (inside[0], inside[-1]) and len(inside) == high[i] - low[i] + 1
    values = np.random.default_rng(5).permutation(len(km))
    assert [*routes._least_between(values, low, high)] == [values[a : b + 1].min() for a, b in zip(low, high)]


@pytest.mark.parametrize("seed", [4, 5])
def test_components_by_chains(observed, seed):
    rows = observed(runs_of(seed, 140))
    least, pairs = {x[0]: x[0] for x in rows}, plain_pairs(rows, 0.5)
    for _ in rows:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(map(tuple, routes.components_of(None).collect())) == least


@pytest.mark.parametrize("seed", [6, 7])
def test_clusters_by_members(observed, seed):
    rows = observed(runs_of(seed, 140))
    pairs = plain_pairs(rows, 0.5)
    roots = plain_roots(rows, pairs)
    best = {x: 1.0 if r == x else max((s for (a, b), s in pairs.items() if a == x and roots[b] == r), default=None) for x, r in roots.items()}
    got = routes.clusters_of(None).collect()
    assert {x.run_id: (x.representative_run_id, x.is_representative, x.similarity) for x in got} == {x: (r, r == x, best[x]) for x, r in roots.items()}
    names = {x[0]: x[8] for x in rows}
    assert len(got) == len(rows) and len({x.route_id for x in got}) == len({names[r] for r in roots.values()})


def test_links_out_of_range_are_counted_by_runs(observed, monkeypatch):
    """Links of a pair of forms that breaks the rule count once for each pair of runs."""
    rows = observed(runs_of(8, 90))
    plain = routes.similarity
    monkeypatch.setattr(routes, "similarity", lambda *a: plain(*a).withColumn("similarity", F.when(F.col("similarity") < 0.9, 1.5).otherwise(F.col("similarity"))))
    assert assertions._links_out_of_range(None).collect()[0][0] == sum(s < 0.9 for s in plain_pairs(rows, 0.5).values()) > 0


def test_score_page_works_sessions_out_once(spark, data):
    """The page and its total count read sessions that are kept, not the tables twice."""
    assert "parquet" not in context.R.queries["RD05_score_page"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
