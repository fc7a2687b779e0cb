"""Route identity: path observations, pruned similarity, chronological roots, components, clusters, summaries and places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact_mean, z_cell, z_cell_sql, z_parent
from ..operators.joins import band_join, nearest_place
from ..registry import Registry
from ..session import cut
from .telemetry import downsample_even

R = Registry()
C = F.col


#: Edge of the finer cells in degrees; cells of the path are one level up.
FINE = 0.002


def observations(records: DataFrame, runs: DataFrame, bucket_m: float = 250.0, sizes: float = FINE) -> DataFrame:
    """One row a run: the first record's cell in each distance bucket in order, at two levels of one hierarchy. Start, end and signature
    are of the finer level, the path that similarity compares is of the coarser one, so that nearby tracks share it. Buckets
    whose first record has no cell are left out, as are runs without a distance."""
    at = F.struct("record_distance_m", "record_index")
    cell = z_cell(C("lat"), C("lon"), sizes)
    position = F.floor(C("record_distance_m") / bucket_m).cast("long").alias("pos")
    firsts = records.where("record_distance_m is not null").groupBy("run_id", position).agg(F.min_by(cell, at).alias("fine"))
    path = F.array_sort(F.collect_list(F.struct("pos", "fine", z_parent(C("fine")).alias("cell"))))
    paths = firsts.where("fine is not null").groupBy("run_id").agg(path.alias("path"))
    bucket = F.round(C("distance_km") * 2) / 2
    signature = F.array_join(F.transform("path", lambda p: p["fine"].cast("string")), ">")
    return paths.join(runs.select("run_id", "subject", "activity_date", "distance_km"), "run_id").where("distance_km > 0").select(
        "run_id", "subject", "activity_date", "distance_km", bucket.alias("bucket"), F.size("path").cast("long").alias("n"),
        C("path")[0]["fine"].cast("string").alias("start_cell"), F.element_at("path", -1)["fine"].cast("string").alias("end_cell"), signature.alias("signature"),
        F.transform("path", lambda p: F.struct(p["pos"].alias("pos"), p["cell"].alias("cell"))).alias("path"),
    )


_FIRSTS = f"""(select run_id, pos, fine, fine >> 2 as cell from (select *, row_number() over (partition by run_id, pos order by record_distance_m, record_index) as rn from
 (select *, cast(floor(record_distance_m / 250.0) as bigint) as pos, {z_cell_sql("lat", "lon", FINE)} as fine from {{vgeo}} g where record_distance_m is not null) a) b where rn = 1 and fine is not null)"""
OBS = f"""(select p.run_id, v.subject, v.activity_date, v.distance_km, round(v.distance_km * 2) / 2 as bucket, n, start_cell, end_cell, signature, path from
 (select run_id, count(*) as n, max(case when f = 1 then cast(fine as varchar) end) as start_cell, max(case when l = 1 then cast(fine as varchar) end) as end_cell,
  string_agg(cast(fine as varchar), '>' order by pos) as signature, string_agg(cast(cell as varchar), '>' order by pos) as path from
 (select *, row_number() over (partition by run_id order by pos) as f, row_number() over (partition by run_id order by pos desc) as l from {_FIRSTS} c) d group by run_id) p join {{vrun}} v on p.run_id = v.run_id where v.distance_km > 0)"""
PTS = f"(select run_id, pos, cell from {_FIRSTS} q)"


def observed(t) -> DataFrame:
    return observations(t.vgeo, t.vrun)


R.query("MD22_route_observations", f"select * from {OBS} o")(
    lambda t: observed(t).withColumn("path", F.array_join(F.transform("path", lambda p: p["cell"].cast("string")), ">")))
KEYS = ("bucket", "start_cell")


def _points(obs: DataFrame, *more: str) -> DataFrame:
    return obs.select("run_id", *more, F.explode("path").alias("p")).select("run_id", *more, C("p.pos").alias("pos"), C("p.cell").alias("cell"))


def within(a: str, b: str) -> Column:
    """Distances that differ by a tenth of the lesser at most."""
    return F.abs(C(a) - C(b)) <= 0.10 * F.least(a, b)


def ranges_meet(a: str, b: str) -> Column:
    """Whether of the distances from {a}_low to {a}_high and from {b}_low to {b}_high two are within a tenth: the ends that face each other, as all
    others are farther apart, or any where the ranges overlap."""
    high = F.least(f"{a}_high", f"{b}_high")
    return F.greatest(f"{a}_low", f"{b}_low") - high <= 0.10 * high


def candidate_pairs(obs: DataFrame, least: float, keys: tuple[str, ...]) -> DataFrame:
    """(l_id, r_id, l_n, r_n): pairs of runs with equal keys and distances within a tenth that can reach the similarity; or of forms (below),
    which have a range of distances (`low_km`, `high_km`), where two of these can be within a tenth.

    An inverted index over the rarest cells of each path: a pair at `least` matches that share of both paths, so the rarest
    cell that is matched stands among the first n - ceil(least n) + 1 of each path in order of rarity (of a cell among
    the runs of its keys). Only these are joined, so many runs from one start meet where their ways are rare, not all of them.
    """
    if "low_km" not in obs.columns:
        obs = obs.withColumns({"low_km": C("distance_km"), "high_km": C("distance_km")})
    points = _points(obs, *keys, "low_km", "high_km", "n")
    often = points.groupBy(*keys, "cell").agg(F.countDistinct("run_id").alias("often"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("often", "cell", "pos"))
    needed = C("n") - F.ceil(C("n") * F.lit(least) - 1e-9) + 1
    probes = points.join(often, [*keys, "cell"]).withColumn("_rank", rank).where(C("_rank") <= needed).select("run_id", *keys, "low_km", "high_km", "n", "cell").distinct()
    side = lambda p: probes.select(C("run_id").alias(p + "_id"), C("low_km").alias(p + "_low"), C("high_km").alias(p + "_high"), C("n").alias(p + "_n"), *[C(k).alias(f"{p}_{k}") for k in (*keys, "cell")])
    on = [C(f"l_{k}") == C(f"r_{k}") for k in (*keys, "cell")] + [C("l_id") < C("r_id"), ranges_meet("l", "r")]
    return side("l").join(side("r"), on).select("l_id", "r_id", "l_n", "r_n").distinct()


def similarity(obs: DataFrame, least: float = 0.9, keys: tuple[str, ...] = ("bucket", "start_cell", "end_cell")) -> DataFrame:
    """Edges both ways between runs with equal keys and distances within a tenth, by the share of each path's cells that the other
    has at the same place or next to it; the lesser share counts. Candidates come from rare cells; of these, matches are an
    equality join on cell and place."""
    pairs, points = candidate_pairs(obs, least, keys), _points(obs)
    left = pairs.join(points, C("l_id") == C("run_id")).drop("run_id")
    met = band_join(left, points.select(C("run_id").alias("r_id"), "pos", "cell"), ["r_id", "cell"], "pos", 1, "o_")
    shares = met.groupBy("l_id", "r_id", "l_n", "r_n").agg(F.countDistinct("pos").alias("a"), F.countDistinct("o_pos").alias("b"))
    score = F.least(C("a") / C("l_n"), C("b") / C("r_n"))
    found = shares.select("l_id", "r_id", score.alias("similarity")).where(C("similarity") >= least)
    both = F.array(*[F.struct(C(a).alias("run_id"), C(b).alias("connected_run_id"), "similarity") for a, b in (("l_id", "r_id"), ("r_id", "l_id"))])
    return found.select(F.inline(both))


_LEAST = 0.5
_ONE = f"""(select l.run_id as l_id, r.run_id as r_id, least(count(distinct a.pos) / l.n::double, count(distinct b.pos) / r.n::double) as similarity from {OBS} l join {OBS} r on l.bucket = r.bucket and l.start_cell = r.start_cell and l.run_id < r.run_id and abs(l.distance_km - r.distance_km) <= 0.10 * least(l.distance_km, r.distance_km)
 join {PTS} a on a.run_id = l.run_id join {PTS} b on b.run_id = r.run_id and a.cell = b.cell and abs(a.pos - b.pos) <= 1 group by l.run_id, r.run_id, l.n, r.n)"""
EDGES = f"(select l_id as run_id, r_id as connected_run_id, similarity from {_ONE} x where similarity >= {_LEAST} union all select r_id, l_id, similarity from {_ONE} y where similarity >= {_LEAST})"


def formed(obs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`obs` with `form`: equal for runs with equal keys and path, whatever their distance. Similarity depends on forms only; whether two runs of
    similar forms are linked depends on their distances only."""
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["pos"], p["cell"])), ">")
    return obs.withColumn("form", F.unhex(F.md5(F.concat_ws("|", *keys, path))))


def forms_of(obs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a form of `formed` runs, under the form's name as `run_id`: keys, path, and the range of its runs' distances."""
    kept = F.min_by(F.struct(*keys, "n", "path"), "run_id").alias("r")
    return obs.groupBy(C("form").alias("run_id")).agg(F.min("distance_km").alias("low_km"), F.max("distance_km").alias("high_km"), kept).select("run_id", "low_km", "high_km", "r.*")


def form_links(forms: DataFrame, least: float, keys: tuple[str, ...]) -> DataFrame:
    """(form, connected_form, similarity) both ways between similar forms, and of each form with itself."""
    between = similarity(forms, least, keys).select(C("run_id").alias("form"), C("connected_run_id").alias("connected_form"), "similarity")
    return between.unionByName(forms.select(C("run_id").alias("form"), C("run_id").alias("connected_form"), F.lit(1.0).alias("similarity")))


def forms_graph(t, least: float = _LEAST, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Observations with their forms, and the links between forms, each worked out once. Runs are not paired."""
    obs = cut(formed(observed(t), keys))
    return obs, cut(form_links(forms_of(obs, keys), least, keys))


def linked(obs: DataFrame, links: DataFrame) -> DataFrame:
    """Edges both ways between the runs of linked forms whose distances are within a tenth."""
    side = lambda form, name, km: obs.select(C("form").alias(form), C("run_id").alias(name), C("distance_km").alias(km))
    met = links.join(side("form", "run_id", "l_km"), "form").join(side("connected_form", "connected_run_id", "r_km"), "connected_form")
    return met.where(within("l_km", "r_km") & (C("run_id") != C("connected_run_id"))).select("run_id", "connected_run_id", "similarity")


def edges_of(t, least: float = _LEAST, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return linked(*forms_graph(t, least, keys))


R.query("MD23_route_similarity", f"select run_id, connected_run_id, round(similarity, 9) as similarity from {EDGES} e")(lambda t: edges_of(t).withColumn("similarity", F.round("similarity", 9)))


STRICT_KEYS = ("bucket", "start_cell", "end_cell")
_STRICT = _ONE.replace("and l.start_cell = r.start_cell", "and l.start_cell = r.start_cell and l.end_cell = r.end_cell")
R.query("MD23_route_similarity_strict", f"select l_id as run_id, r_id as connected_run_id, round(similarity, 9) as similarity from {_STRICT} x where similarity >= 0.9 union all select r_id, l_id, round(similarity, 9) from {_STRICT} y where similarity >= 0.9")(
    lambda t: edges_of(t, 0.9, STRICT_KEYS).withColumn("similarity", F.round("similarity", 9)))


def classed(obs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """`obs` with `class_key`: equal for runs with equal keys, distance and path. These are linked with one another (similarity 1) and have the
    same links and similarities to all other runs."""
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["pos"], p["cell"])), ">")
    return obs.withColumn("class_key", F.sha2(F.concat_ws("|", *keys, "distance_km", path), 256))


def classes_of(obs: DataFrame) -> DataFrame:
    """One row a class of `classed` runs: that of its first run by (date, id), with the least id (`class_id`) and the number of runs (`copies`)."""
    kept = F.min_by(F.struct(*[c for c in obs.columns if c != "class_key"]), F.struct("activity_date", "run_id")).alias("r")
    return obs.groupBy("class_key").agg(F.min("run_id").alias("class_id"), F.count("*").alias("copies"), kept).select("class_key", "class_id", "copies", "r.*")


def graph_of(t, least: float = _LEAST, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, their classes, and the edges between classes (named by first runs). Runs of a class are never paired."""
    obs, links = forms_graph(t, least, keys)
    obs = cut(classed(obs, keys))
    classes = cut(classes_of(obs))
    return obs, classes, cut(linked(classes, links))


def link_counts(obs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a run: its class, with how many runs it is linked, and the best similarity of these."""
    copies = classes.select(C("run_id").alias("connected_run_id"), "copies")
    outside = edges.join(copies, "connected_run_id").groupBy("run_id").agg(F.sum("copies").alias("_links"), F.max("similarity").alias("_best"))
    links = C("copies") - 1 + F.coalesce("_links", F.lit(0))
    each = classes.join(outside, "run_id", "left").select("class_key", "class_id", links.alias("n_links"), F.when(C("copies") > 1, 1.0).otherwise(C("_best")).alias("best_similarity"))
    return obs.select("run_id", "class_key").join(each, "class_key").drop("class_key")


def followed(near: DataFrame, rounds: int = 12) -> DataFrame:
    """(run_id, root_run_id): where pointers (run_id, up) lead once nothing changes, or after `rounds` rounds, in which a chain of up to 2^rounds
    pointers is followed; a longer one would end early.

    Rounds are run on the runs that are pointed at only, often few. Besides each one's 2^k-th pointer (`to`) they keep the one before that
    (`past`), so that a run's own pointer and then `past` are 2^rounds pointers.
    """
    ends = near.select(C("up").alias("run_id")).distinct()
    state = cut(near.join(ends, "run_id", "left_semi").select("run_id", C("up").alias("to"), C("run_id").alias("past")))
    settled = False
    for _ in range(rounds):
        of = lambda c: state.select(C("run_id").alias(c), C("to").alias(c + "_to"))
        state = cut(state.join(of("to"), "to").join(of("past"), "past").select("run_id", C("to_to").alias("to"), C("past_to").alias("past"), (C("to_to") != C("to")).alias("_moved")))
        settled = state.where("_moved").isEmpty()
        state = state.drop("_moved")
        if settled:
            break
    last = state.select(C("run_id").alias("up"), C("to" if settled else "past").alias("root_run_id"))
    return near.select("run_id", "up").join(last, "up").select("run_id", "root_run_id")


def chronological_roots(obs: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(run_id, root): runs by (date, id) order; a run points at the least of itself and its direct neighbours, and pointers are `followed`. Links
    are never taken up again, so roots are not components.

    The order key is the pair itself, which sorts as the order does, so no global numbering is needed.
    """
    nodes = obs.select("run_id", F.struct("activity_date", "run_id").alias("ord"))
    near = edges.join(nodes.select(C("run_id").alias("connected_run_id"), C("ord").alias("_o")), "connected_run_id").groupBy("run_id").agg(F.min("_o").alias("_m"))
    return followed(cut(nodes.join(near, "run_id", "left").select("run_id", F.least("ord", F.coalesce("_m", "ord"))["run_id"].alias("up"))), rounds)


def _root_steps(n: int) -> str:
    out = f"""with o as materialized (select run_id, row_number() over (order by activity_date, run_id) as ord from {OBS} x), ed as materialized (select * from {EDGES} e),
 s0 as materialized (select o.run_id, o.ord, least(o.ord, coalesce(min(c.ord), o.ord)) as root from o left join ed on ed.run_id = o.run_id left join o c on c.run_id = ed.connected_run_id group by o.run_id, o.ord)"""
    for k in range(n):
        out += f", s{k + 1} as materialized (select a.run_id, a.ord, b.root from s{k} a join s{k} b on a.root = b.ord)"
    return out


ROOTS = _root_steps(12)
R.query("MD24_chronological_roots", f"{ROOTS} select a.run_id, b.run_id as root_run_id from s12 a join o b on a.root = b.ord")(
    lambda t: roots_of(t))


def members_of(obs: DataFrame) -> DataFrame:
    """One row a form and distance, whose runs are linked with one another and have the same links and similarities to all others: the first run by
    (date, id) as `run_id` with its date, the least id (`class_id`) and the number of runs (`copies`)."""
    first = F.min(F.struct("activity_date", "run_id")).alias("f")
    return obs.groupBy("form", "distance_km").agg(first, F.min("run_id").alias("class_id"), F.count("*").alias("copies")).select("form", "distance_km", "f.run_id", "f.activity_date", "class_id", "copies")


def handed(obs: DataFrame, members: DataFrame) -> DataFrame:
    """What `members` know, for each run."""
    return obs.select("run_id", "form", "distance_km").join(members, ["form", "distance_km"]).drop("form", "distance_km")


def _reach(km: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending distances the places of the first and the last that are `within` a tenth of each: near the bounds by division, then by the rule itself."""
    last = len(km) - 1
    low, high = np.minimum(np.searchsorted(km, km / 1.1), np.arange(last + 1)), np.maximum(np.searchsorted(km, km * 1.1, "right") - 1, np.arange(last + 1))
    is_low, is_high = lambda i: km - km[i] <= 0.10 * km[i], lambda i: km[i] - km <= 0.10 * km
    for at, is_in, step in ((low, is_low, -1), (high, is_high, 1)):
        while (out := ~is_in(at)).any():
            at[out] -= step
        while (more := (at != (0 if step < 0 else last)) & is_in(np.clip(at + step, 0, last))).any():
            at[more] += step
    return low, high


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high], by two spans of a power of two."""
    spans, out = [values], np.empty_like(values)
    while len(spans[-1]) > (half := 1 << len(spans) - 1):
        spans.append(np.minimum(spans[-1][:-half], spans[-1][half:]))
    power = np.frexp(high - low + 1)[1] - 1
    for k in np.unique(power):
        at = power == k
        out[at] = np.minimum(spans[k][low[at]], spans[k][high[at] - (1 << k) + 1])
    return out


def _least_in_reach(rows: pa.Table) -> pa.Table:
    """Of one form and what is linked with it, a row a distance: for its own runs the first run of all that are within a tenth."""
    rows = rows.sort_by("distance_km").combine_chunks()
    by_order = pc.sort_indices(rows, [("day", "ascending"), ("first", "ascending")])
    rank = np.empty(len(rows), np.int64)
    rank[by_order.to_numpy()] = np.arange(len(rows))
    least = _least_between(rank, *_reach(rows["distance_km"].to_numpy()))
    up = rows["first"].take(by_order.take(pa.array(least)))
    return rows.select(["form", "distance_km", "run_id", "copies"]).append_column("up", up).filter(pc.is_valid(rows["run_id"]))


def member_pointers(members: DataFrame, links: DataFrame) -> DataFrame:
    """(form, distance_km, run_id, copies, up): each member with the first run by (date, id) of it and its direct neighbours.

    A form meets the members of linked forms, not its own runs with theirs: of these, one row a distance is kept, and least orders are looked
    up by ranges of distances. A task holds one form's distances; in centimetres these are 50,000 at most, as keys hold a bucket of half a kilometre.
    """
    kind = dict(members.dtypes)
    other = members.withColumnRenamed("form", "connected_form")
    own = lambda c: F.min(F.when(C("form") == C("connected_form"), C(c))).alias(c)
    met = links.join(other, "connected_form").repartition("form").groupBy("form", "distance_km").agg(F.min(F.struct("activity_date", "run_id")).alias("f"), own("run_id"), own("copies"))
    flat = met.select("form", "distance_km", "run_id", "copies", C("f.activity_date").alias("day"), C("f.run_id").alias("first"))
    return flat.groupBy("form").applyInArrow(_least_in_reach, f"form binary, distance_km double, run_id {kind['run_id']}, copies long, up {kind['run_id']}")


def member_roots(obs: DataFrame, links: DataFrame) -> DataFrame:
    """(form, distance_km, run_id, copies, root_run_id): members with their chronological roots."""
    near = cut(member_pointers(members_of(obs), links))
    return near.drop("up").join(followed(near), "run_id")


def roots_of(t) -> DataFrame:
    """Roots of members, handed to their runs: a member points where its first run does."""
    obs, links = forms_graph(t)
    return handed(obs, member_roots(obs, links).select("form", "distance_km", "root_run_id"))


def _local_roots(batches):
    """Links (a, b) of one partition as links of each name with the least name that it reaches there."""
    batches = list(batches)
    links = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if links is None or not links.num_rows:
        return
    ends = pa.concat_arrays([links.column(0).combine_chunks(), links.column(1).combine_chunks()])
    names = pc.unique(ends).sort()
    x, y = np.split(pc.index_in(ends, names).to_numpy().astype(np.int64), 2)
    root = np.arange(len(names))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(root[moved]))], ["a", "b"])


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(run_id, component): the smallest id that a run reaches, itself where it has no link.

    Each partition first contracts its links by itself. Then, until every linked run points straight at a run that points
    nowhere: a run's larger neighbours are linked with the smallest of its neighbourhood, then its smaller ones (large and small stars), so
    rounds grow with the logarithm of the longest path. Runs come in at the end only.
    """
    kind = dict(nodes.dtypes)["run_id"]
    links = edges.select(F.greatest("run_id", "connected_run_id").alias("a"), F.least("run_id", "connected_run_id").alias("b")).where("a != b")
    links = cut(links.mapInArrow(_local_roots, f"a {kind}, b {kind}").distinct())
    for _ in range(max_rounds):
        ends = links.select("a", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(links.select(C("b").alias("a"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty():
            found = links.select(C("a").alias("_a"), C("b").alias("_b"))
            return nodes.select("run_id").join(found, C("run_id") == C("_a"), "left").select("run_id", F.coalesce("_b", "run_id").alias("component"))
        both = links.unionByName(links.select(C("b").alias("a"), C("a").alias("b")))
        least = both.groupBy(C("a").alias("_u")).agg(F.least(F.min("b"), F.first("a")).alias("_low"))
        large = both.join(least, C("a") == C("_u")).where("b > a").select(C("b").alias("a"), C("_low").alias("b")).distinct()
        low = large.groupBy(C("a").alias("_u")).agg(F.min("b").alias("_low"))
        small = large.join(low, C("a") == C("_u")).where("b != _low").select(C("b").alias("a"), C("_low").alias("b"))
        links = cut(small.unionByName(low.select(C("_u").alias("a"), C("_low").alias("b"))).mapInArrow(_local_roots, f"a {kind}, b {kind}").distinct())
    raise RuntimeError("components did not settle")


R.query("MD25_connected_components", f"with recursive ed as materialized (select * from {EDGES} e), r as (select run_id as node, run_id as seen from {OBS} o union select ed.connected_run_id as node, r.seen from r join ed on ed.run_id = r.node) select node as run_id, min(seen) as component from r group by node")(
    lambda t: components_of(t))


def chained(members: DataFrame) -> DataFrame:
    """(form, distance_km, chain, class_id): members of a form by distance, a new chain where the next is not within a tenth. All runs of a chain
    reach one another."""
    along = Window.partitionBy("form").orderBy("distance_km")
    rows = members.select("form", "distance_km", "class_id", F.lag("distance_km").over(along).alias("_p"))
    return rows.select("form", "distance_km", F.count_if(C("_p").isNotNull() & ~within("_p", "distance_km")).over(along).alias("chain"), "class_id")


def chain_edges(chains: DataFrame, links: DataFrame) -> DataFrame:
    """Edges between chains (form, run_id, low, high) of linked forms of which two runs are linked. Where their ranges overlap two are, for
    the next distance in either chain is within a tenth."""
    side = lambda form, name, p: chains.select(C("form").alias(form), C("run_id").alias(name), C("low").alias(p + "_low"), C("high").alias(p + "_high"))
    met = links.join(side("form", "run_id", "l"), "form").join(side("connected_form", "connected_run_id", "r"), "connected_form")
    return met.where(ranges_meet("l", "r") & (C("run_id") != C("connected_run_id"))).select("run_id", "connected_run_id")


def components_of(t) -> DataFrame:
    """Components of chains, which are named by their least runs, handed to their runs."""
    obs, links = forms_graph(t)
    rows = cut(chained(members_of(obs)))
    chains = cut(rows.groupBy("form", "chain").agg(F.min("class_id").alias("run_id"), F.min("distance_km").alias("low"), F.max("distance_km").alias("high")))
    found = chains.select("run_id", "form", "chain").join(connected_components(chains, chain_edges(chains, links)), "run_id").drop("run_id")
    return handed(obs, rows.join(found, ["form", "chain"]).select("form", "distance_km", "component"))


def route_names(obs: DataFrame) -> DataFrame:
    """(root_run_id, route_id): the id of the route that a run would represent, from its bucket and signature."""
    return obs.select(C("run_id").alias("root_run_id"), F.sha2(F.concat_ws("|", (C("bucket") * 10).cast("long").cast("string"), "signature"), 256).alias("route_id"))


def route_clusters(obs: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Each run's route: representative (its root), id from the representative's bucket and path, and its best similarity to a run
    of the same root (1 for the representative). Edges are filtered to equal roots; runs of a root are never paired."""
    rep = route_names(obs)
    other = roots.select(C("run_id").alias("connected_run_id"), C("root_run_id").alias("_r"))
    best = edges.join(roots, "run_id").join(other, "connected_run_id").where("root_run_id = _r").groupBy("run_id").agg(F.max("similarity").alias("_best"))
    return roots.join(rep, "root_run_id").join(best, "run_id", "left").select("run_id", "route_id", C("root_run_id").alias("representative_run_id"), (C("run_id") == C("root_run_id")).alias("is_representative"), F.round(F.when(C("run_id") == C("root_run_id"), 1.0).otherwise(C("_best")), 9).alias("similarity"))


CLUSTER_CTES = f"{ROOTS}, ro as materialized (select a.run_id, b.run_id as root_run_id from s12 a join o b on a.root = b.ord), cl as (select ro.run_id, sha256(concat_ws('|', cast(cast(p.bucket * 10 as bigint) as varchar), p.signature)) as route_id, root_run_id as representative_run_id, ro.run_id = root_run_id as is_representative, round(case when ro.run_id = root_run_id then 1.0 else best end, 9) as similarity from ro join {OBS} p on p.run_id = ro.root_run_id left join (select e.run_id, max(e.similarity) as best from ed e join ro x on e.run_id = x.run_id join ro y on e.connected_run_id = y.run_id and x.root_run_id = y.root_run_id group by e.run_id) m on m.run_id = ro.run_id)"


def best_matches(members: DataFrame, links: DataFrame) -> DataFrame:
    """(form, distance_km, root_run_id, best): each member's best similarity to another run of its root that it is linked with, null where there is none.

    1 where the next distance of the same form and root is within a tenth, or where it has copies. The others ask each form that theirs is linked
    with for its distances next to theirs, below and above, among those of the root.
    """
    line = Window.partitionBy("form", "root_run_id").orderBy("distance_km")
    either = lambda a, b: F.coalesce(within("distance_km", a), F.lit(False)) | F.coalesce(within("distance_km", b), F.lit(False))
    rows = members.withColumns({"_b": F.lag("distance_km").over(line), "_a": F.lead("distance_km").over(line)})
    rows = cut(rows.select("form", "distance_km", "root_run_id", (either("_b", "_a") | (C("copies") > 1)).alias("_own")))
    asked = rows.where("not _own").join(links.where("form != connected_form"), "form").select(C("connected_form").alias("form"), "root_run_id", "distance_km", C("form").alias("_of"), "similarity", F.lit(1).alias("_ask"))
    both = rows.select("form", "root_run_id", "distance_km", C("distance_km").alias("_km"), F.lit(0).alias("_ask")).unionByName(asked, allowMissingColumns=True)
    before, after = (Window.partitionBy("form", "root_run_id").orderBy(x, "_ask").rowsBetween(Window.unboundedPreceding, 0) for x in (C("distance_km"), C("distance_km").desc()))
    told = both.withColumns({"_b": F.last("_km", True).over(before), "_a": F.last("_km", True).over(after)}).where((C("_ask") == 1) & either("_b", "_a"))
    best = told.groupBy(C("_of").alias("form"), "distance_km").agg(F.max("similarity").alias("_best"))
    return rows.join(best, ["form", "distance_km"], "left").select("form", "distance_km", "root_run_id", F.when(C("_own"), 1.0).otherwise(C("_best")).alias("best"))


def clustered(t) -> tuple[DataFrame, DataFrame]:
    """Observations and the route of each run. Roots and best similarities are told by members and handed to their runs."""
    obs, links = forms_graph(t)
    each = handed(obs, best_matches(member_roots(obs, links), links))
    first = C("run_id") == C("root_run_id")
    names = route_names(obs.join(each.select(C("root_run_id").alias("run_id")), "run_id", "left_semi"))
    return obs, each.join(names, "root_run_id").select("run_id", "route_id", C("root_run_id").alias("representative_run_id"), first.alias("is_representative"), F.round(F.when(first, 1.0).otherwise(C("best")), 9).alias("similarity"))


def clusters_of(t) -> DataFrame:
    return clustered(t)[1]


R.query("MD26_route_clusters", f"{CLUSTER_CTES} select * from cl")(clusters_of)


def routes(clusters: DataFrame, runs: DataFrame, records: DataFrame, places: DataFrame | None = None, sample: int = 500) -> DataFrame:
    """One row a route: runs, distances, times, centre of the representative's sampled points, first valid start, and the nearest place."""
    of = clusters.join(runs, "run_id")
    summary = of.groupBy("route_id").agg(F.min("representative_run_id").alias("representative_run_id"), F.count("*").alias("run_count"), F.min("activity_date").alias("first_date"), F.max("activity_date").alias("last_date"), exact_mean("distance_km", 5).alias("avg_km"), F.min("distance_km").alias("min_km"), F.max("distance_km").alias("max_km"),
                                         exact_mean("duration_seconds", 0).alias("avg_seconds"), F.min("duration_seconds").alias("best_seconds"), F.round(F.avg("avg_heart_rate"), 6).alias("avg_hr"), exact_mean("similarity", 9).alias("avg_similarity"))
    chosen = records.join(summary.select(C("representative_run_id").alias("run_id")), "run_id", "left_semi")
    centre = downsample_even(chosen, sample).groupBy("run_id").agg(exact_mean("lat", 6).alias("lat"), exact_mean("lon", 6).alias("lon"))
    start = chosen.where("lat is not null").groupBy("run_id").agg(F.min_by(F.struct("lat", "lon"), "record_index").alias("s")).select("run_id", C("s.lat").alias("start_lat"), C("s.lon").alias("start_lon"))
    out = summary.join(centre.withColumnRenamed("run_id", "representative_run_id"), "representative_run_id", "left").join(start.withColumnRenamed("run_id", "representative_run_id"), "representative_run_id", "left")
    if places is not None:
        near = nearest_place(out.where("start_lat is not null").select("route_id", "start_lat", "start_lon"), places, "route_id", "start_lat", "start_lon").select("route_id", C("name").alias("city"))
        out = out.join(near, "route_id", "left")
    return out


def places_of(t) -> DataFrame:
    return t.supplier.select(C("s_name").alias("name"), (51.8 + (C("s_suppkey") % 10) * 0.07).cast("double").alias("p_lat"), (4.7 + (C("s_suppkey") % 9) * 0.09).cast("double").alias("p_lon"), C("s_suppkey").cast("long").alias("population"))


_PLACES = "(select s_name as name, cast(51.8 + (s_suppkey % 10) * 0.07 as double) as p_lat, cast(4.7 + (s_suppkey % 9) * 0.09 as double) as p_lon, cast(s_suppkey as bigint) as population from supplier)"
_NEAR = f"""(select route_id, name as city, km from (select *, row_number() over (partition by route_id order by population desc, km, name desc) as rn from (select *, min(km) over (partition by route_id) as m from
 (select route_id, name, population, 2 * 6371.0 * asin(least(sqrt(pow(sin(radians(p_lat - start_lat) / 2), 2) + cos(radians(start_lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - start_lon) / 2), 2)), 1.0)) as km from su join {_PLACES} c on abs(start_lat - p_lat) <= 0.5 and abs(start_lon - p_lon) <= 0.7) a) b where km <= m + 0.001) c0 where rn = 1)"""
SUMMARY = f"""{CLUSTER_CTES}, su0 as (select route_id, min(representative_run_id) as representative_run_id, count(*) as run_count, min(activity_date) as first_date, max(activity_date) as last_date, cast(sum(cast(distance_km as decimal(38,5))) as double) / count(distance_km) as avg_km, min(distance_km) as min_km, max(distance_km) as max_km, cast(sum(cast(duration_seconds as decimal(38,0))) as double) / count(duration_seconds) as avg_seconds, min(duration_seconds) as best_seconds,
 round(avg(avg_heart_rate), 6) as avg_hr, cast(sum(cast(similarity as decimal(38,9))) as double) / count(similarity) as avg_similarity from cl join {{vrun}} v on cl.run_id = v.run_id group by route_id),
 ge as materialized (select * from {{vgeo}} g where run_id in (select representative_run_id from su0)), sa as (select run_id, cast(sum(cast(lat as decimal(38,6))) as double) / nullif(count(lat), 0) as lat, cast(sum(cast(lon as decimal(38,6))) as double) / nullif(count(lon), 0) as lon from (select *, count(*) over (partition by run_id) as n from ge) x where n <= 5 or exists (select 1 from range(5) p(i) where record_index = cast(floor(p.i * (n - 1) / 4.0) as bigint) + 1) group by run_id),
 st as (select run_id, lat as start_lat, lon as start_lon from (select *, row_number() over (partition by run_id order by record_index) as rn from ge where lat is not null) x where rn = 1), su as materialized (select su0.*, sa.lat, sa.lon, st.start_lat, st.start_lon from su0 left join sa on sa.run_id = representative_run_id left join st on st.run_id = representative_run_id)"""
R.query("MD28_routes", f"{SUMMARY} select su.*, n.city from su left join {_NEAR} n on su.route_id = n.route_id")(lambda t: routes(clusters_of(t), t.vrun, t.vgeo, places_of(t), 5))


def geocode_routes(starts: DataFrame, places: DataFrame, known: DataFrame) -> DataFrame:
    """Labels for all routes: those whose start moved or that have no label are looked up again, others keep theirs."""
    old = known.select("route_id", C("city").alias("_city"), C("lat").alias("_lat"), C("lon").alias("_lon"))
    both = starts.join(old, "route_id", "left")
    stale = ~C("start_lat").eqNullSafe(C("_lat")) | ~C("start_lon").eqNullSafe(C("_lon")) | C("_city").isNull()
    fresh = nearest_place(both.where(stale & C("start_lat").isNotNull()), places, "route_id", "start_lat", "start_lon").select("route_id", C("name").alias("_new"))
    return both.withColumn("_stale", stale).join(fresh, "route_id", "left").select("route_id", F.when(C("_stale"), C("_new")).otherwise(C("_city")).alias("city"), "start_lat", "start_lon", C("_stale").alias("geocoded"))


_MD31 = f"""{SUMMARY}, kn as (select route_id, 'Known' as city, start_lat as lat, start_lon as lon from su where run_count % 2 = 0) select su.route_id, case when kn.route_id is null or kn.lat is distinct from start_lat or kn.lon is distinct from start_lon then n.city else kn.city end as city, start_lat, start_lon,
 kn.route_id is null or kn.lat is distinct from start_lat or kn.lon is distinct from start_lon as geocoded from su left join kn on su.route_id = kn.route_id left join {_NEAR} n on su.route_id = n.route_id"""


def _geocoded(t):
    r = cut(routes(clusters_of(t), t.vrun, t.vgeo, None, 5))
    known = r.where("run_count % 2 = 0").select("route_id", F.lit("Known").alias("city"), C("start_lat").alias("lat"), C("start_lon").alias("lon"))
    return geocode_routes(r.select("route_id", "start_lat", "start_lon"), places_of(t), known)


R.query("MD31_geocode_routes", _MD31)(_geocoded)


def geo_areas(points: DataFrame, keys: list[str], lat: str, lon: str, pad: float = 0.16, least: float = 0.02, ident: str | None = None) -> DataFrame:
    """Bounding box of each group, padded by a share of its size but `least` degrees at least, with centre and counts; missing keys are 'unknown'.
    With `ident`, (keys, ident, area) rows instead of `n` and `visible`: the members of each area beside its box, one row each, so an
    area may have any number of them."""
    named = points.select(*[F.coalesce(k, F.lit("unknown")).alias(k) for k in keys], lat, lon, *([ident] if ident else []))
    if ident:
        names = [f"_{k}" for k in keys]
        boxes = geo_areas(points, keys, lat, lon, pad, least).withColumnsRenamed(dict(zip(keys, names, strict=True)))
        return named.select(*keys, ident).join(boxes, [C(a) == C(b) for a, b in zip(keys, names, strict=True)]).drop(*names, "n", "visible")
    box = named.groupBy(*keys).agg(F.count("*").alias("n"), F.count(lat).alias("visible"), *[f(c).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max))])
    margin = lambda c: F.greatest((C(f"max_{c}") - C(f"min_{c}")) * pad, F.lit(least))
    return box.select(*keys, "n", "visible", *[x for c in (lat, lon) for x in (F.round(C(f"min_{c}") - margin(c), 6).alias(f"low_{c}"), F.round(C(f"max_{c}") + margin(c), 6).alias(f"high_{c}"), F.round((C(f"min_{c}") + C(f"max_{c}")) / 2, 6).alias(f"mid_{c}"))])


R.query("MD32_geo_areas", "select country, city, n, visible, " + ", ".join(f"round(mn{c} - greatest((mx{c} - mn{c}) * 0.16, 0.02), 6) as low_{c}, round(mx{c} + greatest((mx{c} - mn{c}) * 0.16, 0.02), 6) as high_{c}, round((mn{c} + mx{c}) / 2, 6) as mid_{c}" for c in ("lat", "lon")) + """ from (select coalesce(n_name, 'unknown') as country, coalesce(c_mktsegment, 'unknown') as city, count(*) as n, count(lat) as visible, min(lat) as mnlat, max(lat) as mxlat, min(lon) as mnlon, max(lon) as mxlon from
 (select n_name, c_mktsegment, case when c_custkey % 6 > 0 then cast(50 + c_custkey % 100 * 0.01 as double) end as lat, cast(4 + c_custkey % 77 * 0.02 as double) as lon from customer left join nation on c_nationkey = n_nationkey and n_nationkey > 3) x group by 1, 2) y""")(
    lambda t: geo_areas(t.customer.join(t.nation.where("n_nationkey > 3"), C("c_nationkey") == C("n_nationkey"), "left").select(C("n_name").alias("country"), C("c_mktsegment").alias("city"), F.when(C("c_custkey") % 6 > 0, (50 + C("c_custkey") % 100 * 0.01).cast("double")).alias("lat"), (4 + C("c_custkey") % 77 * 0.02).cast("double").alias("lon")), ["country", "city"], "lat", "lon"))
_AREA = R.oracles["MD32_geo_areas"]
R.query("MD32_area_members", f"select a.country, a.city, c_custkey as route_id, low_lat, high_lat, mid_lat, low_lon, high_lon, mid_lon from ({_AREA}) a join (select c_custkey, coalesce(n_name, 'unknown') as country, coalesce(c_mktsegment, 'unknown') as city from customer left join nation on c_nationkey = n_nationkey and n_nationkey > 3) m on m.country = a.country and m.city = a.city")(
    lambda t: geo_areas(t.customer.join(t.nation.where("n_nationkey > 3"), C("c_nationkey") == C("n_nationkey"), "left").select(C("c_custkey").alias("route_id"), C("n_name").alias("country"), C("c_mktsegment").alias("city"), F.when(C("c_custkey") % 6 > 0, (50 + C("c_custkey") % 100 * 0.01).cast("double")).alias("lat"), (4 + C("c_custkey") % 77 * 0.02).cast("double").alias("lon")), ["country", "city"], "lat", "lon", ident="route_id"))
