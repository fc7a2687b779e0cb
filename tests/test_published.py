"""Publications behind manifests, tables rewritten by ranges, fingerprint trees, and the newest row of a stream."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pacelake.sources import published as P
from pacelake.sources.ingest import keyed_replace, merge_labels
from pacelake.streaming import replace


class Stop(Exception):
    pass


def seen(spark, root):
    return {n: sorted(map(tuple, df.collect())) for n, df in P.published(spark, root).items()}


def test_exports_are_swapped_together(spark, tmp_path):
    root = str(tmp_path / "exports")
    old = {"a": spark.range(5).toDF("x"), "b": spark.range(7).toDF("y"), "c": spark.range(2).toDF("z")}
    P.publish(old, root)
    before = seen(spark, root)
    fresh = {"a": spark.range(3).toDF("x"), "b": spark.range(9).toDF("y")}
    steps = []
    for at in range(4):  # a stop after each step before the last one leaves all as it was
        count = iter(range(99))

        def stop(name, at=at, count=count):
            steps.append(name)
            if next(count) == at:
                raise Stop

        with pytest.raises(Stop):
            P.publish(fresh, root, step=stop)
        assert seen(spark, root) == before
    P.publish(fresh, root, step=steps.append)
    assert steps[-1] == "published"
    after = seen(spark, root)
    assert (len(after["a"]), len(after["b"]), after["c"]) == (3, 9, before["c"])
    assert {n: sorted(map(tuple, df.collect())) for n, df in P.published(spark, root, 1).items()} == before


def test_promised_columns_and_second_writers(spark, tmp_path):
    root = str(tmp_path / "exports")
    with pytest.raises(ValueError):
        P.publish({"a": spark.range(2).toDF("x")}, root, {"a": ["y"]})
    assert P.published(spark, root) == {}
    old = P.manifest(spark, root)
    P.publish({"a": spark.range(2).toDF("x")}, root)
    with pytest.raises(RuntimeError):  # begun before the other one was published
        P.commit(spark, root, old, {})
    for k in range(4):
        P.publish({"a": spark.range(k).toDF("x")}, root)
    assert P.versions(spark, root) == [4, 5] and len(glob.glob(f"{root}/data/a-*")) == 2


def files_of(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("combine", [keyed_replace, merge_labels])
def test_only_touched_ranges_are_written(spark, tmp_path, combine):
    root = str(tmp_path / "table")
    rows = spark.createDataFrame([(k // 2, k % 2, f"v{k}") for k in range(2000)] + [(None, 5, "null")], "k long, n int, v string")
    if combine is merge_labels:
        rows = rows.where("n = 0").drop("n")
    P.create(rows, root, "k", 10)
    assert sorted(map(repr, P.table(spark, root).collect())) == sorted(map(repr, rows.collect()))
    before = files_of(root)
    incoming = rows.where("k between 300 and 350").withColumn("v", F.lit("new")).unionByName(rows.where("k = 351").withColumn("k", F.lit(-4).cast("long")))
    P.rewrite(incoming, root, ["k"], combine)
    want = combine(rows, incoming, ["k"])
    assert sorted(map(repr, P.table(spark, root).collect())) == sorted(map(repr, want.collect()))
    kept = {f.removeprefix(root) for p in P.manifest(spark, root)["parts"].values() for f in glob.glob(f"{root}/{p['folder']}/*.parquet")}
    untouched = [f for f in before if f.removeprefix(root) in kept]
    assert len(untouched) >= 7 and all(os.stat(f).st_mtime_ns == before[f] for f in untouched)
    P.rewrite(incoming, root, ["k"], combine)  # again: the same rows
    assert sorted(map(repr, P.table(spark, root).collect())) == sorted(map(repr, want.collect()))
    version = P.manifest(spark, root)["version"]
    P.rewrite(incoming.where("false"), root, ["k"], combine)
    assert P.manifest(spark, root)["version"] == version


def test_fingerprint_tree_shows_the_changed_partition(spark):
    rows = spark.createDataFrame([(k, None if k % 9 == 0 else f"d{k % 5}", f"v{k}") for k in range(300)], "k int, d string, v string")
    tree = P.fingerprint_tree(rows.repartition(7), "d", ["k", "v"])
    same = P.fingerprint_tree(rows.repartition(2).orderBy("v"), "d", ["k", "v"])
    assert sorted(map(repr, tree.collect())) == sorted(map(repr, same.collect()))
    assert P.partition_plan(tree, same).count() == 0 and P.partition_plan(tree, same, force=True).count() == 6
    changed = P.fingerprint_tree(rows.where("d is null or d != 'd4'").withColumn("v", F.when(F.col("k") == 7, None).otherwise(F.col("v"))), "d", ["k", "v"])
    assert {tuple(r) for r in P.partition_plan(changed, tree).collect()} == {("d2", "publish"), ("d4", "drop")}
    empty = P.fingerprint_tree(rows.where("false"), "d", ["k", "v"]).collect()
    assert [tuple(r) for r in empty] == [(None, 0, None)]


def test_latest_row_over_many_batches(spark, tmp_path):
    """Late rows within the delay count, rows behind the watermark don't, and a repeated key starts anew after its state went."""
    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    batches = [
        [("a", 1, at(0), 1.0), ("a", 2, at(3), 2.0), ("b", 3, at(1), 3.0)],
        [("a", 4, at(2), 4.0), ("b", 5, at(1), 5.0), ("c", 6, at(20), 6.0)],  # a: late and older; b: same time, later id
        [("a", 7, at(12), 7.0), ("d", 8, at(11), 8.0), ("c", 9, at(40), 9.0)],  # late, within ten hours of hour 20
        [("e", 10, at(5), 10.0), ("a", 11, at(6), 11.0), ("c", 12, at(39), 12.0)],  # behind hour 30: left out, but for c
        [("a", 13, at(60), 13.0), ("b", 14, at(41), 14.0), (None, 15, at(50), 15.0), ("z", 16, None, 16.0)],
        [("b", 17, at(52), 17.0), ("a", 18, at(55), 18.0)],
    ]
    schema, place = "k string, id long, t timestamp, v double", str(tmp_path / "in")
    os.makedirs(place)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
        replace.stream_latest(source, ["k"], "t", "id", "10 hours", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.k: r.id for r in replace.latest_rows(spark, str(tmp_path / "out"), spark.createDataFrame([], schema).schema, ["k"], "t", "id").collect()}
    assert got == {"a": 13, "b": 17, "c": 9, "d": 8, None: 15}
    written = sum(spark.read.parquet(f).count() for f in glob.glob(str(tmp_path / "out" / "batch=*")) if glob.glob(f + "/*.parquet"))
    assert written == 11  # rows that beat nothing aren't written
