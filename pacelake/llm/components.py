"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx


def _contract(batches):
    """Links of one partition to links of each node with the smallest id it reaches there; memory is bounded by the partition."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not found:
        return
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))  # the smallest node known to be reached, as a place
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, least = a[open_], b[open_], np.minimum(x, y)[open_]
        np.minimum.at(low, x[open_], least)
        np.minimum.at(low, y[open_], least)
        while (low[low] != low).any():
            low = low[low]
    moved = low != np.arange(len(nodes))
    yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[moved]), "b": pa.array(nodes[low[moved]])})


#: Links that one task takes; rounds over few links use few tasks.
TASK_LINKS = 100_000


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component) for every id in `links` (a, b): component is the smallest id it can reach. Ids without links aren't in it."""
    edges = tx.cut(links.select("a", "b").mapInArrow(_contract, "a long, b long").distinct())  # a > b: each node with a smaller one
    tasks = tx.tasks_for(edges, TASK_LINKS)
    for _ in range(max_rounds):
        if _is_settled(edges, tasks):
            break
        edges = tx.cut(_small_star(_large_star(edges, tasks), tasks))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().coalesce(tasks))


def _is_settled(edges: DataFrame, tasks: int) -> bool:
    """Whether every node points once and to a node that doesn't point."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    per_node = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).coalesce(tasks)
    return per_node.where("out > 1 or (out = 1 and in = 1)").isEmpty()


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link every larger neighbour of a node with the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "u")
    met = both.join(low, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return met.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, with the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
    moved = edges.join(low, F.col("a") == F.col("u")).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("low").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)
