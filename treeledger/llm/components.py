"""Connected components of a distributed edge list.

Edges are dealt to tasks by their larger end (the smaller one of a star would be one key); each task replaces its edges by
stars around its least nodes (union-find over a bounded number of edges). Alternating large-star and small-star steps then join the tasks' stars, until every node has
one edge to a centre that has none. The same steps run at every size; few edges need fewer tasks and rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Edges (16 bytes each) that one task contracts.
EDGES_PER_TASK = 1 << 14


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every neighbour (large: those above the node; small: those below, and the node) is tied to the least of them."""
    both = edges.select(F.col("u"), F.col("v"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _contracted(batches):
    """The edges as stars: node, least node that the task's edges connect it with. Held in pieces of bounded size."""
    node: dict[int, int] = {}

    def root(i: int) -> int:
        node.setdefault(i, i)
        while node[i] != i:
            node[i] = node[node[i]]
            i = node[i]
        return i

    def stars() -> pa.RecordBatch:
        ids = [i for i in node if root(i) != i]
        out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], names=["u", "v"])
        node.clear()
        return out

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            node[max(a, b)] = min(a, b)
        if len(node) > 64 * EDGES_PER_TASK:  # a node with very many edges
            yield stars()
    yield stars()


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two edges down, or both an edge down and one up."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """id, label: the least id reachable, for every id that has an edge (u, v) to another."""
    told = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    tasks = max(1, -(-told.count() // per_task))
    now = written(told.repartition(tasks, "u").mapInArrow(_contracted, "u long, v long"), "edges")
    while _unfinished(now):
        now = written(_star(_star(now, True), False), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
