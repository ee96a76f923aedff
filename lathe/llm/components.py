"""Connected components by distributed union-find.

Each round, every task unites the edges it holds with a local union-find and keeps one
edge to the root for each node (a spanning forest). Roots hook onto their smallest
neighbour and pointers jump until they are stars; edges then move to the roots.
Edges shrink each round; no node's edges have to meet in one task, since only
minima (combined before the shuffle) are taken by node.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: A forest of at most so many edges is finished by one task; a larger one goes by rounds.
ONE_TASK = 400_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) of edges, by vectorised hooking and jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        live = px != py
        if not live.any():
            return nodes, nodes[parent]
        x, y = x[live], y[live]
        hi, lo = np.maximum(px[live], py[live]), np.minimum(px[live], py[live])
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(edges: DataFrame) -> DataFrame:
    def run(it):
        batches = [b for b in it if b.num_rows]
        if batches:
            t = pa.Table.from_batches(batches)
            node, root = roots(t.column(0).to_numpy(), t.column(1).to_numpy())
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for each node of an edge (u, v) between two nodes; root is the smallest node of its component. Self-edges and repeated edges are fine."""
    spark = edges.sparkSession
    live = scratch.table(_forest(edges.select("u", "v")), f"{name}-0")
    maps: list[DataFrame] = []
    for i in itertools.count(1):  # every root with an edge hooks, so each round at least halves the roots
        edges_left = live.count()
        if not edges_left:
            break
        if edges_left <= ONE_TASK:
            maps.append(scratch.table(_forest(live.coalesce(1)).select(F.col("u").alias("node"), F.col("v").alias("root")), f"{name}-last"))
            break
        # every node with a smaller neighbour hooks onto its smallest
        hook = live.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        hook = scratch.table(hook, f"{name}-hook-{i}")
        jump = 0
        while True:  # pointer jumping to stars
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            nxt = scratch.table(hook.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("top").isNotNull()).alias("moved")), f"{name}-jump-{i}-{jump}")
            moved = not nxt.where("moved").isEmpty()
            hook, jump = nxt.select("node", "root"), jump + 1
            if not moved:
                break
        maps.append(hook)
        star = hook.withColumnRenamed("node", "at")
        edge = live
        for c in ("u", "v"):
            edge = edge.join(star.select(F.col("at").alias(c), F.col("root").alias("__r")), c, "left").withColumn(c, F.coalesce("__r", c)).drop("__r")
        live = scratch.table(_forest(edge.where("u <> v").select("u", "v").distinct()), f"{name}-{i}")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    # later rounds map earlier roots on
    out = maps[-1]
    for hook in reversed(maps[:-1]):
        late = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = out.unionByName(hook.join(late, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
    own = out.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return scratch.table(out.unionByName(own), name)
