"""Dependency levels of graphs that may not fit one task: peeling wave by wave.

A node's level is the wave in which it is free of predecessors; nodes in or behind
a cycle have none. Each wave takes free nodes away and counts down what they free,
so a round reads each edge once. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.sources.scratch import forget, written


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(graph, node, name, is_main, level) from nodes (graph, node, name) and edges (graph, src, dst); `main` comes first and frees its own. More than `most` waves are an error."""
    spark = nodes.sparkSession
    first = Window.partitionBy("graph").orderBy("node")
    own = nodes.withColumn("is_main", (F.col("name") == "main") & (F.row_number().over(first.partitionBy("graph", "name")) == 1))
    live = edges.where("src <> dst").distinct()
    mains = own.where("is_main").select("graph", F.col("node").alias("src"))
    live = live.join(mains, ["graph", "src"], "left_anti").join(mains.withColumnRenamed("src", "dst"), ["graph", "dst"], "left_anti").select("graph", "src", "dst")
    left = own.where("not is_main").select("graph", "node")
    done: list[DataFrame] = []
    for wave in itertools.count():
        free = left.join(live.select("graph", F.col("dst").alias("node")).distinct(), ["graph", "node"], "left_anti").withColumn("level", F.lit(wave))
        free = written(spark, free)
        if free.isEmpty():
            break
        if wave == most:
            raise ValueError(f"more than {most} waves")
        done.append(free)
        taken, old = free.select("graph", "node"), (left, live)
        left = written(spark, left.join(taken, ["graph", "node"], "left_anti"))
        live = written(spark, live.join(taken.withColumnRenamed("node", "src"), ["graph", "src"], "left_anti").select("graph", "src", "dst"))
        for df in old:
            forget(df)
    found = done[0] if done else left.withColumn("level", F.lit(0)).limit(0)
    for more in done[1:]:
        found = found.unionByName(more)
    return own.join(found, ["graph", "node"], "left").select("graph", "node", "name", "is_main", "level")


def toposorted(leveled: DataFrame) -> DataFrame:
    """With `out_pos` from 0: main, then levels, names by bytes, nodes of cycles last."""
    order = Window.partitionBy("graph").orderBy(F.desc("is_main"), F.col("level").isNull(), "level", "name", "node")
    return leveled.withColumn("out_pos", F.row_number().over(order) - 1)


def toposorted_whole(nodes: DataFrame, edges: DataFrame, alphabetical: bool = True) -> DataFrame:
    """The same rows as toposorted(levels(...)) of graphs that fit a task each, one task a graph and one shuffle in all.

    alphabetical: a wave goes by names; else it keeps the order of nodes.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node")
        node, name = left["node"].to_pylist(), left["name"].to_pylist()
        at = {n: i for i, n in enumerate(node)}
        main = name.index("main") if "main" in name else -1
        need, out_of = [0] * len(node), [[] for _ in node]
        for a, b in {(a, b) for a, b in zip(right["src"].to_pylist(), right["dst"].to_pylist()) if a != b and a in at and b in at}:
            if main not in (at[a], at[b]):
                out_of[at[a]].append(at[b])
                need[at[b]] += 1
        level: list[int | None] = [None] * len(node)
        wave, free = 0, [i for i, n in enumerate(need) if n == 0 and i != main]
        while free:
            nxt = []
            for i in free:
                level[i] = wave
                for b in out_of[i]:
                    need[b] -= 1
                    if need[b] == 0:
                        nxt.append(b)
            wave, free = wave + 1, nxt
        rank = lambda i: (i != main, level[i] is None, level[i] or 0, (name[i] or "").encode() if alphabetical else b"", node[i])
        out_pos = [0] * len(node)
        for place, i in enumerate(sorted(range(len(node)), key=rank)):
            out_pos[i] = place
        return pa.table([left["graph"], left["node"], left["name"], pa.array([i == main for i in range(len(node))]), pa.array(level, pa.int32()), pa.array(out_pos, pa.int32())], names=["graph", "node", "name", "is_main", "level", "out_pos"])

    own = nodes.select(F.col("graph").cast("string").alias("key"), "graph", "node", "name")
    ends = edges.select(F.col("graph").cast("string").alias("key"), "src", "dst")
    out = T.StructType([*nodes.select("graph", "node", "name").schema.fields, *T.StructType.fromDDL("is_main boolean, level int, out_pos int").fields])
    return own.groupBy("key").cogroup(ends.groupBy("key")).applyInArrow(run, out)
