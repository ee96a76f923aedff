"""Sharding by Karmarkar-Karp differencing into shards of nearly equal bytes.

Groups are equal texts; a group is indivisible. Groups of more than 1 / (BUNDLES * shards) of
all bytes are items of their own, the others go by hash into as many bundles. The driver
differences these items as a whole, a bounded number whatever the table: partial partitions (one
load for each shard) are combined, the two with the largest spread first, oppositely ordered,
until one is left. So light bundles offset heavy groups, and the result is the same for any tasks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, texts_of

SHARDS = 8
#: Bundles of light groups for each shard.
BUNDLES = 1000


def difference(loads: list[tuple[int, ...]], shards: int) -> tuple[list[int], list[np.ndarray]]:
    """Karmarkar-Karp over partial partitions.

    loads: for each, its load by bin. Returns the combined loads, and for each input the
    shard of each of its bins.
    """
    if not loads:
        return [0] * shards, []
    heap, kids, leaf = [], {}, {}
    for i, own in enumerate(loads):
        order = sorted(range(shards), key=lambda b: (-own[b], b))
        ranked = [own[b] for b in order]
        heap.append((ranked[-1] - ranked[0], i, ranked))
        leaf[i] = order
    heapq.heapify(heap)
    nxt = len(loads)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [x[j] + y[-1 - j] for j in range(shards)]
        order = sorted(range(shards), key=lambda j: (-both[j], j))
        ranked = [both[j] for j in order]
        kids[nxt] = (a, b, order)
        heapq.heappush(heap, (ranked[-1] - ranked[0], nxt, ranked))
        nxt += 1
    _, root, ranked = heap[0]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(loads)
    stack = [(root, list(range(shards)))]  # (node, shard of each of its ranked bins)
    while stack:
        node, shard = stack.pop()
        if node < len(loads):
            place = np.empty(shards, np.int64)
            place[leaf[node]] = shard
            out[node] = place
            continue
        a, b, order = kids.pop(node)
        first = [0] * shards
        for rank, j in enumerate(order):
            first[j] = shard[rank]
        stack += [(a, first), (b, [first[shards - 1 - j] for j in range(shards)])]
    return ranked, out


def difference_sizes(sizes: np.ndarray, shards: int) -> tuple[list[int], np.ndarray]:
    """The same for single groups, each with all its load in one bin: the shard of each."""
    empty = [0] * (shards - 1)
    loads, places = difference([(x, *empty) for x in sizes.tolist()], shards)
    return loads, np.array([p[0] for p in places], np.int64)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text plus 1. Rows of equal texts are one group and
    share a shard; null texts are a group of their own, with the size 1 and the checksum 0 of
    no bytes. slot: 0, 1, ... in each shard. An empty table gives no row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def digest(it):
        for batch in it:
            if not batch.num_rows:
                continue
            raw, at = texts_of(batch.column(1))
            raw = memoryview(raw)
            sums = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at) + 1), pa.array(sums), batch.column(2), batch.column(3)], names=["doc_id", "size", "text_crc32", "a", "b"])

    # two 64-bit hashes stand for a text; null is told from empty
    keyed = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text", F.lit(1)).alias("a"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(2), "text")).alias("b")
    ).mapInArrow(digest, "doc_id long, size long, text_crc32 long, a long, b long")
    rows = scratch.table(keyed, "rows")
    groups = scratch.table(rows.groupBy("a", "b").agg(F.sum("size").alias("load")), "groups")
    most = BUNDLES * shards
    limit = (groups.agg(F.sum("load")).first()[0] or 0) / most
    groups = groups.withColumn("bundle", F.pmod("a", F.lit(most)))
    # fewer than `most` groups are heavy, and there are at most so many bundles
    heavy = sorted(tuple(r) for r in groups.where(F.col("load") > limit).select("a", "b", "load").collect())
    light = sorted(tuple(r) for r in groups.where(F.col("load") <= limit).groupBy("bundle").agg(F.sum("load")).collect())
    _, shard = difference_sizes(np.array([r[-1] for r in heavy + light], np.int64), shards)
    alone = spark.createDataFrame([(*r[:2], int(x)) for r, x in zip(heavy, shard)], "a long, b long, own int")
    bundled = spark.createDataFrame([(r[0], int(x)) for r, x in zip(light, shard[len(heavy) :])], "bundle long, shard int")
    where = groups.join(F.broadcast(alone), ["a", "b"], "left").join(F.broadcast(bundled), "bundle", "left").select("a", "b", F.coalesce("own", "shard").alias("shard"))

    def number(it):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in it:
            shard = batch.column(3).to_numpy()
            place = np.empty(len(shard), np.int64)
            for s in range(shards):
                mine = np.flatnonzero(shard == s)
                place[mine] = seen[s] + np.arange(len(mine))
                seen[s] += len(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(place)], names=["doc_id", "size", "text_crc32", "shard", "part", "place"])

    # a hot text is one row on the right; adaptive execution splits its rows on the left
    joined = rows.join(where, ["a", "b"]).select("doc_id", "size", "text_crc32", "shard").mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, part int, place long")
    joined = scratch.table(joined, "joined")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = joined.groupBy("part", "shard").agg(F.count("*").alias("n"))  # one row for each task and shard
    bases = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return joined.join(F.broadcast(bases), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
