"""Approximate nearest neighbours with balanced posting lists.

Fit: balanced hierarchical 2-means on a bounded sample gives centroids, each the
head of a posting list. Every vector goes to its nearest centroid and, near a
boundary, to further ones whose distance is within a ratio (and not in the same direction).
Queries find lists by best-first search in an in-memory neighbour graph of centroids
and prune them by distance ratio; candidates are scored exactly on the original
vectors in double precision, in blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: The centroids are fitted to at most so many vectors; every vector is indexed.
FIT_ROWS = 40_000
#: Centroids: at most so many, so that the broadcast is bounded (x dimensions x 4 bytes).
MOST_LISTS = 16_384
LIST_SIZE = 200
REPLICAS = 4
CLOSURE = 1.15
#: A query probes at most PROBES x the root of the number of lists, within the distance ratio PRUNE.
PROBES = 6
PRUNE = 1.8
TOP = 5
#: Rows of a piece of a large list, about.
PIECE_ROWS = 20_000
DEGREE = 24
BLOCK = 4096


def unit_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double) of the vectors that take part: neither null nor zero, all components finite."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.cast(pa.large_list(pa.float64()))
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    valid = lists.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    if dim is not None:
        valid &= size == dim
    rows = np.flatnonzero(valid)
    if not len(rows):
        return rows, np.zeros((0, dim or 0))
    width = dim or int(size[rows[0]])
    rows = rows[size[rows] == width]
    x = flat[at[rows][:, None] + np.arange(width)]
    top = np.abs(x).max(1)
    ok = np.isfinite(x).all(1) & (top > 0)
    rows, x = rows[ok], x[ok] / top[ok, None]  # the largest component first: no overflow, no underflow
    return rows, x / np.sqrt((x * x).sum(1))[:, None]


def balanced_centroids(x: np.ndarray, size: int, most: int, seed: int = 7) -> np.ndarray:
    """Centroids of leaves of at most about `size` rows: each split halves its rows along the line of two means."""
    if not len(x):
        return x.astype(np.float32)
    r = np.random.default_rng(seed)
    size = max(size, -(-len(x) // most))
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        y = x[rows]
        a, b = y[r.choice(len(y), 2, replace=False)]
        for _ in range(8):
            side = y @ (a - b)
            half = side > np.median(side)
            if half.all() or not half.any():
                half = np.arange(len(y)) < len(y) // 2
            a, b = y[half].mean(0), y[~half].mean(0)
        todo += [rows[half], rows[~half]]
    centre = np.stack([x[rows].mean(0) for rows in leaves])
    for _ in range(3):  # a few rounds of spherical means smooth the cuts
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        near = np.concatenate([(x[i : i + BLOCK] @ centre.T).argmax(1) for i in range(0, len(x), BLOCK)])
        total, n = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total, centre)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre.astype(np.float32)


def centroid_graph(centre: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest `degree` centroids of each, plus a ring that keeps the graph in one piece."""
    n = len(centre)
    k = min(degree, max(n - 1, 0))
    out = np.zeros((n, k + 1), np.int32)
    for i in range(0, n, BLOCK):
        s = centre[i : i + BLOCK] @ centre.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        out[i : i + BLOCK, :k] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    out[:, k] = (np.arange(n) + 1) % max(n, 1)
    return out


def search_graph(q: np.ndarray, centre: np.ndarray, graph: np.ndarray, want: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search: about the `want` nearest centroids and their squared distances, nearest first."""
    seen = set(entries.tolist())
    d = 2 - 2 * (centre[entries] @ q)
    frontier = [(float(x), int(e)) for x, e in zip(d, entries)]
    heapq.heapify(frontier)
    best = [(-x, e) for x, e in frontier]
    heapq.heapify(best)
    while len(best) > want:
        heapq.heappop(best)
    while frontier:
        x, e = heapq.heappop(frontier)
        if len(best) >= want and x > -best[0][0]:
            break
        fresh = [n for n in graph[e].tolist() if n not in seen]
        if not fresh:
            continue
        seen.update(fresh)
        for y, n in zip((2 - 2 * (centre[fresh] @ q)).tolist(), fresh):
            if len(best) < want or y < -best[0][0]:
                heapq.heappush(frontier, (y, n))
                heapq.heappush(best, (-y, n))
                if len(best) > want:
                    heapq.heappop(best)
    found = sorted((-x, e) for x, e in best)
    return np.array([e for _, e in found], np.int64), np.array([x for x, _ in found])


def closure(x: np.ndarray, centre: np.ndarray, replicas: int = REPLICAS, ratio: float = CLOSURE) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list of each row, and boundary replicas.

    A further list takes a replica if its squared distance is within `ratio` of the nearest and
    no nearer list of the row lies closer to it than the row does.
    """
    s = x.astype(np.float32) @ centre.T
    k = min(2 * replicas, s.shape[1])
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, near, 1)
    by = np.argsort(-sim, axis=1, kind="stable")
    near, d = np.take_along_axis(near, by, 1), np.maximum(2 - 2 * np.take_along_axis(sim, by, 1), 0)
    keep = np.zeros(near.shape, bool)
    keep[:, 0] = True
    for j in range(1, k):
        ok = (d[:, j] <= ratio * d[:, 0] + 1e-12) & (keep.sum(1) < replicas)
        for i in range(j):
            apart = 2 - 2 * (centre[near[:, i]] * centre[near[:, j]]).sum(1)
            ok &= ~keep[:, i] | (apart >= 0.5 * d[:, j])
        keep[:, j] = ok
    row, col = np.nonzero(keep)
    return row, near[row, col]


def search(vectors: DataFrame, queries, top: int = TOP, fit_rows: int = FIT_ROWS, list_size: int = LIST_SIZE, probes: float = PROBES, prune: float = PRUNE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` nearest found by cosine, nearest first, ties to smaller vec_id.

    vectors: (vec_id, embedding); queries: a condition on vec_id that picks the
    queries, which are searched against all rows but their own. Null, zero and
    non-finite vectors, null ids, and vectors of another length than the first fitted
    take no part. Each row is a candidate of its own, whatever its id and vector, for all queries but
    itself; a query id in several rows is answered for each. An empty table gives no row.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.monotonically_increasing_id().alias("row")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    n = rows.count()
    # what falls under the bound is all that tasks send; ids may repeat, so the row decides
    under = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 40)) < int(min(1.0, fit_rows / max(n, 1)) * (1 << 40))
    fitted = rows.where(under).select("row", "embedding").toArrow().sort_by("row")
    _, sample = unit_rows(fitted["embedding"])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sample.shape[1]
    lists = min(MOST_LISTS, max(1, n // list_size), max(1, len(sample) // 4))
    centre = balanced_centroids(sample, max(4, -(-len(sample) // lists)), MOST_LISTS)
    graph = centroid_graph(centre)
    most = max(32, int(probes * len(centre) ** 0.5))
    # a list that holds much of the sample is cut into pieces, each of which meets all its queries; this sets balance only
    held = np.bincount(np.concatenate([(sample[i : i + BLOCK] @ centre.T).argmax(1) for i in range(0, len(sample), BLOCK)]), minlength=len(centre))
    pieces = np.maximum(1, np.ceil(held / len(sample) * n / PIECE_ROWS)).astype(np.int64)
    shared = spark.sparkContext.broadcast((centre, graph, pieces))  # at most MOST_LISTS rows

    def index(it):
        centre, _, pieces = shared.value
        for batch in it:
            own = batch.column(2).to_numpy()
            at, x = unit_rows(batch.column(1), dim)
            for i in range(0, len(at), BLOCK):
                row, to = closure(x[i : i + BLOCK], centre)
                from_ = pa.array(at[i : i + BLOCK][row])
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array((own[from_] % pieces[to]).astype(np.int32)), *(batch.column(c).take(from_) for c in (2, 0, 1))], names=["list", "piece", "row", "vec_id", "embedding"])

    def probe(it):
        centre, graph, pieces = shared.value
        entries = np.unique(np.linspace(0, len(centre) - 1, 16).astype(np.int64))
        for batch in it:
            at, x = unit_rows(batch.column(1), dim)
            query, to = [], []
            for r, q in zip(at.tolist(), x):
                found, d = search_graph(q.astype(np.float32), centre, graph, most, entries)
                ok = d <= prune * max(d[0], 1e-12) + 1e-12
                ok[: min(8, len(ok))] = True  # never fewer than a few lists
                to.append(found[ok])
                query.append(np.full(ok.sum(), r))
            if query:
                query, to = np.concatenate(query), np.concatenate(to)
                m = pieces[to]
                piece = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                from_ = pa.array(np.repeat(query, m))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(to, m).astype(np.int32)), pa.array(piece.astype(np.int32)), *(batch.column(c).take(from_) for c in (2, 0, 1))], names=["list", "piece", "asker", "query_id", "query"])

    posted = rows.mapInArrow(index, f"list int, piece int, row long, vec_id long, embedding {kind}")
    asked = rows.where(queries).mapInArrow(probe, f"list int, piece int, asker long, query_id long, query {kind}")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["asker", "query_id", "row", "vec_id", "score"]
        empty = pa.table([*[pa.array([], pa.int64())] * 4, pa.array([], pa.float64())], names=names)
        if not left.num_rows or not right.num_rows:
            return empty
        at, x = unit_rows(left["embedding"], dim)
        by, q = unit_rows(right["query"], dim)
        ids, own, queries, askers, out = left["vec_id"].to_numpy()[at], left["row"].to_numpy()[at], right["query_id"].to_numpy()[by], right["asker"].to_numpy()[by], []
        for i in range(0, len(q), 64):
            best: list[list] = [[] for _ in q[i : i + 64]]
            for j in range(0, len(x), BLOCK):
                s = q[i : i + 64] @ x[j : j + BLOCK].T
                s[askers[i : i + 64, None] == own[None, j : j + BLOCK]] = -np.inf
                k = min(top, s.shape[1])
                floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                r, c = np.nonzero((s >= floor[:, None] - 1e-12) & np.isfinite(s))
                for a, b in zip(r.tolist(), c.tolist()):
                    best[a].append((j + b))
            for a, found in enumerate(best):
                if found:
                    found = np.array(found)
                    v = (x[found] * q[i + a]).sum(1)
                    # ties are kept whole: the final rank settles them
                    cut = np.sort(v)[::-1][min(top, len(v)) - 1]
                    found, v = found[v >= cut - 1e-12], v[v >= cut - 1e-12]
                    out.append((np.full(len(found), askers[i + a]), np.full(len(found), queries[i + a]), own[found], ids[found], v))
        if not out:
            return empty
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    found = posted.groupBy("list", "piece").cogroup(asked.groupBy("list", "piece")).applyInArrow(score, "asker long, query_id long, row long, vec_id long, score double")
    found = scratch.table(found, "found").dropDuplicates(["asker", "row"])  # a replica is found in several lists
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
