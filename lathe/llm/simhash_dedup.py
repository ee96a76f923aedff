"""Near duplicates by SimHash, searched with a May-Ozerov recursion.

A fingerprint has 256 bits: 128 over a text's distinct words, 128 over its distinct
pairs of neighbouring words. Two fingerprints are linked if they differ in at most LIMIT
bits. Search: on a strip of random coordinates, the partial weight of the
difference to each possible centre filters fingerprints into lists (weight 0: the
lists of a strip partition the fingerprints). Lists recurse on further random
strips until they are small, then they are compared by brute force. Strips are
repeated at each level until a pair at LIMIT is met with probability RECALL;
closer pairs are met more surely. What a list has shown to be of one class is compared
no more in it, and a list gives a tree for each class, so that a class that grows with the table
costs neither its pairs in each strip nor rows for them. The links of each row are counted
afterwards, within its class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .passages import word_tokens
from .shared import Scratch, mix, release, texts_of, unused

BITS = 256
LIMIT = 58
RECALL = 0.99
#: Lists of at most so many fingerprints are compared by brute force.
SMALL = 192
#: Rows of a long list that are compared with all others before pairs are.
HUBS = 4
#: Lists of the first strips have about so many.
FIRST_LIST = 200_000
#: A task takes no longer list than this; longer ones recurse over the cluster, DEPTH times, and then go by pairs of blocks.
MOST_LIST = 600_000
#: With fewer lists than TASKS, several tasks share a list's strips, one for each SHARE of all fingerprints at most.
TASKS, SHARE = 12, 8000
#: Members of small classes whose links one task counts, and the block of a larger class.
PART, BLOCK = 100_000, 16_000
DEPTH = 4
PIECE = 1 << 20
#: Chance that unrelated texts agree in a coordinate; it sets how fast lists shrink, not what is found.
AGREE = 0.6

_SIGNS = 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) - 1


def _sums(features: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Signed bit sums (n x 128) of 64-bit features and their second hash."""
    out = np.zeros((n, 128), np.float32)
    for half, x in enumerate((features, mix(features + np.uint64(0x5851F42D4C957F2D)))):
        octets = x.view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts = np.bincount(doc * 256 + octets[:, i], minlength=n * 256).reshape(n, 256)
            out[:, 64 * half + 8 * i : 64 * half + 8 * i + 8] = counts.astype(np.float32) @ _SIGNS
    return out


def _distinct(features: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, doc))
    f, d = features[order], doc[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    return f[new], d[new]


def fingerprints(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 words of 64 bits, number of words of each text)."""
    n = len(at) - 1
    words, _, _, bounds = word_tokens(raw.tobytes(), at)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(n), size)
    joined = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[joined] if len(words) else words
    pair_doc = doc[1:][joined] if len(words) else doc
    alone = np.flatnonzero(size == 1)
    pairs, pair_doc = np.concatenate([pairs, mix(words[bounds[alone]])]), np.concatenate([pair_doc, alone])
    sums = np.concatenate([_sums(*_distinct(words, doc), n), _sums(*_distinct(pairs, pair_doc), n)], axis=1)
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(n, 4), size


def _print_texts(docs: DataFrame) -> DataFrame:
    def run(it):
        for batch in it:
            raw, at = texts_of(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = min(max(int(np.searchsorted(at, at[first] + PIECE)), first + 1), batch.num_rows)
                f, size = fingerprints(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(size), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(4))], names=["doc_id", "a", "b", "n_words", "f0", "f1", "f2", "f3"])
                first = last

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.xxhash64("text", F.lit(1)).alias("a"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(2), "text")).alias("b")
    )
    return keyed.mapInArrow(run, "doc_id long, a long, b long, n_words long, f0 long, f1 long, f2 long, f3 long")


def strips(seed: int, count: int, bits: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.stack([r.permutation(BITS)[:bits] for _ in range(count)]) if count else np.zeros((0, bits), int)


def strip_values(f: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
    """The fingerprint's bits on the strip: the centre at which its partial weight is 0."""
    out = np.zeros(len(f), np.int64)
    for c in coordinates.tolist():
        out = (out << 1) | ((f[:, c // 64] >> np.uint64(c % 64)) & np.uint64(1)).astype(np.int64)
    return out


def repeats(bits: int, recall: float, inner: float = 1.0) -> int:
    """How many strips until a pair at LIMIT agrees on one with this probability."""
    meet = inner * (1 - LIMIT / BITS) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def close(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) differ in at most LIMIT bits (f: 4 x n); word pairs first, as they tell texts apart best."""
    d = np.bitwise_count(f[2][a] ^ f[2][b]) + np.bitwise_count(f[3][a] ^ f[3][b])
    out = np.flatnonzero(d <= LIMIT)
    x, y = a[out], b[out]
    rest = np.bitwise_count(f[0][x] ^ f[0][y]).astype(np.int32) + np.bitwise_count(f[1][x] ^ f[1][y])
    return out[d[out] + rest <= LIMIT]


def united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each class) after x and y are linked."""
    nodes, root = roots(label[x], label[y])
    to = np.arange(len(label))
    to[nodes] = root
    return to[label]


def short_lists(f: np.ndarray, label: np.ndarray, rows: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of different classes, all lists at once (end: where each row's list ends): each row against the s-th after it."""
    f, label = f[:, rows], label[rows]
    found, at, s = [np.zeros((2, 0), np.int64)], np.arange(len(rows)), 1
    while True:
        at = at[at + s < end[at]]
        if not len(at):
            return tuple(rows[np.concatenate(found, 1)])
        for i in range(0, len(at), 1 << 16):
            x = at[i : i + (1 << 16)]
            x = x[close(f, x, x + s)]
            found.append(np.stack([x, x + s])[:, label[x] != label[x + s]])
        s += 1


def long_list(f: np.ndarray, label: np.ndarray, most: float) -> tuple[np.ndarray, bool]:
    """(label after links were looked for, whether all were compared) of one list: a few rows against all others first, then all pairs of different classes, unless there are more than `most`."""
    n, every = len(label), np.arange(len(label))
    for t in range(HUBS):
        if (label == label[0]).all():
            return label, True
        hub = np.full(n, (2 * t + 1) * n // (2 * HUBS))
        hit = close(f, every, hub)
        label = united(label, every[hit], hub[hit])
    order = np.argsort(label, kind="stable")
    own = label[order]
    first = np.searchsorted(own, own, "right")  # rows after a row's class are of others
    total = np.concatenate([[0], np.cumsum(n - first)])
    if total[-1] > most:
        return label, False
    f, links, x = f[:, order], [], 0
    while x < n:
        y = max(x + 1, int(np.searchsorted(total, total[x] + (1 << 20), "right")) - 1)
        a = np.repeat(np.arange(x, y), n - first[x:y])
        b = first[a] + np.arange(total[x], total[y]) - total[a]
        hit = close(f, a, b)
        links.append(np.stack([a[hit], b[hit]]))
        x = y
    return united(label, *order[np.concatenate(links, 1)]), True


def strip_bits(f: np.ndarray, seed: int) -> int:
    """Bits of a strip at which lists of these rows are short: measured on a few strips."""
    n = f.shape[1]
    tried = [strip_values(f.T, c) for c in strips(seed, 3, 16)]
    for bits in range(2, 16):
        meet = 0.0
        for value in tried:
            size = np.bincount(value >> (16 - bits))
            meet += (size * np.minimum(size, SMALL)).sum() / n
        if meet / len(tried) <= SMALL / 6:
            break
    return bits


def joined(f: np.ndarray, label: np.ndarray, seed: int, recall: float = 0.97, depth: int = 0, share: int = 0, shares: int = 1) -> np.ndarray:
    """Classes of a list's rows (f: 4 x n) in which a pair at LIMIT is met with this probability.

    label: the class of each row, as known before, by its smallest row. What is known to be of one class is
    compared no more. Of several shares of the work each takes its strips.
    """
    n = len(label)
    if n <= SMALL or depth > 5:
        return long_list(f, label, math.inf)[0] if share == 0 else label
    bits = strip_bits(f, seed)
    for k, coordinates in enumerate(strips(seed + 7919 * (depth + 1), repeats(bits, recall), bits)):
        if k % shares != share:
            continue
        value = strip_values(f.T, coordinates).astype(np.uint16)
        rows = np.argsort(value, kind="stable")  # by radix
        value = value[rows]
        cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        size, own = np.diff(cut), label[rows]
        mixed = np.minimum.reduceat(own, cut[:-1]) < np.maximum.reduceat(own, cut[:-1])
        for i in np.flatnonzero(mixed & (size > SMALL)).tolist():
            part = np.sort(rows[cut[i] : cut[i + 1]])
            _, first, known = np.unique(label[part], return_index=True, return_inverse=True)
            alike = size[i] > 0.9 * n  # strips don't split it
            inner, over = long_list(f[:, part], first[known], math.inf if alike else 32 * SMALL * SMALL)
            if not over:
                inner = joined(f[:, part], inner, seed + k, 0.97, depth + 1)
            label = united(label, part, part[inner])
            if alike:
                return label
        some = mixed & (size <= SMALL)
        keep = np.repeat(some, size)
        end = np.repeat(np.cumsum(size[some]), size[some])
        x, y = short_lists(f, label, rows[keep], end)
        if len(x):
            label = united(label, x, y)
    return label


def links_within(f: np.ndarray, weight: np.ndarray, key: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Weight of the rows linked to each row among those of equal key (sorted); with sides, of the other side only."""
    out = np.zeros(len(key), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    small = size <= SMALL if side is None else np.zeros(len(size), bool)
    rows, end = np.flatnonzero(np.repeat(small, size)), np.repeat(np.cumsum(size[small]), size[small])
    x, y = short_lists(f, np.arange(len(key)), rows, end)
    np.add.at(out, x, weight[y])
    np.add.at(out, y, weight[x])
    for i in np.flatnonzero(~small).tolist():
        a, b = cut[i], cut[i + 1]
        for x in range(a, b, 64):
            y = min(x + 64, b)
            half = [np.bitwise_count(f[w][x:y, None] ^ f[w][None, x:b]) + np.bitwise_count(f[w + 1][x:y, None] ^ f[w + 1][None, x:b]) for w in (0, 2)]
            near = half[0].astype(np.uint16) + half[1] <= LIMIT
            near &= np.arange(x, b)[None] > np.arange(x, y)[:, None]
            if side is not None:
                near &= side[x:y, None] != side[None, x:b]
            out[x:y] += near @ weight[x:b]
            out[x:b] += weight[x:y] @ near
    return out


ROW = "list long, id long, f0 long, f1 long, f2 long, f3 long"


def _spread(rows: DataFrame, coordinates: np.ndarray) -> DataFrame:
    """Each row of a list (ROW) in one list of each strip."""

    def run(it):
        for batch in it:
            f = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(2, 6)], 1)
            old = batch.column(0).to_numpy().view(np.uint64)
            for k, strip in enumerate(coordinates):
                new = mix(old + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64) + mix(strip_values(f, strip).astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), *batch.columns[1:]], names=["list", "id", "f0", "f1", "f2", "f3"])

    return rows.mapInArrow(run, ROW)


def _ids_and_prints(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    group = group.sort_by("id")
    return group["id"].to_numpy(), np.stack([group[f"f{i}"].to_numpy().view(np.uint64) for i in range(4)])


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    far = np.flatnonzero(label != np.arange(len(label)))
    return pa.table([pa.array(ids[far]), pa.array(ids[label[far]])], names=["u", "v"])


def _searched(rows: DataFrame, recall: float, shares: int) -> DataFrame:
    """(u, v) that connect each class found in a list; `shares` tasks have a list, each a part of the strips."""

    def run(group: pa.Table) -> pa.Table:
        ids, f = _ids_and_prints(group)
        label = joined(f, np.arange(len(ids)), abs(group["list"][0].as_py()) % 2**31, recall, 0, group["share"][0].as_py(), shares)
        release()
        return _edges(ids, label)

    return rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).groupBy("list", "share").applyInArrow(run, "u long, v long")


def _block_pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lists that no strip splits, whole: each pair of their blocks is one group."""
    blocks = F.ceil(F.col("count") / MOST_LIST).cast("int")
    own = rows.join(sizes, "list").withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("list", "id", "f0", "f1", "f2", "f3", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        ids, f = _ids_and_prints(group)
        return _edges(ids, long_list(f, np.arange(len(ids)), math.inf)[0])

    return paired.groupBy("list", "i", "j").applyInArrow(run, "u long, v long")


def linked(prints: DataFrame, scratch: Scratch, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(u, v) that connect the classes of distinct fingerprints (id, f0..f3): for each list and class one link fewer than it has rows, whatever the pairs."""
    n = prints.count()
    rows = prints.select(F.lit(0).cast("long").alias("list"), "id", "f0", "f1", "f2", "f3")
    bits = max(0, round(math.log(max(n, 1) / FIRST_LIST) / -math.log(AGREE)))
    found, depth, strips_of_all = [], 0, repeats(bits, recall, 0.97) if bits else 1
    if bits:
        rows = _spread(rows, strips(seed, strips_of_all, bits))
    shares = max(1, min(math.ceil(TASKS / strips_of_all / 2**bits), n // SHARE))
    while True:
        inner = 0.97 if bits or depth else recall
        sizes = scratch.table(rows.groupBy("list").count().where(F.col("count") > MOST_LIST), f"large-{depth}")
        if sizes.isEmpty():
            found.append(_searched(rows, inner, shares))
            break
        found.append(_searched(rows.join(sizes, "list", "left_anti"), inner, shares))
        rows = scratch.table(rows.join(sizes, "list", "left_semi"), f"rows-{depth}")
        depth += 1
        if depth > DEPTH:
            found.append(_block_pairs(rows, sizes))
            break
        rows = _spread(rows, strips(seed + depth, repeats(4, 0.97), 4))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return scratch.table(every, "links")


def degrees(prints: DataFrame, roots_: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, far): texts of the other fingerprints to which each is linked. Linked ones are of one class, so that each class is compared whole; pairs are counted where they are met."""
    members = scratch.table(prints.join(roots_.withColumnRenamed("node", "id"), "id"), "members")
    parts = max(1, members.count() // PART)
    large = scratch.table(members.groupBy("root").count().where(F.col("count") > BLOCK), "large-classes")
    columns = ["part", "i", "j", "side", "root", "id", "n_texts", "f0", "f1", "f2", "f3"]
    none = F.lit(-1)
    whole = members.join(large, "root", "left_anti").withColumn("part", F.pmod(F.xxhash64("root"), F.lit(parts))).withColumns({"i": none, "j": none, "side": none})
    own = members.join(large, "root").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    blocks = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"part": F.col("root"), "i": F.least("side", "other"), "j": F.greatest("side", "other")})

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("root")
        f = np.stack([group[f"f{i}"].to_numpy().view(np.uint64) for i in range(4)])
        side = group["side"].to_numpy() if group["i"][0].as_py() != group["j"][0].as_py() else None
        far = links_within(f, group["n_texts"].to_numpy(), group["root"].to_numpy(), side)
        release()
        return pa.table([group["id"].combine_chunks(), pa.array(far)], names=["id", "far"])

    counted = whole.select(*columns).unionByName(blocks.select(*columns)).groupBy("part", "i", "j").applyInArrow(run, "id long, far long")
    return counted.groupBy("id").agg(F.sum("far").alias("far"))


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each document.

    class_id: the smallest doc_id of its class of linked and equal texts. n_links: other
    texts to which its text is linked (all within its class, met in a strip or not). n_copies: rows with an equal text. A text
    without words, or null, is only in a class with its equals; nulls are equal. Null ids
    name no class (class_id is null where all are null). An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_print_texts(docs.select("doc_id", "text")), "rows")
    f = ["f0", "f1", "f2", "f3"]
    texts = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("n_words").alias("n_words"), *(F.first(x).alias(x) for x in f))
    texts = scratch.table(texts, "texts")
    worded = texts.where("n_words > 0")
    # texts of one fingerprint are linked; one of their hashes is the node that stands for them
    prints = scratch.table(worded.groupBy(*f).agg(F.min("a").alias("id"), F.count("*").alias("n_texts")), "prints")
    links = linked(prints, scratch, recall)
    roots_of_all = components(links, scratch)
    degree = degrees(prints, roots_of_all, scratch)
    known = prints.join(degree, "id", "left").join(roots_of_all.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(*f, F.coalesce("root", "id").alias("root"), (F.coalesce("far", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"))
    placed = worded.join(known, f).select("a", "b", "first", "n_copies", "root", "n_links")
    placed = scratch.table(placed.unionByName(texts.where("n_words = 0").select("a", "b", "first", "n_copies", F.col("a").alias("root"), F.lit(0).cast("long").alias("n_links"))), "placed")
    scratch.keep_only("rows", "placed")
    names = placed.groupBy("root").agg(F.min("first").alias("class_id"))
    return rows.select("doc_id", "a", "b").join(placed.join(names, "root"), ["a", "b"]).select("doc_id", "class_id", "n_links", "n_copies")


def kept(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents, with all their columns, without those that are not the smallest id of their class. Rows with a null id stay."""
    own = unused(docs, "gone")
    gone = classes(docs, recall).where("doc_id <> class_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[own], "left_anti")
