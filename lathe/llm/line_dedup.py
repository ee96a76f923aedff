"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

1. Every batch of documents sends, for each distinct line, its band keys (packed by range)
   and its hash. Ranges answer in bits: the line comes earlier elsewhere; a band is
   shared by another line.
2. First copies of lines with a shared band send a sketch to each shared band. In
   a band, lines whose sketches agree well are joined (a spanning forest leaves the task).
   Components of these candidates bring together all lines that may be alike.
3. Within a candidate component the shingle sets decide: lines of exact
   Jaccard similarity THRESHOLD or more are linked. Components larger than BLOCK meet by
   pairs of blocks. Union-find over the links gives the classes; the first line stays.

Signatures are one-permutation MinHash (one hash for each shingle, the smallest in each
of BINS bins) with empty bins filled from others by a fixed rule.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .passages import ANSWER, TABLE, _delta, _pack, _unpack, powers, prefix, range_of
from .shared import Scratch, mix, pack_batches, release, unpack

#: 8 bytes are one 64-bit word, so that sets of shingles are exact.
SHINGLE = 8
BINS = 64
ROWS = 4
BANDS = BINS // ROWS
THRESHOLD = 0.75
#: Sketches may fall short of the threshold by this before a pair is left out (four standard deviations).
MARGIN = 0.22
RANGE_ENTRIES = 600_000
BLOCK = 3000
SLICE = 1 << 18
#: Ranges of the candidate bands and of candidate components; more for more lines.
LINES_PER_TASK = 60_000


class Lines:
    """The lines of a batch; equal lines are one group. Blank lines take no part."""

    def __init__(self, doc_ids: bytes, sizes: bytes, blob: bytes):
        self.ids, self.at, self.raw = unpack(doc_ids, sizes, blob)
        self.null = np.frombuffer(sizes, np.int64) < 0
        data = np.frombuffer(self.raw, np.uint8)
        n = len(data)
        feeds = np.flatnonzero(data == 10)
        # a line starts at each document and after each line feed; an empty text has no line
        full = np.flatnonzero(np.diff(self.at) > 0)
        start = np.concatenate([self.at[full], feeds + 1])
        doc = np.concatenate([full, np.searchsorted(self.at, feeds, side="right") - 1])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        ends = np.append(self.doc[1:] != self.doc[:-1], True) if len(order) else np.zeros(0, bool)
        self.end = np.where(ends, self.at[self.doc + 1], np.append(self.start[1:], n) - 1) if len(order) else self.start
        self.count = np.bincount(self.doc, minlength=len(self.ids)) if len(self.doc) else np.zeros(len(self.ids), np.int64)
        self.first_of_doc = np.concatenate([[0], np.cumsum(self.count)])
        self.blank = self.end == self.start
        some = np.flatnonzero(~self.blank)
        if len(some):  # from one line's start to the next there is but its line feed besides
            inked = (data > 32) | (data < 9) | ((data > 13) & (data < 32))
            self.blank[some] = ~np.logical_or.reduceat(inked, self.start[some])
        self.hash = self._hashes(data)
        live = np.flatnonzero(~self.blank)
        order = live[np.argsort(self.hash[live], kind="stable")]
        h = self.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.order, self.group, self.first = order, np.cumsum(new) - 1, order[new]  # along order; first copy of each distinct line

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + SLICE)))
            a, b = self.start[i:j], self.end[i:j]
            base = a[0]
            up, down = powers(int(b.max() - base))
            run = prefix(TABLE[data[base : b.max()]], up)
            out[i:j] = mix((run[b - base] - run[a - base]) * down[a - base] + mix((b - a).astype(np.uint64)))
            i = j
        return out

    def signatures(self, which: np.ndarray) -> np.ndarray:
        """(lines x BINS) smallest hashes of shingles; a line shorter than a shingle is one shingle."""
        data = np.frombuffer(self.raw, np.uint8)
        out = np.full((len(which) + 1, BINS), 0xFFFFFFFF, np.uint32)  # the last row takes what is no shingle
        flat, spare = out.reshape(-1), len(which)
        by = np.argsort(self.start[which], kind="stable")
        start, end = self.start[which][by], self.end[which][by]
        i = 0
        while i < len(by):
            base = int(start[i])
            j = max(i + 1, int(np.searchsorted(start, base + SLICE)))
            a, b = start[i:j] - base, end[i:j] - base
            size = int(b[-1])
            up, down = powers(size + SHINGLE)
            run = prefix(TABLE[data[base : base + size]], up)
            short = np.flatnonzero(b - a < SHINGLE)
            if len(short):
                h = mix((run[b[short]] - run[a[short]]) * down[a[short]] + (b - a)[short].astype(np.uint64))
                flat[by[i + short] * BINS + (h >> np.uint64(58)).astype(np.int64)] = (h & np.uint64(0xFFFFFFFE)).astype(np.uint32)
            if size >= SHINGLE:
                h = (run[SHINGLE:] - run[:-SHINGLE]) * down[: size - SHINGLE + 1]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                m = np.maximum(b - a - SHINGLE + 1, 0)
                edges = np.stack([a, a + m], 1).ravel()  # shingles of a line, then places that start none
                counts = np.diff(np.append(edges, len(h))) if edges[-1] <= len(h) else None
                if counts is None or (counts < 0).any():
                    edges = np.minimum(edges, len(h))
                    counts = np.maximum(np.diff(np.append(edges, len(h))), 0)
                owner = np.repeat(np.stack([by[i:j], np.full(j - i, spare)], 1).ravel() * BINS, counts)
                h = h[edges[0] :]
                np.minimum.at(flat, owner + (h >> np.uint64(58)).astype(np.int64), ((h >> np.uint64(20)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))
            i = j
        return densify(out[:-1])


def densify(sig: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the first full bin along a fixed order of probes for each bin."""
    empty = sig == 0xFFFFFFFF
    if not empty.any():
        return sig
    out = sig.copy()
    todo = np.argwhere(empty)
    probe = np.random.default_rng(99).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)
    for k in range(BINS):
        if not len(todo):
            break
        r, c = todo[:, 0], todo[:, 1]
        source = probe[c, k]
        ok = ~empty[r, source]
        out[r[ok], c[ok]] = sig[r[ok], source[ok]]
        todo = todo[~ok]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines x BANDS) 64-bit keys; the lowest five bits are the band's number."""
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        out[:, b] = key & ~np.uint64(31) | np.uint64(b)
    return out


def _entries(v: Lines, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, cut, line hashes): the band keys of distinct lines in the order of keys, cut by range."""
    keys = band_keys(v.signatures(v.first)).ravel()
    line = np.repeat(np.arange(len(v.first)), BANDS)
    order = np.argsort(keys, kind="stable")
    keys, line = keys[order], line[order]
    return keys, line, np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1)), v.hash[v.first]


def _send(batches: DataFrame, ranges: int) -> DataFrame:
    def run(it):
        for rows in it:
            for b in rows.to_pylist():
                v = Lines(b["doc_ids"], b["sizes"], b["blob"])
                keys, line, cut, hashes = _entries(v, ranges)
                where = np.searchsorted(range_of(hashes, ranges), np.arange(ranges + 1))
                ids = v.ids[v.doc[v.first]]
                out = []
                for p in range(ranges):
                    k, own = slice(cut[p], cut[p + 1]), slice(where[p], where[p + 1])
                    if k.stop > k.start or own.stop > own.start:
                        tag = (hashes[line[k]] >> np.uint64(32)).astype(np.uint32)
                        out.append((b["batch_id"], p, k.stop - k.start, own.stop - own.start, _pack(_delta(keys[k]), tag, _delta(hashes[own]), ids[own])))
                del v, keys, line, hashes
                release()
                columns = list(zip(*out)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["batch_id", "part", "n", "m", "cell"])

    return batches.mapInArrow(run, "batch_id long, part int, n long, m long, cell binary")


def _answer(sent: DataFrame) -> DataFrame:
    """For each batch and range: bits of its lines that come earlier elsewhere; (line's tag, band) of its bands that another line shares."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch_id")
        ns, ms = group["n"].to_numpy(), group["m"].to_numpy()
        an, am = np.concatenate([[0], np.cumsum(ns)]), np.concatenate([[0], np.cumsum(ms)])
        keys, tags = np.empty(an[-1], np.uint64), np.empty(an[-1], np.uint32)
        hashes, ids = np.empty(am[-1], np.uint64), np.empty(am[-1], np.int64)
        for i, cell in enumerate(group["cell"].to_pylist()):
            raw, n, m = _unpack(cell), int(ns[i]), int(ms[i])
            keys[an[i] : an[i + 1]] = np.cumsum(np.frombuffer(raw, np.uint64, n))
            tags[an[i] : an[i + 1]] = np.frombuffer(raw, np.uint32, n, 8 * n)
            hashes[am[i] : am[i + 1]] = np.cumsum(np.frombuffer(raw, np.uint64, m, 12 * n))
            ids[am[i] : am[i + 1]] = np.frombuffer(raw, np.int64, m, 12 * n + 8 * m)
        shared, late = np.zeros(len(keys), bool), np.zeros(len(hashes), bool)
        order = np.lexsort((tags, keys))
        k, t = keys[order], tags[order]
        if len(k):
            new = np.concatenate([[True], k[1:] != k[:-1]])
            other = new | np.concatenate([[True], t[1:] != t[:-1]])
            edge = np.flatnonzero(new)
            kinds = np.add.reduceat(other.astype(np.int64), edge)
            shared[order] = np.repeat(kinds > 1, np.diff(np.append(edge, len(k))))
        order = np.lexsort((ids, hashes))
        h = hashes[order]
        late[order[1:]] = h[1:] == h[:-1]
        bits = [np.packbits(late[am[i] : am[i + 1]]).tobytes() for i in range(len(ms))]
        echo = []
        for i in range(len(ns)):
            own = np.flatnonzero(shared[an[i] : an[i + 1]]) + an[i]
            echo.append(tags[own].tobytes() + (keys[own] & np.uint64(31)).astype(np.uint8).tobytes())
        return pa.table([group["batch_id"], group["part"], pa.array(np.zeros(len(ns), np.int32)), pa.array(bits, pa.binary()), pa.array(echo, pa.binary())], names=["batch_id", "part", "kind", "late", "more"])

    return sent.groupBy("part").applyInArrow(run, ANSWER)


def _bits(rows: list[dict], name: str, cut: np.ndarray) -> np.ndarray:
    out = np.zeros(int(cut[-1]), bool)
    for r in rows:
        if r["kind"] == 0:
            a, b = cut[r["part"]], cut[r["part"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=b - a)
    return out


CANDIDATE = "line long, batch_id long, entry int, doc_id long, place int, text binary, bands array<long>, sketch binary"


def _candidates(batches: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """First copies of lines that share a band: place, text, shared bands and sketch."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = right.to_pylist(), []
        for b in left.to_pylist():
            v = Lines(b["doc_ids"], b["sizes"], b["blob"])
            hashes = v.hash[v.first]  # ascending
            late = _bits(found, "late", np.searchsorted(range_of(hashes, ranges), np.arange(ranges + 1)))
            tags, bands = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
            for r in found:
                n = len(r["more"]) // 5
                tags.append(np.frombuffer(r["more"], np.uint32, n))
                bands.append(np.frombuffer(r["more"], np.uint8, n, 4 * n))
            tags, bands = np.concatenate(tags), np.concatenate(bands)
            known = (hashes >> np.uint64(32)).astype(np.uint32)
            # lines of one tag in a batch are rare, and then all taken
            lo, hi = np.searchsorted(known, tags, "left"), np.searchsorted(known, tags, "right")
            line = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            bands = np.repeat(bands, hi - lo).astype(np.int64)
            bands, line = bands[~late[line]], line[~late[line]]
            which, at = np.unique(line, return_inverse=True)
            sig = v.signatures(v.first[which])
            keys = band_keys(sig)[at, bands].view(np.int64)
            order = np.argsort(at, kind="stable")
            keys, edge = keys[order], np.append(np.searchsorted(at[order], np.arange(len(which))), len(at))
            first = v.first[which]
            texts = [v.raw[a:e] for a, e in zip(v.start[first].tolist(), v.end[first].tolist())]
            sketch = (sig >> np.uint32(8)).astype(np.uint8)
            out.append(
                pa.table(
                    [
                        pa.array(hashes[which].view(np.int64)),
                        pa.array(np.full(len(which), b["batch_id"])),
                        pa.array(which.astype(np.int32)),
                        pa.array(v.ids[v.doc[first]]),
                        pa.array((first - v.first_of_doc[v.doc[first]]).astype(np.int32)),
                        pa.array(texts, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(keys)),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["line", "batch_id", "entry", "doc_id", "place", "text", "bands", "sketch"],
                )
            )
        return pa.concat_tables(out) if out else right.slice(0, 0)

    return batches.groupBy("batch_id").cogroup(answers.groupBy("batch_id")).applyInArrow(run, CANDIDATE)


def _band_forest(cands: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) that join lines of one band whose sketches agree; a spanning forest for each task."""
    need = int((THRESHOLD - MARGIN) * BINS)
    entries = cands.select("line", F.explode("bands").alias("band"), "sketch")

    def run(group: pa.Table) -> pa.Table:
        band, line = group["band"].to_numpy(), group["line"].to_numpy()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        order = np.lexsort((line, band))
        band = band[order]
        us, vs = [], []
        s, at = 1, np.arange(len(order))
        while True:  # each line against the s-th after it in its band
            at = at[at + s < len(order)]
            at = at[band[at + s] == band[at]]
            if not len(at):
                break
            for i in range(0, len(at), 1 << 15):
                x, y = order[at[i : i + (1 << 15)]], order[at[i : i + (1 << 15)] + s]
                ok = (sketch[x] == sketch[y]).sum(1) >= need
                us.append(line[x[ok]])
                vs.append(line[y[ok]])
            if len(us) > 500:
                node, root = roots(np.concatenate(us), np.concatenate(vs))
                us, vs = [node], [root]
            s += 1
        if us:
            node, root = roots(np.concatenate(us), np.concatenate(vs))
            us, vs = node[node != root], root[node != root]
        return pa.table([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"])

    # bands of more than BLOCK lines meet by pairs of blocks
    large = entries.groupBy("band").count().where(F.col("count") > BLOCK)
    sized = entries.join(large, "band", "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("line"), F.col("n")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    task = F.pmod(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")), F.lit(parts)).cast("int")
    return spread.withColumn("task", task).withColumn("band", F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))).select("task", "band", "line", "sketch").groupBy("task").applyInArrow(run, "u long, v long")


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit words; a shorter text is one shingle that no other line has."""
    if len(text) < SHINGLE:
        return np.zeros(0, np.uint64)
    return np.unique(np.ndarray((len(text) - SHINGLE + 1,), np.uint64, text, strides=(1,)))


def jaccard_reaches(a: np.ndarray, b: np.ndarray) -> bool:
    n = max(len(a), 1) + max(len(b), 1)
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same >= THRESHOLD * (n - same)


def links_within(lines: np.ndarray, texts: list[bytes], sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect lines as all pairs of exact Jaccard similarity of at least THRESHOLD do.

    A line that is reached leaves the unreached; each reached line meets all unreached
    ones once: by sketch, and those whose sketches agree by their sets of shingles.
    """
    sets: dict[int, np.ndarray] = {}
    need = int((THRESHOLD - MARGIN) * BINS)

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(texts[i])
        return sets[i]

    left, out = np.arange(len(texts)), []
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = left if len(left) < 3 else left[(sketches[left] == sketches[x]).sum(1) >= need]
            reached = []
            for y in near.tolist():
                if jaccard_reaches(of(x), of(y)):
                    out.append((int(lines[x]), int(lines[y])))
                    reached.append(y)
            if reached:
                left = left[~np.isin(left, reached)]
                stack += reached
            sets.pop(x, None)
    return out


def _verified(cands: DataFrame, roots_: DataFrame, parts: int) -> DataFrame:
    """Links (u, v) by exact Jaccard similarity within candidate components."""
    own = cands.select("line", "text", "sketch").join(roots_.withColumnRenamed("node", "line"), "line")
    sizes = roots_.groupBy("root").count().where(F.col("count") > BLOCK)
    sized = own.join(sizes, "root", "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("line"), F.col("n")).cast("int"))
    spread = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("root", "line", "text", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        key = list(zip(group["root"].to_pylist(), group["i"].to_pylist(), group["j"].to_pylist()))
        lines, texts = group["line"].to_numpy(), group["text"].to_pylist()
        sketches = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        groups: dict = {}
        for at, k in enumerate(key):
            groups.setdefault(k, []).append(at)
        out = []
        for rows in groups.values():
            rows = sorted(set(rows), key=lambda r: lines[r])
            if len(rows) > 1:
                out += links_within(lines[rows], [texts[r] for r in rows], sketches[rows])
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    task = F.pmod(F.xxhash64("root", "i", "j"), F.lit(parts)).cast("int")
    return spread.withColumn("task", task).groupBy("task").applyInArrow(run, "u long, v long")


def _run(docs: DataFrame, finish, schema: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    batches = scratch.batches(pack_batches(docs.select("doc_id", "text")))
    size = batches.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(4, round(size / 350 * (BANDS + 1) / RANGE_ENTRIES))
    answers = scratch.table(_answer(_send(batches, ranges)), "bits")
    cands = scratch.table(_candidates(batches, answers, ranges), "candidates")
    parts = max(8, round(cands.count() / LINES_PER_TASK * 8))
    forest = scratch.table(_band_forest(cands, parts), "forest")
    near = components(forest, scratch, "near")
    links = scratch.table(_verified(cands, near, parts), "links")
    final = components(links, scratch, "classes")
    # of a class the first line stays; its others go by batch and entry
    member = cands.select("line", "batch_id", "entry", "doc_id", "place").join(final.withColumnRenamed("node", "line"), "line")
    best = member.groupBy("root").agg(F.min(F.struct("doc_id", "batch_id", "place")).alias("best"))
    gone = member.join(best, "root").where(F.struct("doc_id", "batch_id", "place") > F.col("best")).select("batch_id", "entry")
    gone = gone.groupBy("batch_id").agg(F.collect_list("entry").alias("entries")).select("batch_id", F.lit(-1).alias("part"), F.lit(1).alias("kind"), F.lit(b"").alias("late"), F.lit(b"").alias("more"), "entries")
    gone = scratch.table(gone, "gone")
    scratch.keep_only("batches", "bits", "gone")
    both = answers.drop("more").withColumn("more", F.lit(b"")).select("batch_id", "part", "kind", "late", "more", F.lit(None).cast("array<int>").alias("entries")).unionByName(gone)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, out = right.to_pylist(), []
        for b in left.to_pylist():
            v = Lines(b["doc_ids"], b["sizes"], b["blob"])
            late = _bits(found, "late", np.searchsorted(range_of(v.hash[v.first], ranges), np.arange(ranges + 1)))
            fuzzy = np.zeros(len(late), bool)
            for r in found:
                if r["kind"] == 1:
                    fuzzy[r["entries"]] = True
            first = np.zeros(len(v.start), bool)
            first[v.first] = True
            drop = np.zeros(len(v.start), bool)
            drop[v.order] = ~first[v.order] | late[v.group] | fuzzy[v.group]
            other = np.zeros(len(v.start), bool)
            other[v.first[fuzzy]] = True
            out.append(finish(v, drop, other))
        return pa.concat_tables(out) if out else finish(Lines(b"", b"", b""), np.zeros(0, bool), np.zeros(0, bool))

    return batches.groupBy("batch_id").cogroup(both.groupBy("batch_id")).applyInArrow(run, schema)


def _kept(v: Lines, drop: np.ndarray) -> list[bytes]:
    out = []
    for i in range(len(v.ids)):
        a, b = v.first_of_doc[i], v.first_of_doc[i + 1]
        if not drop[a:b].any():
            out.append(v.raw[v.at[i] : v.at[i + 1]])
        else:
            out.append(b"\n".join([v.raw[s:e] for s, e, d in zip(v.start[a:b].tolist(), v.end[a:b].tolist(), drop[a:b].tolist()) if not d]))
    return out


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_fuzzy, kept_sha256) for each document.

    Lines end at line feeds. Of lines that are equal, or linked through others of Jaccard
    similarity of THRESHOLD or more over shingles of SHINGLE bytes, the first by
    (doc_id, place) stays. n_removed: lines that go; n_fuzzy: those among them that
    are the first of their text and go for a similar one. Blank lines stay. A null or empty text has no line. Rows of
    one id are documents of their own, in some order; a null id is the smallest and
    comes out as null. An empty table gives no row.
    """

    def finish(v: Lines, drop: np.ndarray, other: np.ndarray) -> pa.Table:
        total = lambda x: (lambda c: c[v.first_of_doc[1:]] - c[v.first_of_doc[:-1]])(np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))
        sums = [hashlib.sha256(x).hexdigest() for x in _kept(v, drop)]
        return pa.table([pa.array(v.ids, mask=v.ids == -(2**63)), pa.array(v.count.astype(np.int64)), pa.array(total(drop)), pa.array(total(other)), pa.array(sums, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_fuzzy", "kept_sha256"])

    return _run(docs, finish, "doc_id long, n_lines long, n_removed long, n_fuzzy long, kept_sha256 string")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, emptied): texts without those lines; an untouched text stays byte for byte, a null text null.

    emptied: the text had a line that isn't blank, and has none left.
    """

    def finish(v: Lines, drop: np.ndarray, other: np.ndarray) -> pa.Table:
        kept = pa.array([None if gone else x.decode("utf-8", "replace") for x, gone in zip(_kept(v, drop), v.null.tolist())], pa.string())
        inked = np.concatenate([[0], np.cumsum(~v.blank)]), np.concatenate([[0], np.cumsum(~v.blank & ~drop)])
        had, has = (x[v.first_of_doc[1:]] > x[v.first_of_doc[:-1]] for x in inked)
        return pa.table([pa.array(v.ids, mask=v.ids == -(2**63)), kept, pa.array(had & ~has)], names=["doc_id", "text", "emptied"])

    return _run(docs, finish, "doc_id long, text string, emptied boolean")
