"""Exact search for repeated windows of tokens over a whole corpus.

A sparse suffix index: each window of `window` tokens has an anchor, the gram of
`gram` tokens inside it with the smallest hash (leftmost on ties), so equal
windows have equal anchors at equal places. Consecutive windows with one anchor
form a chunk. Only chunks travel:

1. Each batch of documents sends (anchor, chunk hash, smallest document) of its
   distinct chunks, packed by range of the anchor's hash. For each chunk the range answers
   two bits: an identical chunk comes earlier elsewhere; the anchor has several
   chunks.
2. The first copy of each chunk of an anchor with several chunks is compared
   window by window with the others of that anchor: its text goes to the range of
   leading tokens that sampled splitters assign. There, bytes are sorted word by word
   (a vectorised multikey quicksort), and neighbours with a common prefix of a
   whole window are one class. Words are streamed, document after document, past a
   suffix automaton of the smaller documents: a matching statistic of a whole window or
   more marks it. Equal leading tokens share a range, so nothing is missed at
   boundaries. The answer is a bit mask of windows that come earlier.

Nothing is capped: a passage with thousands of copies is one entry per batch and
one representative altogether. Identity of chunks rests on 128 bits of hash (64 of the
anchor, 64 of the chunk), of windows on their tokens (64 bits for each word where tokens are words).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .shared import Scratch, mix, pack_batches, release, unpack

BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
#: Entries that one range of anchors holds, about; sets the number of ranges.
RANGE_ENTRIES = 500_000
#: Words: so many windows of reference go to one suffix automaton; a bundle that alone has more is sorted.
AUTOMATON_WINDOWS = 12_000
#: Sampled leads for each range of leading tokens, and of a batch; they set the balance of ranges only.
RANGE_SAMPLE, BATCH_SAMPLE = 64, 2500

ANSWER = "batch_id long, part int, kind int, late binary, more binary"


@dataclass(frozen=True)
class Spec:
    """window, gram: in tokens. by_document: only a smaller document is earlier, not an earlier place in the same."""

    window: int
    gram: int
    words: bool
    by_document: bool


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n + 1).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            _powers.clear()
            _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, INVERSE))
    return _powers[size]


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_tokens(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each maximal run outside [\\x20\\x09-\\x0D], and each document's first word."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(at), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), SLICE):
        a, b = first[lo : lo + SLICE], last[lo : lo + SLICE]
        base = a[0]
        up, down = powers(int(b[-1] - base))
        run = prefix(TABLE[data[base : b[-1]]], up)
        hashes[lo : lo + len(a)] = mix((run[b - base] - run[a - base]) * down[a - base] + (b - a).astype(np.uint64))
    return hashes, first, last, np.searchsorted(first, at)


def prefix(tokens: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=out[1:])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def chunks_of(tokens: np.ndarray, bounds: np.ndarray, spec: Spec) -> dict[str, np.ndarray]:
    """Chunks of the concatenated documents: start, windows, anchor place, anchor hash, chunk hash."""
    L, k = spec.window, spec.gram
    w = L - k + 1
    n = len(tokens)
    parts: dict[str, list[np.ndarray]] = {x: [] for x in ("start", "count", "anchor", "ah", "ch")}
    for s0 in range(0, max(n - L + 1, 0), SLICE):
        s1 = min(s0 + SLICE, n - L + 1)
        toks = tokens[s0 : s1 + L - 1]
        toks = TABLE[toks] if toks.dtype == np.uint8 else toks
        up, down = powers(len(toks))
        run = prefix(toks, up)
        grams = mix((run[k:] - run[:-k]) * down[: len(run) - k])
        key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(key, w) & PLACE).astype(np.int64)
        ok = np.zeros(s1 - s0 + 1, np.int32)
        lo, hi = np.clip(bounds[:-1] - s0, 0, s1 - s0), np.clip(bounds[1:] - L + 1 - s0, 0, s1 - s0)
        fit = hi > lo
        np.add.at(ok, lo[fit], 1)
        np.add.at(ok, hi[fit], -1)
        valid = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
        if not len(valid):
            continue
        spot = place[valid]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(spot) != 0)]))
        start, count, anchor = valid[cut], np.diff(np.concatenate([cut, [len(valid)]])), spot[cut]
        end = start + count - 1 + L
        parts["start"].append(start + s0)
        parts["count"].append(count)
        parts["anchor"].append(anchor + s0)
        parts["ah"].append(mix(grams[anchor]))  # anchors are smallest hashes: scrambled again they fill all ranges alike
        whole = (run[end] - run[start]) * down[start]
        parts["ch"].append(mix(whole + (count.astype(np.uint64) << np.uint64(20)) + (anchor - start).astype(np.uint64)))
    kinds = {"start": np.int64, "count": np.int64, "anchor": np.int64, "ah": np.uint64, "ch": np.uint64}
    return {x: np.concatenate(v) if v else np.zeros(0, kinds[x]) for x, v in parts.items()}


@dataclass
class View:
    """One batch: its documents, tokens, chunks, and the distinct chunks in the order in which they are sent."""

    ids: np.ndarray
    at: np.ndarray
    raw: bytes
    tokens: np.ndarray
    bounds: np.ndarray
    spans: tuple[np.ndarray, np.ndarray] | None
    chunks: dict[str, np.ndarray]
    order: np.ndarray  # chunks by (anchor hash, chunk hash, place)
    group: np.ndarray  # number of the distinct chunk, along order
    first: np.ndarray  # the first copy of each distinct chunk
    doc: np.ndarray  # the document of each chunk, as an index

    def range_of(self, ranges: int) -> np.ndarray:
        return range_of(self.chunks["ah"][self.first], ranges)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def view(doc_ids: bytes, sizes: bytes, blob: bytes, spec: Spec) -> View:
    ids, at, raw = unpack(doc_ids, sizes, blob)
    spans = None
    if spec.words:
        tokens, a, b, bounds = word_tokens(raw, at)
        spans = (a, b)
    else:
        tokens, bounds = np.frombuffer(raw, np.uint8), at
    c = chunks_of(tokens, bounds, spec)
    order = np.lexsort((c["ch"], c["ah"]))
    ah, ch = c["ah"][order], c["ch"][order]
    new = np.ones(len(order), bool)
    new[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
    doc = np.searchsorted(bounds, c["start"], side="right") - 1
    return View(ids, at, raw, tokens, bounds, spans, c, order, np.cumsum(new) - 1, order[new], doc)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def send(batches: DataFrame, spec: Spec, ranges: int) -> DataFrame:
    def run(it):
        for rows in it:
            for b in rows.to_pylist():
                v = view(b["doc_ids"], b["sizes"], b["blob"], spec)
                to = v.range_of(ranges)
                cut = np.searchsorted(to, np.arange(ranges + 1))
                ah, ch = v.chunks["ah"][v.first], v.chunks["ch"][v.first]
                ids = v.ids[v.doc[v.first]]
                used = np.flatnonzero(np.diff(cut))
                cells = [_pack(_delta(ah[cut[i] : cut[i + 1]]), ch[cut[i] : cut[i + 1]], planes(ids[cut[i] : cut[i + 1]])) for i in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["batch_id"]] * len(used), pa.int64()), pa.array(used.astype(np.int32)), pa.array(np.diff(cut)[used].astype(np.int64)), pa.array(cells, pa.binary())],
                    names=["batch_id", "part", "n", "cell"],
                )
                del v, cells
                release()

    return batches.mapInArrow(run, "batch_id long, part int, n long, cell binary")


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit words by significance, which packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)


def unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.int64).ravel()


def by_range(cells: DataFrame, ranges: int):
    """Cells by range, about one range a task: adaptive execution would join ranges, whose cells a task then holds together."""
    return cells.repartition(min(max(ranges, 1), 1 << 17), "part").groupBy("part")


def answer_chunks(sent: DataFrame, spec: Spec, ranges: int) -> DataFrame:
    """For each entry of each batch: an identical chunk is earlier; its anchor has several chunks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch_id")
        batch, n, cells = group["batch_id"].to_numpy(), group["n"].to_numpy(), group["cell"].to_pylist()
        at = np.concatenate([[0], np.cumsum(n)])
        total = int(at[-1])
        ah, ch, ids = np.empty(total, np.uint64), np.empty(total, np.uint64), np.empty(total, np.int64)
        for i, cell in enumerate(cells):
            raw, m = _unpack(cell), int(n[i])
            ah[at[i] : at[i + 1]] = np.cumsum(np.frombuffer(raw, np.uint64, m))
            ch[at[i] : at[i + 1]] = np.frombuffer(raw, np.uint64, m, 8 * m)
            ids[at[i] : at[i + 1]] = unplanes(raw[16 * m :], m)
        order = np.lexsort((ids, ch, ah))  # stable: entries of one id stay in the order of batches
        a, c, d = ah[order], ch[order], ids[order]
        anew, cnew = np.ones(total, bool), np.ones(total, bool)
        anew[1:] = a[1:] != a[:-1]
        cnew[1:] = anew[1:] | (c[1:] != c[:-1])
        first = np.flatnonzero(cnew)[np.cumsum(cnew) - 1]
        late, more = np.zeros(total, bool), np.zeros(total, bool)
        late[order] = d[first] < d if spec.by_document else ~cnew
        kinds = np.add.reduceat(cnew.astype(np.int64), np.flatnonzero(anew))
        more[order] = np.repeat(kinds > 1, np.diff(np.concatenate([np.flatnonzero(anew), [total]])))
        m = len(cells)
        del ah, ch, ids, order, a, c, d
        release()
        return pa.table(
            [
                pa.array(batch),
                group["part"],
                pa.array(np.zeros(m, np.int32)),
                pa.array([np.packbits(late[at[i] : at[i + 1]]).tobytes() for i in range(m)], pa.binary()),
                pa.array([np.packbits(more[at[i] : at[i + 1]]).tobytes() for i in range(m)], pa.binary()),
            ],
            names=["batch_id", "part", "kind", "late", "more"],
        )

    return by_range(sent, ranges).applyInArrow(run, ANSWER)


def bits_of(v: View, ranges: int, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each distinct chunk of a batch, from the answers of all ranges."""
    m = len(v.first)
    late, more = np.zeros(m, bool), np.zeros(m, bool)
    cut = np.searchsorted(v.range_of(ranges), np.arange(ranges + 1))
    for r in answers:
        if r["kind"] == 0:
            a, b = cut[r["part"]], cut[r["part"] + 1]
            late[a:b] = np.unpackbits(np.frombuffer(r["late"], np.uint8), count=b - a)
            more[a:b] = np.unpackbits(np.frombuffer(r["more"], np.uint8), count=b - a)
    return late, more


def lead_of(v: View, which: np.ndarray, spec: Spec) -> np.ndarray:
    """A sortable key of the anchor: six leading bytes, then 16 bits of its hash; for words the hash of all of them.

    Equal anchors have equal keys, and no common word or run of spaces draws many anchors to one range.
    """
    place, hashes = v.chunks["anchor"][which], v.chunks["ah"][which]
    if spec.words:
        return hashes
    key = np.zeros(len(place), np.uint64)
    for i in range(6):
        key = (key << np.uint64(8)) | v.tokens[place + i].astype(np.uint64)
    return (key << np.uint64(16)) | (hashes >> np.uint64(48))


def send_texts(batches: DataFrame, answers: DataFrame, spec: Spec, ranges: int, splitters: np.ndarray) -> DataFrame:
    """The representatives: (batch, range of leading tokens, entry, document, place in it, windows, anchor offset, tokens)."""
    names = ["batch_id", "part", "n", "cell"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for b in left.to_pylist():
            v = view(b["doc_ids"], b["sizes"], b["blob"], spec)
            late, more = bits_of(v, ranges, right.to_pylist())
            entry = np.flatnonzero(more & ~late)
            which = v.first[entry]
            to = np.searchsorted(splitters, lead_of(v, which, spec), side="right")
            for p in np.unique(to):
                sel = to == p
                e, c = entry[sel], which[sel]
                start, count, anchor = v.chunks["start"][c], v.chunks["count"][c], v.chunks["anchor"][c]
                length = count - 1 + spec.window
                idx = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                head = np.stack([e, v.ids[v.doc[c]], start, count, anchor - start]).astype(np.int64)
                out.append((b["batch_id"], int(p), len(e), _pack(head, v.tokens[idx])))
            del v
        release()
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return batches.groupBy("batch_id").cogroup(answers.groupBy("batch_id")).applyInArrow(run, "batch_id long, part int, n long, cell binary")


def classes(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class numbers of equal rows within groups: sort by one word after the other, keep refining only rows that tie."""
    out = np.zeros(len(words), np.int64)
    live, tag, given = np.arange(len(words)), group, 0
    for column in range(words.shape[1] + 1):
        # settle rows whose tag is their own
        order = np.argsort(tag, kind="stable")
        t = tag[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        number = np.cumsum(new) - 1
        sizes = np.bincount(number) if len(number) else np.zeros(0, np.int64)
        alone = sizes[number] == 1
        done = order[alone] if column < words.shape[1] else order
        out[live[done]] = (number[alone] if column < words.shape[1] else number) + given
        if column == words.shape[1]:
            break
        given += len(sizes)
        keep = order[~alone]
        live, number = live[keep], number[~alone]
        if not len(live):
            break
        w = words[live, column]
        by = np.lexsort((w, number))
        w, g = w[by], number[by]
        new = np.ones(len(w), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        live, tag = live[by], np.cumsum(new) - 1
    return out


def answer_texts(texts: DataFrame, spec: Spec, ranges: int) -> DataFrame:
    """For each representative: a mask of its windows that also start earlier."""
    L = spec.window

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch_id")
        heads, toks = [], []
        for n, cell in zip(group["n"].to_pylist(), group["cell"].to_pylist()):
            raw = _unpack(cell)
            heads.append(np.frombuffer(raw, np.int64, 5 * n).reshape(5, n))
            toks.append(np.frombuffer(raw, np.uint64 if spec.words else np.uint8, -1, 40 * n))
        ns = np.array([h.shape[1] for h in heads])
        batch = np.repeat(group["batch_id"].to_numpy(), ns)
        entry, doc, place, count, lead = np.concatenate(heads, axis=1)
        tokens = np.concatenate(toks)
        length = count - 1 + L
        base = np.concatenate([[0], np.cumsum(length)[:-1]])
        # one bundle: chunks whose anchors are equal, found by sorting anchors' hashes
        at = base + lead
        up, down = powers(len(tokens))
        vals = TABLE[tokens] if tokens.dtype == np.uint8 else tokens
        run_ = prefix(vals, up)
        bundle = mix((run_[at + spec.gram] - run_[at]) * down[at])
        order = np.argsort(bundle, kind="stable")
        mask = np.zeros(len(entry), np.uint64)
        b = bundle[order]
        edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else np.zeros(1, np.int64)
        # blocks of whole bundles, of bounded size unless one bundle is larger
        windows = np.concatenate([[0], np.cumsum(count[order])])
        lo, most = 0, AUTOMATON_WINDOWS if spec.words else 300_000
        while lo < len(edge) - 1:
            hi = max(lo + 1, int(np.searchsorted(windows[edge], windows[edge[lo]] + most, side="right")) - 1)
            hi = min(hi, len(edge) - 1)
            rows = order[edge[lo] : edge[hi]]
            c = count[rows]
            if spec.by_document and c.sum() <= AUTOMATON_WINDOWS:
                stream(tokens, base, length, doc, rows, mask, L)
                lo = hi
                continue
            row = np.repeat(rows, c)
            off = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            begin = base[row] + off
            rel = lead[row] - off + L  # equal windows have their anchor at an equal offset
            tag = mix(bundle[row] + rel.astype(np.uint64))
            cls = classes(window_words(tokens, begin, L), tag.view(np.int64))
            by = np.lexsort((place[row] + off, batch[row], doc[row], cls))
            k, d = cls[by], doc[row][by]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = d[first] < d if spec.by_document else ~new
            np.bitwise_or.at(mask, row[by][late], np.uint64(1) << off[by][late].astype(np.uint64))
            lo = hi
        cut = np.concatenate([[0], np.cumsum(ns)])
        m = len(ns)
        del tokens, toks, vals, run_
        release()
        return pa.table(
            [
                group["batch_id"],
                group["part"],
                pa.array(np.ones(m, np.int32)),
                pa.array([entry[cut[i] : cut[i + 1]].tobytes() for i in range(m)], pa.binary()),
                pa.array([mask[cut[i] : cut[i + 1]].tobytes() for i in range(m)], pa.binary()),
            ],
            names=["batch_id", "part", "kind", "late", "more"],
        )

    return by_range(texts, ranges).applyInArrow(run, ANSWER)


def stream(tokens: np.ndarray, base: np.ndarray, length: np.ndarray, doc: np.ndarray, rows: np.ndarray, mask: np.ndarray, L: int) -> None:
    """Marks the windows of chunks that match a smaller document's chunk, by matching statistics."""
    reference = SuffixAutomaton()
    rows = rows[np.argsort(doc[rows], kind="stable")]
    pending: list[list[int]] = []
    last = None
    for r, d in zip(rows.tolist(), doc[rows].tolist()):
        if d != last:
            for words in pending:
                reference.add(words)
            pending, last = [], d
        words = tokens[base[r] : base[r] + length[r]].tolist()
        pending.append(words)
        if len(reference.next) > 1:
            bits = 0
            for end, n in enumerate(reference.statistics(words)):
                if n >= L:
                    bits |= 1 << (end - L + 1)
            mask[r] |= np.uint64(bits)


def window_words(tokens: np.ndarray, begin: np.ndarray, L: int) -> np.ndarray:
    """Each window as rows of 64-bit words that sort as its tokens do."""
    if tokens.dtype == np.uint64:
        return np.lib.stride_tricks.sliding_window_view(tokens, L)[begin]
    wide = np.zeros((len(begin), -(-L // 8) * 8), np.uint8)
    wide[:, :L] = np.lib.stride_tricks.sliding_window_view(tokens, L)[begin]
    return wide.view(">u8").astype(np.uint64)


def covered(v: View, spec: Spec, late: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Tokens of a batch that a window with an earlier twin covers."""
    c, L = v.chunks, spec.window
    step = np.zeros(len(v.tokens) + 1, np.int32)
    if len(v.order):
        which = v.order
        lead = v.first[v.group]  # the first copy in this batch
        again = v.doc[which] != v.doc[lead] if spec.by_document else which != lead
        if spec.by_document:
            again &= v.ids[v.doc[which]] > v.ids[v.doc[lead]]
        all_ = late[v.group] | again
        whole = which[all_]
        np.add.at(step, c["start"][whole], 1)
        np.add.at(step, c["start"][whole] + c["count"][whole] - 1 + L, -1)
        some = ~all_ & (masks[v.group] != 0)
        rows, bits = which[some], masks[v.group[some]]
        for i in range(int(c["count"][rows].max()) if len(rows) else 0):
            hit = rows[(bits >> np.uint64(i)) & np.uint64(1) == 1]
            np.add.at(step, c["start"][hit] + i, 1)
            np.add.at(step, c["start"][hit] + i + L, -1)
    return np.cumsum(step[:-1]) > 0


def repeated(docs: DataFrame, spec: Spec, finish, schema: str) -> DataFrame:
    """finish(view, covered tokens) -> pa.Table, for every batch of documents.

    An empty table gives an empty result.
    """
    assert spec.window - spec.gram + 1 <= 64
    spark = docs.sparkSession
    scratch = Scratch(spark)
    batches = scratch.batches(pack_batches(docs))
    size = batches.agg(F.sum("n_bytes")).first()[0] or 0
    tokens = size / 6 if spec.words else size
    ranges = max(4, round(tokens * 2 / (spec.window - spec.gram + 2) / RANGE_ENTRIES))
    answers = scratch.table(answer_chunks(send(batches, spec, ranges), spec, ranges), "chunks")
    splitters = sample_splitters(batches, spec, ranges)
    texts = send_texts(batches, answers, spec, ranges, splitters)
    masks = scratch.table(answer_texts(texts, spec, len(splitters) + 1), "masks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.to_pylist()
        out = []
        for b in left.to_pylist():
            v = view(b["doc_ids"], b["sizes"], b["blob"], spec)
            late, _ = bits_of(v, ranges, found)
            bits = np.zeros(len(v.first), np.uint64)
            for r in found:
                if r["kind"] == 1:
                    bits[np.frombuffer(r["late"], np.int64)] = np.frombuffer(r["more"], np.uint64)
            out.append(finish(v, covered(v, spec, late, bits)))
            del v, late, bits
        release()
        return pa.concat_tables(out) if out else finish(view(b"", b"", b"", spec), np.zeros(0, bool))

    both = answers.unionByName(masks)
    return batches.groupBy("batch_id").cogroup(both.groupBy("batch_id")).applyInArrow(run, schema)


def sample_splitters(batches: DataFrame, spec: Spec, ranges: int) -> np.ndarray:
    """Splitters of the leading tokens, from a sample of anchors that grows with the ranges (it sets balance, not results).

    Batches are chosen by their ids alone, so that no text leaves its task.
    """
    parts = max(4, ranges // 2)
    few = max(8, -(-RANGE_SAMPLE * parts // BATCH_SAMPLE))
    chosen = [r[0] for r in batches.select("batch_id").orderBy(F.xxhash64("batch_id")).limit(few).collect()]

    def run(it):
        for rows in it:
            for b in rows.to_pylist():
                v = view(b["doc_ids"], b["sizes"], b["blob"], spec)
                which = v.first[:: max(1, len(v.first) // BATCH_SAMPLE)]
                yield pa.RecordBatch.from_arrays([pa.array([lead_of(v, which, spec).tobytes()], pa.binary())], names=["leads"])

    some = batches.where(F.col("batch_id").isin(chosen)).select("doc_ids", "sizes", "blob").mapInArrow(run, "leads binary").collect()
    found = np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in some), np.uint64))
    return np.unique(found[np.linspace(0, len(found) - 1, parts + 1).astype(int)[1:-1]]) if len(found) else found
