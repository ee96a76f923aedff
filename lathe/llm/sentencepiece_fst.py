"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model compiles to three transducers: the normaliser (a leading and each inner
space become the escape), a trie of pieces whose final states emit an id and a
weight, and byte fallback for characters without a piece. Their composition with an
input is a lattice; its shortest path in the tropical semiring is the encoding.

For a unigram model a weight is a piece's negative log probability. A BPE model has
merges instead of probabilities: a sequence of pieces is its encoding if and only
if each neighbouring pair is the encoding of its own string, so the transducer
remembers the last piece, an arc weighs 0 after a piece with which it is
compatible and infinity after others, and the only finite path is the shortest.
Runs of escapes merge last and from the left; they have a transducer of their own.

No piece holds a character followed by an escape, so a text's path is that of its
words; the paths of frequent words are kept (a bounded memory, not a bound on
words).
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "▁"
#: Words whose paths one worker keeps.
KEPT_WORDS = 300_000
DIGEST = "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped spaces is compiled")
        self.prefix, self.unigram = norm.add_dummy_prefix, proto.trainer_spec.model_type == 1
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        if any(ESCAPE in p[1:] and p.strip(ESCAPE) for p in self.id):
            raise ValueError("a piece spans words")
        self.trie: dict = {}
        for piece, i in self.id.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = (i, piece)
        least = min(self.score.values(), default=0.0)
        self.fallback = 10.0 - least  # the weight of a character without a piece
        self.fits: dict[str, dict[str, bool]] = {}
        self.words: dict[str, tuple[bytes, int]] = {}
        raw = [p.piece.replace(ESCAPE, " ").encode() if p.type in (1, 4) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in proto.pieces]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merges of a BPE model: always the best pair, leftmost on ties; a heap of pairs keeps it near linear in the length."""
        n = len(text)
        if n < 2:
            return list(text)
        score, parts = self.score, list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != len(pair) or parts[i] + parts[j] != pair:
                continue  # a side has merged with another since
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    s = score.get(parts[x] + parts[y])
                    if s is not None:
                        heapq.heappush(heap, (-s, x, parts[x] + parts[y]))
        return [p for p in parts if p]

    def compatible(self, a: str, b: str) -> bool:
        row = self.fits.get(a)
        if row is None:
            if len(self.fits) > 20_000:
                self.fits.clear()
            row = self.fits[a] = {}
        fits = row.get(b)
        if fits is None:
            fits = row[b] = self.merged(a + b) == [a, b]
        return fits

    def arcs(self, text: str, at: int) -> list[tuple[int, str]]:
        """Pieces that start at a place of the text, shortest first."""
        out, node = [], self.trie
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                break
            if "" in node:
                out.append((i + 1, node[""][1]))
        return out

    def path(self, text: str) -> list[str]:
        """The shortest path of a word's lattice, as pieces; a character without a piece is itself."""
        return self._unigram(text) if self.unigram else self._bigram(text)

    def _unigram(self, text: str) -> list[str]:
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(float("inf"), 0, "")] * len(text)
        for i in range(len(text)):
            weight = best[i][0]
            arcs = self.arcs(text, i)
            if not arcs or arcs[0][0] != i + 1:
                arcs = [(i + 1, text[i]), *arcs]
            for j, piece in arcs:
                w = weight - self.score[piece] if piece in self.score else weight + self.fallback
                if w < best[j][0]:
                    best[j] = (w, i, piece)
        out, at = [], len(text)
        while at:
            out.append(best[at][2])
            at = best[at][1]
        return out[::-1]

    def _bigram(self, text: str) -> list[str]:
        """Depth first over (place, last piece), longest arcs first: weights are 0 or infinite, so the first full path is shortest."""
        n, trie, fits = len(text), self.trie, self.fits
        ends: dict[int, list[int]] = {}  # where pieces from a place end, shortest first
        path: list[str] = []
        tried: list[list] = []  # for each place on the path: [place, its ends, how many are left]
        dead: set = set()
        at = 0
        while True:
            own = ends.get(at)
            if own is None:
                own, node = [], trie
                for i in range(at, n):
                    node = node.get(text[i])
                    if node is None:
                        break
                    if "" in node:
                        own.append(i + 1)
                if not own or own[0] != at + 1:
                    own.insert(0, at + 1)
                ends[at] = own
            tried.append([at, own, len(own)])
            while tried:
                top = tried[-1]
                if not top[2]:
                    tried.pop()
                    if path:
                        dead.add((tried[-1][0], path.pop()))
                    continue
                top[2] -= 1
                start, end = top[0], top[1][top[2]]
                piece = text[start:end]
                if path:
                    row = fits.get(path[-1])
                    fit = row.get(piece) if row is not None else None
                    if fit is None:
                        fit = self.compatible(path[-1], piece)
                    if not fit:
                        continue
                if dead and (start, piece) in dead:
                    continue
                path.append(piece)
                if end == n:
                    return path
                at = end
                break
            else:
                return self.merged(text)

    @lru_cache(maxsize=4096)  # noqa: B019
    def run(self, n: int) -> tuple[str, ...]:
        """The pieces of n escapes."""
        return tuple(self._unigram(ESCAPE * n) if self.unigram else self.merged(ESCAPE * n))

    def ids(self, pieces) -> list[int]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def word(self, word: str, spaces: int = 1) -> tuple[bytes, int]:
        """(ids as little-endian words, ids of byte fallback) of a word after so many escapes."""
        if spaces == 1:
            known = self.words.get(word)
            if known is not None:
                return known
        if self.unigram:
            pieces = self.path(ESCAPE * spaces + word)
        else:
            pieces = self.path(ESCAPE + word if spaces else word)
            if spaces > 1:
                # the last escape belongs to the word if it merged with it
                pieces = [*self.run(spaces - 1), *pieces] if pieces[0] != ESCAPE else [*self.run(spaces), *pieces[1:]]
        ids, fell = list(map(self.id.get, pieces)), 0
        if None in ids:
            ids, fell = self.ids(pieces), sum(len(p.encode()) for p in pieces if p not in self.id) if self.byte else 0
        out = (np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes(), fell)
        if spaces == 1 and len(self.words) < KEPT_WORDS:
            self.words[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, int]:
        """(ids as little-endian words, ids of byte fallback)."""
        if not text:
            return b"", 0
        words = text.replace(ESCAPE, " ").split(" ")
        known = self.words
        out, fell, spaces = [], 0, 1 if self.prefix else 0
        for w in words:
            if w == "":
                spaces += 1
                continue
            found = known.get(w) if spaces == 1 else None
            if found is None:
                found = self.word(w, spaces)
            out.append(found[0])
            fell += found[1]
            spaces = 1
        # the text ends with the escapes after its last word, or is nothing but escapes
        if words[-1] == "":
            out.append(np.array(self.ids(self.run(spaces - 1)), "<u4").tobytes() if spaces > 1 else b"")
        return b"".join(out), fell

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of texts whose ids are concatenated; the inverse transducer, without the leading space."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.raw[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])]
        offsets = total[at]
        if self.prefix:
            keep = np.ones(len(raw), bool)
            lead = offsets[:-1][np.diff(offsets) > 0]
            lead = lead[raw[lead] == 32]
            keep[lead] = False
            raw = raw[keep]
            offsets = offsets - np.concatenate([[0], np.cumsum(~keep)])[offsets]
        return raw, offsets


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, n_fallback, ids_crc32, decoded_sha256, round_trip) for each document.

    ids_crc32: checksum of the ids as unsigned little-endian 32-bit words. decoded_sha256: of
    the text that the ids decode to. round_trip: it equals the text (always, but for
    texts that hold the escape itself, which decodes to a space). A null or empty
    text has no ids. Null ids and repeated rows pass through; an empty table gives no row. Very long
    texts, words and runs of spaces take time in proportion to their length, or nearly.
    """
    path = path or model_path()

    def run(it):
        tool = transducer(path)
        for batch in it:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [tool.encode(t) for t in texts]
                counts = np.array([len(f[0]) // 4 for f in found], np.int64)
                at = np.concatenate([[0], np.cumsum(counts)])
                raw, offsets = tool.decode(np.frombuffer(b"".join(f[0] for f in found), "<u4").astype(np.int64), at)
                back = raw.tobytes()
                decoded = [back[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                        pa.array([d == t.encode() for d, t in zip(decoded, texts)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "n_fallback", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text; no ids for a null text."""
    path = path or model_path()

    def run(it):
        tool = transducer(path)
        for batch in it:
            ids = [np.frombuffer(tool.encode(t or "")[0], "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    path = path or model_path()

    def run(it):
        tool = transducer(path)
        for batch in it:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            raw, offsets = tool.decode(np.concatenate(ids) if ids else np.zeros(0, np.int64), at)
            back = raw.tobytes()
            texts = [back[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
