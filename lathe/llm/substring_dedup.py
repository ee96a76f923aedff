"""Removal of repeated word passages (13-word windows) across documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .passages import Spec, View, repeated
from .shared import Scratch

WINDOW = 13
#: Words in one broadcast automaton of a reference; about 100 MB of a worker's memory.
SHARD_WORDS = 150_000
#: Bytes of reference that may be broadcast, a shard at a time; a larger one has to go through the corpus search (digest, texts).
MOST_REFERENCE = 16 << 20


def _spec(window: int) -> Spec:
    gram = max(1, window // 2)
    return Spec(window=window, gram=max(gram, window - 63), words=True, by_document=True)


def _kept(v: View, gone: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    first, last = v.spans
    out = []
    for i in range(len(v.ids)):
        a, b = v.bounds[i], v.bounds[i + 1]
        words = v.raw[v.at[i] : v.at[i + 1]].split()
        out.append(b" ".join(words) if not gone[a:b].any() else b" ".join([w for w, g in zip(words, gone[a:b].tolist()) if not g]))
    return out


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each word that a window of `window` words covers goes,
    if the window's words also start in a document with a smaller doc_id.

    A null or empty text has no words. Documents of one id don't remove each other's
    words. A null id counts as the smallest and comes out as null.
    """

    def finish(v: View, gone: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = [hashlib.sha256(x).hexdigest() for x in _kept(v, gone)]
        return pa.table([_ids(v), pa.array(np.diff(v.bounds)), pa.array(total[v.bounds[1:]] - total[v.bounds[:-1]]), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs.select("doc_id", "text"), _spec(window), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _ids(v: View) -> pa.Array:
    return pa.array(v.ids, mask=v.ids == -(2**63))


def texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, emptied): texts without those words; an untouched text stays byte for byte, a null text comes out empty.

    emptied: the text had words, and has none left.
    """

    def finish(v: View, gone: np.ndarray) -> pa.Table:
        kept = _kept(v, gone)
        raw = [v.raw[v.at[i] : v.at[i + 1]] if not gone[v.bounds[i] : v.bounds[i + 1]].any() else k for i, k in enumerate(kept)]
        total = np.concatenate([[0], np.cumsum(gone)])
        had = np.diff(v.bounds)
        emptied = (had > 0) & (total[v.bounds[1:]] - total[v.bounds[:-1]] == had)
        return pa.table([_ids(v), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()), pa.array(emptied)], names=["doc_id", "text", "emptied"])

    return repeated(docs.select("doc_id", "text"), _spec(window), finish, "doc_id long, text string, emptied boolean")


def without_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_removed): texts without the words that a window of `window` words of `reference` (text) covers.

    The reference goes shard by shard into suffix automata, which are broadcast; documents
    stream past each for matching statistics, and maximal spans of windows that match
    go. For a reference of bounded size, such as a benchmark: more than MOST_REFERENCE bytes
    is an error. An untouched text stays as it is; null texts stay null. An empty table on
    either side is fine.
    """
    spark = docs.sparkSession
    size = reference.selectExpr("sum(octet_length(text)) as n").first()[0] or 0
    if size > MOST_REFERENCE:
        raise ValueError(f"a reference of {size} bytes is more than {MOST_REFERENCE}; use digest() or texts()")
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for row in reference.select("text").where("text is not null").distinct().toLocalIterator():
        words = row.text.encode().split()
        if held + len(words) > SHARD_WORDS and held:
            shards.append([])
            held = 0
        shards[-1].append(words)
        held += len(words)
    scratch = Scratch(spark)
    state = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text", "cast(null as binary) as gone")
    for k, shard in enumerate(shards):
        # a pass for each shard, so that a worker holds one automaton
        state = state.mapInArrow(_past(spark.sparkContext.broadcast(shard), window), "doc_id long, text string, gone binary")
        state = scratch.table(state, f"shard-{k}")

    def cut(it):
        for batch in it:
            texts, n = [], []
            for text, bits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = np.frombuffer(bits or b"", bool)
                n.append(int(gone.sum()))
                texts.append(text if not n[-1] else b" ".join([x for x, o in zip(text.encode().split(), gone.tolist()) if not o]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "text", "n_removed"])

    return state.mapInArrow(cut, "doc_id long, text string, n_removed long")


def _past(shard, window: int):
    """Streams documents past the automaton of a shard and adds the words that it covers."""

    def run(it):
        automaton = SuffixAutomaton()
        for text in shard.value:
            automaton.add(text)
        for batch in it:
            out = []
            for text, bits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                gone = np.frombuffer(bits, bool).copy() if bits else np.zeros(len(words), bool)
                for end, n in enumerate(automaton.statistics(words)):
                    if n >= window:
                        gone[end - window + 1 : end + 1] = True
                out.append(gone.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "text", "gone"])

    return run
