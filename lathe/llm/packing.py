"""Packing by concatenate and cut: token totals of partitions, prefix sums, fixed windows.

Pass 1 tokenises every text once, where it is read, and writes the ids. Pass 2 adds up
the totals of partitions (one row each) to global offsets. Pass 3 cuts the
concatenation at multiples of the window; a window over the border of two
partitions or documents has a record on either side. No row is shuffled.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BATCH_BYTES, Scratch, texts_of

LENGTH = 1024
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TOKENS = "part long, before long, n_tokens long, doc_ids binary, known binary, counts binary, ids binary"


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary, by the byte for which each stands."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> tiktoken.Encoding:
    """A byte-level BPE of the tokenizers format; ids are merge ranks.

    special: the strings of added tokens in a text are those tokens, as the tokenizers library
    takes them by default; else they are ordinary text.
    """
    added: dict[str, int] = {}
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    else:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in neighbouring text are not compiled")
        ids = {x["id"] for x in spec["added_tokens"]}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]} if special else {}
        back = _unicode_bytes()
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if i not in ids}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, special: bool = True) -> DataFrame:
    """Rows of ids of some documents each, in the order of the scan: part, ids before in the part, and the ids."""

    def run(it):
        tool, part, before = encoder(path, special), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=1)
        for batch in it:
            _, at = texts_of(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = min(max(int(np.searchsorted(at, at[first] + BATCH_BYTES // 2)), first + 1), batch.num_rows)
                some = batch.slice(first, last - first)
                ids = [np.append(tool.encode_to_numpy(t, allowed_special="all") if t else np.zeros(0, np.uint32), np.uint32(end_id)) for t in some.column(1).to_pylist()]
                counts = np.array([len(x) for x in ids], np.int64)
                whole = np.concatenate(ids).astype(np.uint32)
                known = some.column(0)
                cells = [part, before, len(whole), known.fill_null(0).to_numpy().astype(np.int64).tobytes(), known.is_valid().to_numpy(zero_copy_only=False).tobytes(), counts.tobytes(), press.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 4).T).tobytes())]
                kinds = [pa.int64()] * 3 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["part", "before", "n_tokens", "doc_ids", "known", "counts", "ids"])
                before += len(whole)
                first = last

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, TOKENS)


def cut(starts: np.ndarray, total: int, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the pieces of `total` ids from global place `base` on, cut at documents and windows."""
    windows = np.arange(-base % length, total, length, dtype=np.int64)
    begin = np.union1d(starts, windows)
    return np.searchsorted(starts, begin, side="right") - 1, begin, np.append(begin[1:], total)


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, special: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence of `length` ids.

    A document is its text's ids, then `end_id`; a null or empty text is `end_id` alone. The string of
    an added token in a text is that token; with special false it is ordinary text.
    Sequences follow each other in the order in which the scan gives documents; all are
    full but the last. Rows of one id are documents of their own; an empty table
    gives no row. A null id comes out as null.
    """
    spark = docs.sparkSession
    tokens = Scratch(spark).table(tokenized(docs.select("doc_id", "text"), path or vocabulary(), end_id, special), "tokens")
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    # one row for each scan task: bounded by the number of tasks, not by rows
    offsets = spark.createDataFrame(bases, "part long, base long")

    def run(it):
        for rows in it:
            for r in rows.to_pylist():
                n, base = r["n_tokens"], r["base"] + r["before"]
                counts = np.frombuffer(r["counts"], np.int64)
                starts = np.cumsum(counts) - counts
                raw = zstandard.ZstdDecompressor().decompress(r["ids"], max_output_size=4 * n)
                ids = memoryview(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T)).cast("B") if n else b""
                doc, begin, end = cut(starts, n, base, length)
                known = np.frombuffer(r["known"], bool)[doc]
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
                where = base + begin
                columns = [pa.array(np.frombuffer(r["doc_ids"], np.int64)[doc], mask=~known), *map(pa.array, (begin - starts[doc], end - begin, np.array(crc, np.int64), counts[doc], where // length, where % length))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(F.broadcast(offsets), "part").mapInArrow(run, PIECES)
