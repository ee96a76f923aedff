"""Shared pieces of the corpus operators: written tables, batches of texts, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Texts are handed on in blobs of about so many bytes; a longer text has a blob of its own.
BATCH_BYTES = 8 << 20

BATCH_SCHEMA = "batch_id long, n_bytes long, doc_ids binary, sizes binary, blob binary"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset and all run on this machine, a new local one."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lathe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Written tables of one operator run; drop() removes those that no later step reads."""

    #: Folders that this driver has made and not yet dropped.
    roots: set[str] = set()

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/lathe-{uuid.uuid4().hex}"
        Scratch.roots.add(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def batches(self, df: DataFrame) -> DataFrame:
        """The table of pack_batches, bucketed by batch_id: what is grouped by it isn't shuffled again."""
        path, name = f"{self.root}/batches", f"lathe_{uuid.uuid4().hex}"
        buckets = min(max(4, 4 * df.rdd.getNumPartitions()), 1 << 16)
        df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, "batch_id").saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"drop table {name}")  # the name only: the files and the resolved plan stay
        return table

    def keep_only(self, *names: str) -> None:
        """Drops the tables that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            if status.getPath().getName() not in names:
                files.delete(status.getPath(), True)

    @staticmethod
    def drop_roots(spark: SparkSession, roots) -> None:
        for root in list(roots):
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            Scratch.roots.discard(root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts one after the other, their offsets); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pack_batches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (batch_id, n_bytes, doc_ids, sizes, blob): documents of one scan task in blobs.

    A null id counts as the smallest long; a null text has size -1 and no bytes.
    Within a batch documents are in the order of their ids.
    """

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId() << 24, 0
        held, size = [], 0
        press = zstandard.ZstdCompressor(level=1)

        def emit():
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = whole.column(0).fill_null(-(2**63)).to_numpy().astype(np.int64)
            order = np.argsort(ids, kind="stable")
            whole = whole.take(pa.array(order))
            raw, at = texts_of(whole.column(1))
            sizes = np.diff(at)
            sizes[whole.column(1).is_null().to_numpy(zero_copy_only=False)] = -1
            cells = [[task + seq], [len(raw)], [ids[order].tobytes()], [sizes.tobytes()], [press.compress(raw.tobytes())]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["batch_id", "n_bytes", "doc_ids", "sizes", "blob"])

        for batch in it:
            if batch.num_rows == 0:
                continue
            _, at = texts_of(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(at, at[first] + BATCH_BYTES - size, side="left"))
                last = min(max(last, first + 1), batch.num_rows)
                held.append(batch.slice(first, last - first))
                size += int(at[last] - at[first])
                first = last
                if size >= BATCH_BYTES:
                    yield emit()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield emit()

    return docs.selectExpr(f"cast(`{id_column}` as long) as id", f"cast(`{text_column}` as string) as text").mapInArrow(pack, BATCH_SCHEMA)


def unpack(doc_ids: bytes, sizes: bytes, blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(ids, offsets of length n + 1, raw bytes) of one batch."""
    ids, lengths = np.frombuffer(doc_ids, np.int64), np.frombuffer(sizes, np.int64)
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.maximum(lengths, 0), out=at[1:])
    return ids, at, zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(at[-1]) + 1) if at[-1] else b""


def release() -> None:
    """Gives freed memory back, so that an idle Python worker holds little beside its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x
