"""Fixes and lints of files as they arrive: the per-file operators keep no state, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators import lints, parse, texts
from lathe.sources.files import decoded, extension, has_extension


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ext, text) of files that come to a folder."""
    found = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return decoded(found.select("path", extension(F.col("path")).alias("ext"), "content").where(has_extension(F.col("ext")))).drop("bad_utf8")


def fixed(files: DataFrame) -> DataFrame:
    """path and new_text after tables, fences and links."""
    out = files
    for fix in (texts.fix_tables, texts.fix_fences, texts.fix_links):
        out = fix(out).select(*[F.col("new_text").alias("text") if c == "text" else F.col(c) for c in files.columns])
    return out


def linted(files: DataFrame) -> DataFrame:
    return lints.run_all(parse.items(parse.scan(files.where(has_extension(F.col("ext"), ("rs",))))))


def start(frame: DataFrame, out: str, checkpoint: str):
    """Appends to Parquet once for each arriving file, until nothing is left."""
    return frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
