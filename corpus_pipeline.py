"""A corpus pipeline: quality, lines, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import line_dedup, packing, quality, simhash_dedup, substring_dedup
from lathe.llm.shared import Scratch, table, unused


#: Repeated ids that may be broadcast: 8 bytes each.
MOST_IDS = 1_000_000


def _with_texts(docs: DataFrame, texts_without: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Documents with the texts that an operator leaves of them, their other columns kept; those that lost all they had go.

    texts_without: (doc_id, text) to (doc_id, text, emptied). n_chars, where there is one, is that of the new text; null
    texts stay as they are. Rows that share an id, or have none, are documents of their own: for the operator each gets
    an id below all others, so that they come first, and keeps its own in the result.
    """
    scratch = Scratch(docs.sparkSession)
    key, twice, new, null = (unused(docs, x) for x in ("key", "twice", "new", "null"))
    repeated = scratch.table(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(twice)), "repeated")
    if repeated.count() <= MOST_IDS:  # else whole texts move to tell these rows from others
        repeated = F.broadcast(repeated)
    is_repeated = docs["doc_id"] == repeated[twice]
    least = docs.agg(F.min("doc_id")).first()[0] or 0
    if least < -(2**62):
        raise ValueError("ids below -2**62 leave no room for rows that share an id")
    shared = docs.join(repeated, is_repeated, "left_semi").unionByName(docs.where("doc_id is null"))
    shared = scratch.table(shared.withColumn(key, F.lit(least - 1) - F.monotonically_increasing_id()), "shared")
    alone = docs.where("doc_id is not null").join(repeated, is_repeated, "left_anti")
    asked = alone.select("doc_id", "text").unionByName(shared.select(F.col(key).alias("doc_id"), "text"))
    found = texts_without(asked).where("not emptied").select(F.col("doc_id").alias(f"{key}_"), F.col("text").alias(new))
    rows = alone.withColumn(key, F.col("doc_id")).unionByName(shared).withColumn(null, F.col("text").isNull()).drop("text")
    text = F.when(~F.col(null), F.col(new))
    columns = {"text": text} | ({"n_chars": F.when(F.col(null), F.col("n_chars")).otherwise(F.length(new)).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return rows.join(found, rows[key] == found[f"{key}_"]).select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


def _fresh(stage):
    """A stage that first drops what earlier ones left in the shared folder: their results are written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        Scratch.drop_roots(spark, _LEFT)
        _LEFT.clear()
        before = set(Scratch.roots)
        out = stage(spark, docs, sf_dir)
        _LEFT.update(Scratch.roots - before)
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


_LEFT: set[str] = set()


@_fresh
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


@_fresh
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one line of each class of similar lines."""
    return _with_texts(docs, line_dedup.texts)


@_fresh
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash_dedup.kept(docs)


@_fresh
def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without words that repeat an earlier document's passage."""
    return _with_texts(docs, substring_dedup.texts)


@_fresh
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", distinct_lines),
    ("near_duplicates", distinct_documents),
    ("passages", distinct_passages),
    ("packing", packed),
]

#: Classifier, sketches and tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{i}-{name}")
        scratch.keep_only(f"{i}-{name}")
    return docs
