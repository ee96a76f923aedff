"""Markdown tables as relations: lines, runs, cells, widths and rebuilt rows.

The relational form of what texts.fix_tables does file by file: use it where the
parts are wanted (widths, alignments, changed runs) rather than the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import columns as C


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, segment, content, term, prefix, body), lines from 1."""
    split = files.select("path", F.posexplode(C.segments(F.col("text"))).alias("at", "segment"))
    split = split.select("path", (F.col("at") + 1).alias("line_no"), "segment", C.content_of(F.col("segment")).alias("content"), C.terminator_of(F.col("segment")).alias("term"))
    return split.withColumn("prefix", C.doc_prefix(F.col("content"))).withColumn("body", F.expr("substring(content, length(prefix) + 1)"))


def runs(rows: DataFrame) -> DataFrame:
    """Lines with a pipe, with `run`: the first line of their run of consecutive lines of one doc prefix."""
    piped = rows.where(F.contains("body", F.lit("|")))
    near = Window.partitionBy("path").orderBy("line_no")
    new = (F.lag("line_no").over(near) != F.col("line_no") - 1) | (F.lag("prefix").over(near) != F.col("prefix")) | F.lag("line_no").over(near).isNull()
    starts = piped.withColumn("__start", F.when(new, F.col("line_no")))
    return starts.withColumn("run", F.max("__start").over(near.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def tables(rows: DataFrame) -> DataFrame:
    """Rows of runs that are tables: place (1 header, 2 delimiter), cells padded to the header, and the columns' alignments."""
    split = runs(rows).withColumn("cells", C.cells(F.col("body")))
    run = Window.partitionBy("path", "run").orderBy("line_no")
    placed = split.withColumn("place", F.row_number().over(run))
    whole = Window.partitionBy("path", "run")
    header = F.max(F.when(F.col("place") == 1, F.size("cells"))).over(whole)
    marks = F.max(F.when(F.col("place") == 2, F.col("cells"))).over(whole)
    ok = (F.size("marks") == F.col("n")) & (F.col("n") > 0) & F.forall("marks", lambda m: F.regexp_like(m, F.lit("^:?-+:?$")))
    placed = placed.withColumn("n", header).withColumn("marks", marks).where(F.coalesce(ok, F.lit(False)))
    wide = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("n"))), 1, F.col("n"))
    return placed.withColumn("cells", wide).withColumn("how", F.transform("marks", C.alignment)).drop("marks")


def widths(table_rows: DataFrame) -> DataFrame:
    """(path, run, col, width): the longest cell of each column, in characters, without the delimiter row."""
    cells = table_rows.where("place <> 2").select("path", "run", F.posexplode("cells").alias("col", "cell"))
    return cells.groupBy("path", "run", "col").agg(F.max(F.length("cell")).alias("width"))


def rebuilt(table_rows: DataFrame) -> DataFrame:
    """(path, run, line_no, body, new_body) of every table row."""
    columns = widths(table_rows).groupBy("path", "run").agg(F.array_sort(F.collect_list(F.struct("col", "width"))).alias("w"))
    joined = table_rows.join(columns, ["path", "run"])
    cells = F.when(
        F.col("place") == 2, F.zip_with("w", "how", lambda w, h: C.delimiter(w["width"], h))
    ).otherwise(F.transform("cells", lambda c, i: C.padded(c, F.get("w", i)["width"], F.get("how", i))))
    return joined.select("path", "run", "line_no", "body", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")).alias("new_body"))


def changed_runs(table_rows: DataFrame) -> DataFrame:
    """(path, run) of tables that realigning would change."""
    return rebuilt(table_rows).groupBy("path", "run").agg(F.bool_or(F.col("body") != F.col("new_body")).alias("changed")).where("changed").select("path", "run")
