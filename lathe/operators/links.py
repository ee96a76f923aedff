"""Inline links as relations: fenced lines, pair counts, eligible pairs, definitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.functions import columns as C
from lathe.functions import text as kernels
from lathe.operators.tables import lines

FENCE = "(?U)^\\s*(`{3,}|~{3,})(.*)$"


def fence_lines(rows: DataFrame) -> DataFrame:
    """(path, line_no, marker, run, info) of lines that could be delimiters."""
    found = rows.where(F.regexp_like("body", F.lit(FENCE)))
    mark = F.regexp_extract("body", FENCE, 1)
    return found.select("path", "line_no", F.substring(mark, 1, 1).alias("marker"), F.length(mark).alias("run"), F.regexp_extract("body", FENCE, 2).alias("info"))


def fence_intervals(rows: DataFrame) -> DataFrame:
    """(path, first, last) of fenced blocks with their delimiters; an open one lasts to the end. One fence is open at most.

    The fold runs over delimiter lines only.
    """
    marks = F.array_sort(F.collect_list(F.struct("line_no", "marker", "run", "info")))
    folded = fence_lines(rows).groupBy("path").agg(marks.alias("marks"))
    state = "cast(null as struct<line_no:int,marker:string,run:int>)"
    expr = f"""aggregate(marks, named_struct('open', {state}, 'done', cast(array() as array<struct<first:int,last:int>>)),
        (s, m) -> case
            when s.open is null then named_struct('open', named_struct('line_no', m.line_no, 'marker', m.marker, 'run', m.run), 'done', s.done)
            when m.info = '' and m.marker = s.open.marker and m.run >= s.open.run
                then named_struct('open', {state}, 'done', concat(s.done, array(named_struct('first', s.open.line_no, 'last', m.line_no))))
            else s end,
        s -> case when s.open is null then s.done else concat(s.done, array(named_struct('first', s.open.line_no, 'last', 2147483647))) end)"""
    return folded.select("path", F.inline(F.expr(expr)))


def outside_fences(rows: DataFrame) -> DataFrame:
    """The lines that no fence covers: a range join on path."""
    return rows.join(fence_intervals(rows).withColumnRenamed("path", "__path"), (F.col("path") == F.col("__path")) & F.col("line_no").between(F.col("first"), F.col("last")), "left_anti")


def inline_links(rows: DataFrame) -> DataFrame:
    """(path, line_no, pos, label, url, definition): links of lines, in order; a definition line has its label alone."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("label", pa.string()), ("url", pa.string())]))

    def run(it):
        for batch in it:
            links = [[{"pos": a, "label": t, "url": u} for t, u, a, _ in kernels.inline_links(b)] for b in batch.column(2).to_pylist()]
            labels = [kernels.definition_label(b) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, kind), pa.array(labels, pa.string())], names=["path", "line_no", "links", "definition"])

    found = rows.where(F.contains("body", F.lit("["))).select("path", "line_no", "body").mapInArrow(run, "path string, line_no int, links array<struct<pos:int,label:string,url:string>>, definition string")
    return found.select("path", "line_no", "definition", F.inline_outer("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(path, label, url, n, first_line, first_pos)."""
    seen = links.where("label is not null")
    return seen.groupBy("path", "label", "url").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first")).select("path", "label", "url", "n", F.col("first.line_no").alias("first_line"), F.col("first.pos").alias("first_pos"))


def hoisted(links: DataFrame, least: int = 1) -> DataFrame:
    """Pairs to hoist: common enough, label not defined, the first url of a label."""
    defined = links.where("definition is not null").select("path", F.col("definition").alias("label")).distinct()
    pairs = pair_counts(links).where(F.col("n") >= max(least, 1)).join(defined, ["path", "label"], "left_anti")
    first = Window.partitionBy("path", "label").orderBy("first_line", "first_pos")
    return pairs.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def rust_context(rows: DataFrame) -> DataFrame:
    """Paths whose text outside fences holds a doc comment."""
    inside = fence_intervals(rows).withColumnRenamed("path", "__path")
    free = rows.join(inside, (F.col("path") == F.col("__path")) & (F.col("line_no") > F.col("first")) & (F.col("line_no") < F.col("last")), "left_anti")
    return free.where("prefix <> ''").select("path").distinct()


def links_of(files: DataFrame) -> DataFrame:
    return inline_links(outside_fences(lines(files.where(F.contains("text", F.lit("["))))))


def ending_profile(files: DataFrame) -> DataFrame:
    """(path, crlf, lf, ending) of each text."""
    text = F.col("text")
    crlf = C.occurrences(text, "\r\n")
    return files.select("path", crlf.alias("crlf"), (C.occurrences(text, "\n") - crlf).alias("lf"), F.when(C.dominant_ending(text) == "\r\n", "crlf").otherwise("lf").alias("ending"))
