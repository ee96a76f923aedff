"""Reordering of items: per file in one pass, with the relational parts beside it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import ordering
from lathe.functions.columns import content_of, dominant_ending, segments, trim_all
from lathe.functions.rustscan import Scan
from lathe.functions.text import SPACE, line_ending

PHASES = [
    (("extern", "other"), 1), (("use",), 2), (("macro",), 4), (("const", "static"), 5),
    (("struct", "enum", "union", "type"), 6), (("trait",), 7), (("impl",), 8), (("fn",), 9),
]


def lines_kept(old: str, new: str) -> bool:
    """Equal multisets of non-blank lines, and one dominant line ending."""
    kept = lambda t: sorted(x for line in t.split("\n") if (x := line.removesuffix("\r")).strip(SPACE))
    return kept(old) == kept(new) and line_ending(old) == line_ending(new)


MOVES = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("message", pa.string())]))


def reordered(text: str, scan_of=Scan) -> tuple[str, list[dict], bool]:
    """(new text, moves, whether the text is broken and stays)."""
    if not text.strip(SPACE):
        return text, [], False
    scan = scan_of(text)
    items = scan.rows()
    order = ordering.order_items(items, scan.edges())
    new = ordering.emit(text, items, order, scan.preamble_end, scan.trailer_start, line_ending(text), SPACE)
    if sorted(order) != list(range(len(items))) or not lines_kept(text, new):
        return text, [], True
    return new, [{"line": items[k]["start_line"], "kind": items[k]["kind"], "name": items[k]["name"], "message": m} for k, m in ordering.moves(items, order)], False


def reorder(files: DataFrame, when: Column | None = None) -> DataFrame:
    """Files with new_text, found (line, kind, name, message of each move), and broken.

    A file whose lines would not be kept keeps its text and is broken: among
    them non-blank files without items. A blank file keeps its text.
    """
    names = files.columns
    out = T.StructType([*files.schema.fields, *T.StructType.fromDDL("new_text string, found array<struct<line:int,kind:string,name:string,message:string>>, broken boolean").fields])
    n, text_at = len(names), names.index("text")

    def run(it):
        for batch in it:
            rows = [reordered(t) if go and t is not None else (t, [], False) for go, t in zip(batch.column(n).to_pylist(), batch.column(text_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], MOVES), pa.array([r[2] for r in rows], pa.bool_())], names=[*names, "new_text", "found", "broken"])

    go = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return files.withColumn("__go", go).mapInArrow(run, out)


# relational parts


def phases(items: DataFrame) -> DataFrame:
    """Items with `phase` 1 to 10 and `tier`, the visibility group of functions."""
    local = items.where("kind = 'macro' and name is not null").select(F.col("path").alias("__p"), F.col("name").alias("__n")).distinct()
    joined = items.join(local, (F.col("path") == F.col("__p")) & (F.col("name") == F.col("__n")), "left")
    phase = F.when(F.col("kind") == "mod", F.when(F.col("is_test_module") & F.col("is_inline"), 10).otherwise(3))
    phase = phase.when(F.col("kind") == "macro-invocation", F.when(F.col("__n").isNotNull(), 4).otherwise(1))
    for kinds, number in PHASES:
        phase = phase.when(F.col("kind").isin(*kinds), number)
    return joined.withColumn("phase", phase).withColumn("tier", F.when(F.col("kind") == "fn", F.coalesce("vis", F.lit(2)))).drop("__p", "__n")


def name_index(items: DataFrame) -> DataFrame:
    """(path, name, idx): the first item of each name."""
    return items.where("name is not null").groupBy("path", "name").agg(F.min("idx").alias("idx"))


def edges_of(references: DataFrame, items: DataFrame) -> DataFrame:
    """(path, src, dst) from references (path, src, name, is_call): a local macro's call is reversed, self-edges go."""
    target = name_index(items).withColumnRenamed("idx", "to")
    macros = items.where("kind = 'macro'").select("path", "name", F.lit(True).alias("__macro")).distinct()
    joined = references.join(target, ["path", "name"]).join(macros, ["path", "name"], "left").where("src <> to")
    back = F.col("is_call") & F.coalesce("__macro", F.lit(False))
    return joined.select("path", F.when(back, F.col("to")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("to")).alias("dst"))


def group_edges(edges: DataFrame, phased: DataFrame) -> DataFrame:
    """Edges whose ends share a phase, and a tier for functions."""
    own = phased.select("path", "idx", F.concat_ws("/", "phase", "tier").alias("g"))
    a = own.select("path", F.col("idx").alias("src"), F.col("g").alias("__a"))
    b = own.select("path", F.col("idx").alias("dst"), F.col("g").alias("__b"))
    return edges.join(a, ["path", "src"]).join(b, ["path", "dst"]).where("__a = __b").select("path", "src", "dst")


def impl_placement(items: DataFrame) -> DataFrame:
    """(path, idx, place) of impls after the other items given (path, idx, name, out_pos): inherent first, by the first item of the target's name, orphans last."""
    first = items.where("kind <> 'impl' and name is not null").groupBy("path", F.col("name").alias("impl_target")).agg(F.min("out_pos").alias("__at"))
    impls = items.where("kind = 'impl'").join(first, ["path", "impl_target"], "left")
    order = Window.partitionBy("path").orderBy(F.col("__at").isNull(), "is_trait_impl", "__at", "idx")
    return impls.select("path", "idx", "is_trait_impl", "impl_target", F.row_number().over(order).alias("place"))


def macro_layout(items: DataFrame) -> DataFrame:
    """(path, idx, place): macro definitions by def_pos, each followed by its calls in source order; the first definition of a name takes the calls."""
    defs = items.where("kind = 'macro'")
    first = defs.groupBy("path", "name").agg(F.min("def_pos").alias("at"))
    calls = items.where("kind = 'macro-invocation'").drop("def_pos").join(first, ["path", "name"]).select("path", "idx", "at", F.lit(1).alias("call"))
    order = Window.partitionBy("path").orderBy("at", "call", "idx")
    return defs.select("path", "idx", F.col("def_pos").alias("at"), F.lit(0).alias("call")).unionByName(calls).select("path", "idx", F.row_number().over(order).alias("place"))


def moves(ordered: DataFrame) -> DataFrame:
    """(path, to, from, before, kind, name, line, message) of items (path, idx, out_pos, kind, name, start_line; idx and out_pos from 0) that come earlier."""
    where = F.concat(F.col("kind"), F.lit(" at line "), F.col("start_line"))
    order = Window.partitionBy("path").orderBy("out_pos")
    nxt = ordered.withColumn("before", F.lead(F.coalesce("name", where)).over(order))
    who = F.when(F.col("name").isNotNull(), F.concat_ws(" ", "kind", "name")).otherwise(where)
    to, from_ = F.col("out_pos") + 1, F.col("idx") + 1
    message = F.concat(F.lit("rearrange "), who, F.lit(" from pos "), from_, F.lit(" to pos "), to, F.coalesce(F.concat(F.lit(" (before "), F.col("before"), F.lit(")")), F.lit("")))
    return nxt.where(from_ > to).select("path", to.alias("to"), from_.alias("from"), "before", "kind", "name", F.col("start_line").alias("line"), message.alias("message"))


def permutation_faults(ordered: DataFrame) -> DataFrame:
    """Paths whose (idx, out_pos) is no permutation of 0 to n - 1."""
    n = F.count("*")
    whole = ordered.groupBy("path").agg(n.alias("n"), F.count_distinct("idx").alias("d"), F.count_distinct("out_pos").alias("e"), F.max("idx").alias("hi"), F.max("out_pos").alias("ho"), F.min("idx").alias("lo"), F.min("out_pos").alias("lp"))
    return whole.where("d <> n or e <> n or hi <> n - 1 or ho <> n - 1 or lo <> 0 or lp <> 0").select("path")


def spacing(ordered: DataFrame) -> DataFrame:
    """Items in output order with `blank_after`: whether a blank line follows."""
    group = F.when(F.col("kind") == "use", 0).when(F.col("kind") == "mod", 1).when(F.col("kind").isin("const", "static", "extern"), 2)
    order = Window.partitionBy("path").orderBy("out_pos")
    own = ordered.withColumn("__g", group).withColumn("__n", F.lead("__g").over(order)).withColumn("__last", F.lead("out_pos").over(order).isNull())
    return own.withColumn("blank_after", ~F.col("__last") & ~F.coalesce(F.col("__g") == F.col("__n"), F.lit(False))).drop("__g", "__n", "__last")


def line_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line, n_old, n_new) of non-blank lines whose counts differ between two texts of a path."""

    def counted(files: DataFrame, name: str) -> DataFrame:
        rows = files.select("path", F.explode(segments(F.col("text"))).alias("s")).select("path", content_of(F.col("s")).alias("line"))
        return rows.where(trim_all(F.col("line")) != "").groupBy("path", "line").agg(F.count("*").alias(name))

    both = counted(old, "n_old").join(counted(new, "n_new"), ["path", "line"], "full_outer").select("path", "line", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return both.where("n_old <> n_new")


def ending_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose dominant line ending differs."""
    a, b = (x.select("path", dominant_ending(F.col("text")).alias(n)) for x, n in ((old, "a"), (new, "b")))
    return a.join(b, "path").where("a <> b").select("path")
