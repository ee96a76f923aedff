"""Visibility: module trees, floors, re-exports, narrowing."""

from __future__ import annotations

import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.rustscan import Scan, narrow
from lathe.sources.scratch import written


def folder(path):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def module_edges(scanned: DataFrame) -> DataFrame:
    """(crate, parent, pos, name, vis, child, warning) of file module declarations of files (crate, path, modules).

    A path attribute is looked up beside the parent, else dir/name.rs, else
    dir/name/mod.rs, dir being the parent's folder. child is null where none is there.
    """
    decl = scanned.select("crate", F.col("path").alias("parent"), F.posexplode("modules").alias("pos", "m")).select("crate", "parent", "pos", "m.*")
    dir_ = folder(F.col("parent"))
    decl = decl.withColumn("c1", F.concat_ws("/", dir_, F.coalesce("path_attr", F.concat("name", F.lit(".rs"))))).withColumn("c2", F.when(F.col("path_attr").isNull(), F.concat_ws("/", dir_, "name", F.lit("mod.rs"))))
    known = scanned.select("crate", F.col("path").alias("at")).distinct()
    one = known.select("crate", F.col("at").alias("c1"), F.lit(True).alias("k1"))
    two = known.select("crate", F.col("at").alias("c2"), F.lit(True).alias("k2"))
    found = decl.join(one, ["crate", "c1"], "left").join(two, ["crate", "c2"], "left")
    child = F.when(F.col("k1"), F.col("c1")).when(F.col("k2"), F.col("c2"))
    no_attr = F.concat("parent", F.lit(": `mod "), "name", F.lit(";` resolves to no `"), "name", F.lit(".rs` or `"), "name", F.lit("/mod.rs`"))
    attr = F.concat("parent", F.lit(': #[path = "'), "path_attr", F.lit('"] target not found'))
    warning = F.when(child.isNull(), F.when(F.col("path_attr").isNull(), no_attr).otherwise(attr))
    return found.select("crate", "parent", "pos", "name", "vis", child.alias("child"), warning.alias("warning"))


def floors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(crate, path, floor) of every file that a crate's root (crate, root) reaches.

    A restricted declaration sets a floor, others inherit. The walk takes the last declaration
    first, and a file's first visit wins. A crate's declarations meet in one task: they are
    as many as its modules.
    """

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        children: dict[str, list] = {}
        for r in rows[rows["parent"].notna()].sort_values(["parent", "pos"]).itertuples():
            if isinstance(r.child, str):
                children.setdefault(r.parent, []).append((r.child, r.vis if isinstance(r.vis, str) else None))
        seen: dict[str, str | None] = {}
        todo = [(rows["root"].dropna().iloc[0], None)] if rows["root"].notna().any() else []
        while todo:
            path, floor = todo.pop()
            if path in seen:
                continue
            seen[path] = floor
            todo += [(c, v if v is not None else floor) for c, v in children.get(path, [])]
        return pd.DataFrame({"crate": [key[0]] * len(seen), "path": list(seen), "floor": pd.Series(list(seen.values()), dtype=object)})

    both = edges.select("crate", "parent", "pos", "child", "vis", F.lit(None).cast("string").alias("root")).unionByName(
        roots.select("crate", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("string").alias("vis"), "root")
    )
    return both.groupBy("crate").applyInPandas(walk, "crate string, path string, floor string")


def floors_by_rounds(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """The same where every file has one declaration: breadth first over the cluster, however large or deep a crate. More than `most` rounds are an error."""
    spark = edges.sparkSession
    level = roots.select("crate", F.col("root").alias("path"), F.lit(None).cast("string").alias("floor"))
    seen = written(spark, level)
    front = seen
    for depth in itertools.count():
        nxt = front.join(edges.where("child is not null").select("crate", F.col("parent").alias("path"), "child", "vis"), ["crate", "path"])
        nxt = nxt.groupBy("crate", F.col("child").alias("path")).agg(F.max(F.coalesce("vis", "floor")).alias("floor"))
        front = written(spark, nxt.join(seen, ["crate", "path"], "left_anti").select("crate", "path", "floor"))
        if front.isEmpty():
            break
        if depth == most:
            raise ValueError(f"files nested deeper than {most} modules")
        seen = seen.unionByName(front)
        if depth % 32 == 31:  # a round reads what is new; only now and then is all of it written again
            seen = written(spark, seen)
    return seen


def warnings(edges: DataFrame) -> DataFrame:
    return edges.where("warning is not null").select("crate", "parent", "pos", "warning")


def crate_reexports(scanned: DataFrame) -> DataFrame:
    """(crate, name): names that any file of the crate re-exports; * for a glob."""
    return scanned.select("crate", F.explode("reexports").alias("name")).distinct()


def unblocked(items: DataFrame, reexports: DataFrame) -> DataFrame:
    """Items (crate, name, ...) that no re-export protects; one glob protects a whole crate."""
    globs = reexports.where("name = '*'").select("crate").distinct()
    return items.join(reexports, ["crate", "name"], "left_anti").join(globs, ["crate"], "left_anti")


ELIGIBLE = ("fn", "struct", "enum", "union", "type", "const", "static", "mod", "trait", "extern")


def narrowed_items(items: DataFrame, file_floors: DataFrame, reexports: DataFrame) -> DataFrame:
    """Top-level items (crate, path, idx, kind, name, vis) that narrow, with their floor."""
    bare = items.where(F.col("kind").isin(*ELIGIBLE) & (F.col("vis") == 0) & F.col("name").isNotNull())
    return unblocked(bare, reexports).join(file_floors.where("floor is not null"), ["crate", "path"])


def narrowed(text: str, floor: str | None, blocked: list[str] | None, scan_of=Scan) -> str:
    """The text with narrowed visibility; without names that are blocked, its own re-exports count."""
    if "pub" not in text:
        return text
    scan = scan_of(text)
    return narrow(text, scan, floor, set(blocked) if blocked is not None else scan.reexports())


def narrow_files(files: DataFrame, when: Column | None = None) -> DataFrame:
    """Files (text, floor, blocked: array of names or null for the file's own) with new_text."""
    names = files.columns
    out = T.StructType([*files.schema.fields, T.StructField("new_text", T.StringType())])
    at, n = [names.index(c) for c in ("text", "floor", "blocked")], len(names)

    def run(it):
        for batch in it:
            new = []
            for go, text, floor, blocked in zip(batch.column(n).to_pylist(), *(batch.column(i).to_pylist() for i in at)):
                new.append(narrowed(text, floor, blocked) if go and text else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(new, pa.string())], names=[*names, "new_text"])

    go = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return files.withColumn("__go", go).mapInArrow(run, out)


def records(changed: DataFrame) -> DataFrame:
    """(path, seq, line, message, item_kind, item_name) of lines that differ between text and new_text; kind and name as read off the new line.

    Lines whose visibility has a space in it, or that an attribute precedes, read as nothing and have no record.
    """
    pairs = changed.where("text <> new_text").select("path", F.posexplode(F.arrays_zip(F.split("text", "\r?\n").alias("old"), F.split("new_text", "\r?\n").alias("new"))).alias("at", "x")).where("not (x.old <=> x.new)")
    rest = F.regexp_extract("x.new", r"(?U)^\s*\S+\s+(.*)$", 1)
    modifiers = r'(?:(?:async|unsafe|default|extern(?:\s+"\S*)?|const(?=\s+(?:async|unsafe|default|extern|fn|struct|enum|union|type|const|static|mod|trait)\b))\s+)*'
    crate = F.regexp_extract(rest, r"^extern\s+crate(?:\s+(\S*))?", 0)
    pattern = rf"^{modifiers}(fn|struct|enum|union|type|const|static|mod|trait)(?=\s|$)\s*(?:(?<=static\s)mut\s+)?(\S*)"
    kind = F.when(crate != "", "extern crate").otherwise(F.regexp_extract(rest, pattern, 1))
    token = F.when(crate != "", F.regexp_extract(rest, r"^extern\s+crate\s+(\S*)", 1)).otherwise(F.regexp_extract(rest, pattern, 2))
    name = F.regexp_extract(token, r"^[^;:(<={]*", 0)
    line = F.col("at") + 1
    found = pairs.select("path", "at", line.alias("line"), kind.alias("item_kind"), name.alias("item_name")).where("item_kind <> ''")
    return found.select("path", F.col("at").alias("seq"), "line", F.concat(F.lit("narrow visibility of `"), "item_name", F.lit("` at line "), "line").alias("message"), "item_kind", "item_name")
