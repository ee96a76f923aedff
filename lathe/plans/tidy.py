"""The whole run: policies, fixes, reordering, visibility and lints over files."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.rustscan import Scan
from lathe.operators import lints, parse, policy, records, reorder, texts, vis
from lathe.sources.config import Config
from lathe.sources.files import has_extension
from lathe.sources.scratch import written

MODES = ("dry_run", "apply")
OPS = ("tables", "fences", "links", "reorder", "vis", "lints")


def with_policy(files: DataFrame, config: Config | None, include=(), exclude=()) -> DataFrame:
    """files with skip, enabled, disabled and links_min."""
    policy.check_rules(include, "include")
    policy.check_rules(exclude, "exclude")
    config = config or Config()
    base = config.base.rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(base)), F.substring("path", len(base) + 1, 1 << 20))
    rel = F.col("path") if config.base == "." else rel
    named = config.include or config.exclude
    groups = policy.groups_frame(files.sparkSession, named) if named else None
    out = policy.policies(files.withColumn("rel", rel), groups, bool(config.include), config.exclude_files).drop("rel")
    out = policy.override(out, list(include), list(exclude))
    return out.withColumn("links_min", policy.link_threshold(F.col("ext"), config.by_extension, config.least))


def crate_context(files: DataFrame, root: str | None) -> tuple[DataFrame, DataFrame] | None:
    """(floors, blocked names by crate) of the crate of this root, from the texts before any change."""
    if root is None:
        return None
    scanned = parse.scan(files.where(has_extension(F.col("ext"), ("rs",))).select("path", "text")).withColumn("crate", F.lit(root))
    edges = vis.module_edges(scanned)
    roots = files.sparkSession.createDataFrame([(root, root)], "crate string, root string")
    names = vis.crate_reexports(scanned).groupBy("crate").agg(F.collect_set("name").alias("blocked"))
    return vis.floors(edges, roots), names


def _floored(files: DataFrame, context) -> DataFrame:
    """floor and blocked of each file: the crate's if its tree has the file, else none and its own."""
    if context is None:
        return files.withColumn("floor", F.lit(None).cast("string")).withColumn("blocked", F.lit(None).cast("array<string>"))
    floors, names = context
    inside = floors.join(names, "crate", "left").select("path", "floor", F.coalesce("blocked", F.array().cast("array<string>")).alias("blocked"))
    return files.join(inside, "path", "left")


def _one_pass(state: DataFrame, apply: bool) -> DataFrame:
    """state (text, goes: a flag for each of OPS, links_min, floor, blocked, path, pos, enabled, disabled, changing) with what all operators find, in one pass over the texts.

    Operators that see one text share its scan.
    """
    kept = ["path", "text", "pos", "enabled", "disabled", "changing"]
    found = T.StructType.fromDDL(f"new_text string, tables {texts.FOUND}, fences {texts.FOUND}, links {texts.FOUND}, reorder array<struct<line:int,kind:string,name:string,message:string>>, vis_old string, vis_new string, failed boolean, {parse.SCANNED.split(', edges')[0]}")
    state = state.select(*kept, "goes", "links_min", "floor", "blocked")
    kinds = [parse.arrow_type(f.dataType) for f in found]

    def run(it):
        for batch in it:
            rows = [_tidied(*r, apply) for r in zip(*(batch.column(c).to_pylist() for c in (1, 6, 7, 8, 9)))]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *found.names])

    return state.mapInArrow(run, T.StructType([*state.select(*kept).schema.fields, *found.fields]))


def _tidied(text: str | None, goes: list[bool], least: int, floor: str | None, blocked: list[str] | None, apply: bool) -> tuple:
    """(new_text, tables, fences, links, moves, text before and after narrowing, failed, items) of one file."""
    if text is None:
        return None, [], [], [], [], None, None, True, []
    scans: dict[str, Scan] = {}

    def scan_of(t: str) -> Scan:
        if t not in scans:
            scans[t] = Scan(t)
        return scans[t]

    now, fixes = text, []
    for go, kernel in zip(goes, (texts.table_kernel, texts.fence_kernel, lambda t: texts.link_kernel(t, least))):
        now, found = kernel(now) if go else (now, [])
        fixes.append(found)
    now, moved, failed = now if apply else text, [], False
    if goes[3]:
        new, moved, failed = reorder.reordered(now, scan_of)
        now = new if apply else now
    old = now
    new = vis.narrowed(old, floor, blocked, scan_of) if goes[4] and not failed and old else old
    now = new if apply else now
    items = scan_of(now).rows() if goes[5] and not failed else []
    return now if apply else text, *fixes, moved, old, new, failed, items


def tidy(files: DataFrame, config: Config | None = None, mode: str = "dry_run", include=(), exclude=(), root: str | None = None, crate_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts, records) of files (path, ext, text, pos).

    texts: path, text, new_text, failed, processed. dry_run: every operator sees the
    original text. apply: each sees what the one before it left, and line numbers are of
    that text. A file that one operator fails on stops there and keeps the records before it.
    root: the root file of a crate, whose module tree and re-exports come from crate_files
    (path, ext, text; the files themselves if there are none), before any change.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    rust = has_extension(F.col("ext"), ("rs",))
    apply = mode == "apply"
    state = with_policy(files.select("path", "ext", "text", "pos"), config, include, exclude)
    state = _floored(state, crate_context(files if crate_files is None else crate_files, root))
    goes = {"tables": policy.runs("tables"), "fences": policy.runs("fences"), "links": policy.runs("links"), "reorder": rust & policy.runs("reorder"), "vis": rust & policy.runs("vis"), "lints": rust & policy.lints_run()}
    changing = goes["tables"] | goes["fences"] | goes["links"] | goes["reorder"] | goes["vis"]
    state = state.withColumn("changing", changing).withColumn("goes", F.array(*(F.coalesce(goes[op], F.lit(False)) for op in OPS)))
    # the whole chain runs once, without a shuffle but for the crate's floors; records and texts read what it leaves
    state = written(files.sparkSession, _one_pass(state, apply))
    hits = lints.run_all(parse.items(state))
    every = [records.fix_records(state.withColumnRenamed(op, "found"), op) for op in ("tables", "fences", "links")]
    every.append(records.reorder_records(state.withColumnRenamed("reorder", "found")))
    narrowed = vis.records(state.select("path", F.col("vis_old").alias("text"), F.col("vis_new").alias("new_text")))
    every.append(records.vis_records(narrowed))
    every.append(records.lint_records(policy.suppress(hits, state.select("path", "enabled", "disabled"))))
    out = state.select("path", "text", "new_text", "failed", (F.col("changing") & ~F.col("failed")).alias("processed"), "pos")
    return out, reduce(DataFrame.unionByName, every)


def validate_config(text: str) -> Config:
    """Compiles a configuration, or raises ValueError."""
    from lathe.sources.config import parse as parse_config

    return parse_config(text)
