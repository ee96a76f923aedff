"""Fixes of texts: tables, fences and links. One row a file, one pass, no shuffle.

Every operator takes files (path, ext, text and any further columns) and adds
`new_text` and `found`, what its records are made of. `when`, a condition, keeps files out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import text as kernels

FOUND = "array<struct<line:int,old:string,new:string>>"
_KIND = pa.list_(pa.struct([("line", pa.int32()), ("old", pa.string()), ("new", pa.string())]))


def per_file(files: DataFrame, kernel, extra: tuple[str, ...] = (), when: Column | None = None) -> DataFrame:
    """Adds (new_text, found) from kernel(text, *extra columns); a null text stays null."""
    names = files.columns
    schema = T.StructType([*files.schema.fields, T.StructField("new_text", T.StringType()), *T.StructType.fromDDL(f"found {FOUND}").fields])
    at = [names.index(c) for c in ("text", *extra)]
    n = len(names)

    def run(it):
        for batch in it:
            texts, found = [], []
            for go, *row in zip(batch.column(n).to_pylist(), *(batch.column(i).to_pylist() for i in at)):
                new, what = kernel(*row) if go and row[0] is not None else (row[0], [])
                texts.append(new)
                found.append(what)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array(found, _KIND)], names=[*names, "new_text", "found"])

    go = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    return files.withColumn("__go", go).mapInArrow(run, schema)


def _row(line=None, old=None, new=None) -> dict:
    return {"line": line, "old": old, "new": new}


def table_kernel(text: str) -> tuple[str, list[dict]]:
    new = kernels.fix_tables(text)
    return new, [_row()] if new != text else []


def fence_kernel(text: str) -> tuple[str, list[dict]]:
    new, lines = kernels.fix_fences(text)
    return new, [_row(line) for line in lines]


def link_kernel(text: str, least: int = 1) -> tuple[str, list[dict]]:
    new, pairs = kernels.fix_links(text, least)
    return new, [_row(None, f"[{t}]({u})", f"[{t}]") for t, u in pairs]


def fix_tables(files: DataFrame, when: Column | None = None) -> DataFrame:
    """Aligned tables; found has one element if anything changed."""
    return per_file(files, table_kernel, when=when)


def fix_fences(files: DataFrame, when: Column | None = None) -> DataFrame:
    """Nested fences with alternate markers; found has the flipped lines."""
    return per_file(files, fence_kernel, when=when)


def fix_links(files: DataFrame, least: int | str = 1, when: Column | None = None) -> DataFrame:
    """Links that occur `least` times (a number, or a column's name) hoisted; found has (old, new) of each."""
    if isinstance(least, str):
        return per_file(files, link_kernel, (least,), when)
    return per_file(files, lambda text: link_kernel(text, least), when=when)
