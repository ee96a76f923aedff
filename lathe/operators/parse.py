"""Rust source to items, references and declarations: one scan a file gives all of them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe import schema
from lathe.functions.rustscan import Scan

SCANNED = (
    f"items array<struct<{', '.join(f.replace(' ', ':', 1) for f in schema.ITEM_FIELDS.split(', '))}>>, edges array<struct<src:int,dst:int>>, "
    "modules array<struct<name:string,path_attr:string,vis:string>>, reexports array<string>, preamble_end int, trailer_start int"
)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return {T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}[type(kind)]


def scan(files: DataFrame) -> DataFrame:
    """Files with what the scanner finds in them; a null text has nothing."""
    names = files.columns
    added = T.StructType.fromDDL(SCANNED)
    out = T.StructType([*files.schema.fields, *added.fields])
    kinds, added_names = [arrow_type(f.dataType) for f in added], added.names
    text_at = names.index("text")

    def run(it):
        for batch in it:
            rows = []
            for text in batch.column(text_at).to_pylist():
                s = Scan(text or "")
                rows.append((s.rows(), [{"src": a, "dst": b} for a, b in s.edges()], [dict(zip(("name", "path_attr", "vis"), m)) for m in s.modules()], sorted(s.reexports()), s.preamble_end, s.trailer_start))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *added_names])

    return files.mapInArrow(run, out)


def items(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", F.inline("items"))


def edges(scanned: DataFrame) -> DataFrame:
    return scanned.select("path", F.inline("edges"))
