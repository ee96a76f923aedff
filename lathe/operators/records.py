"""Records of all operators: one relation, its order, and its JSON and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OP_RANK = {"tables": 0, "fences": 1, "links": 2, "reorder": 3, "vis": 4, "lints": 5}
FIELDS = ("path", "line", "severity", "code", "message", "item_kind", "item_name")


def success(df: DataFrame, op: str, code: str, line: Column, message: Column, kind: Column, name: Column, seq: Column) -> DataFrame:
    """Change records: severity success."""
    return df.select("path", F.lit(OP_RANK[op]).alias("op"), seq.cast("int").alias("seq"), line.cast("int").alias("line"), F.lit("success").alias("severity"), F.lit(code).alias("code"), message.alias("message"), kind.alias("item_kind"), name.cast("string").alias("item_name"))


def fix_records(fixed: DataFrame, op: str) -> DataFrame:
    """Records of the fixes tables, fences or links from (path, found)."""
    rows = fixed.select("path", F.posexplode("found").alias("at", "f"))
    kind, message = {
        "tables": ("table", F.lit("tables were aligned")),
        "fences": ("fence", F.concat(F.lit("flip nested fence at line "), F.col("f.line"))),
        "links": ("link", F.concat(F.lit("`"), F.col("f.old"), F.lit("` -> `"), F.col("f.new"), F.lit("`"))),
    }[op]
    return success(rows, op, "FIX", F.col("f.line"), message, F.lit(kind), F.lit(None), F.col("at"))


def reorder_records(reordered: DataFrame) -> DataFrame:
    rows = reordered.select("path", F.posexplode("found").alias("at", "f"))
    return success(rows, "reorder", "REORDER", F.col("f.line"), F.col("f.message"), F.col("f.kind"), F.col("f.name"), F.col("at"))


def vis_records(found: DataFrame) -> DataFrame:
    return success(found, "vis", "VIS", F.col("line"), F.col("message"), F.col("item_kind"), F.col("item_name"), F.col("seq"))


def lint_records(lints: DataFrame) -> DataFrame:
    return lints.select("path", F.lit(OP_RANK["lints"]).alias("op"), (F.col("idx") * 8 + F.col("check")).cast("int").alias("seq"), "line", "severity", "code", "message", "item_kind", "item_name")


def in_text_order(records: DataFrame, positions: DataFrame) -> DataFrame:
    """By file, then operator: the order of the text report. positions: (path, pos)."""
    return records.join(positions, "path").orderBy("pos", "op", "seq")


def in_json_order(records: DataFrame, positions: DataFrame) -> DataFrame:
    """All lints by file, then all changes by file."""
    return records.join(positions, "path").orderBy((F.col("severity") == "success").cast("int"), "pos", "op", "seq")


def json_objects(records: DataFrame) -> DataFrame:
    """One JSON object a record; a missing line or name is null."""
    return records.withColumn("json", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}))


def as_text(records: DataFrame) -> DataFrame:
    """One printed line a record."""
    line = F.coalesce(F.concat(F.col("line").cast("string"), F.lit(": ")), F.lit(""))
    lint_line = F.concat(F.coalesce(F.col("line"), F.lit(0)).cast("string"), F.lit(": "))
    who = F.concat(F.lit(" ("), F.col("item_kind"), F.coalesce(F.concat(F.lit(" `"), F.col("item_name"), F.lit("`")), F.lit("")), F.lit(")"))
    head = F.when(F.col("severity") == "success", line).otherwise(lint_line)
    return records.withColumn("report", F.concat("path", F.lit(":"), head, "severity", F.lit("["), "code", F.lit("]: "), "message", who))


def exit_status(records: DataFrame, failed_files: int = 0, failed_steps: int = 0) -> int:
    """1 if a step or a file failed or a lint is an error; one row comes back."""
    errors = records.where("severity = 'error'").limit(1).count()
    return int(bool(failed_steps or failed_files or errors))
