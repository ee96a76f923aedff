"""Lints over items: seven predicates in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe import schema
from lathe.functions.columns import has_word, trim_all

ARGUMENT_HEADERS = ["# " + w for w in ("arguments", "argument", "parameters", "parameter", "params", "param")]
ERROR_HEADERS = ["# errors"]

PLACEHOLDERS = ("todo", "fixme", "tbd")


def documentable() -> Column:
    return F.col("kind").isin(*schema.DOCUMENTABLE)


def header_at(headers: list[str]) -> Column:
    """The place (from 1) of the first doc line that is one of these headers; 0 if there is none."""
    return F.coalesce(F.array_position(F.transform("__trimmed", lambda d: F.lower(d).isin(*headers)), F.lit(True)), F.lit(0)).cast("int")


def section(at: Column) -> Column:
    """Doc lines after a header, up to the next one."""
    rest = F.slice("__trimmed", at + 1, F.size("doc_comments"))
    end = F.array_position(F.transform(rest, lambda d: F.startswith(d, F.lit("# "))), F.lit(True)).cast("int")
    return F.slice("doc_comments", at + 1, F.when(end > 0, end - 1).otherwise(F.size("doc_comments")))


def prepared(items: DataFrame) -> DataFrame:
    """Items with what several checks ask of doc lines, each worked out once."""
    own = items.withColumn("__trimmed", F.transform("doc_comments", trim_all))
    own = own.withColumn("__errors", header_at(ERROR_HEADERS)).withColumn("__arguments", header_at(ARGUMENT_HEADERS))
    own = own.withColumn("__error_body", F.when(F.col("__errors") > 0, section(F.col("__errors")))).withColumn("__argument_body", F.when(F.col("__arguments") > 0, section(F.col("__arguments"))))
    missing = F.filter("params", lambda p: ~F.exists("__argument_body", lambda d: has_word(d, p)))
    return own.withColumn("__missing", F.when(_public_fn() & (F.size("params") > 0) & (F.col("__arguments") > 0), missing))


def _public_fn() -> Column:
    return (F.col("kind") == "fn") & (F.col("vis") == schema.PUB)


def missing_docs() -> Column:
    return F.col("vis").isNotNull() & (F.col("vis") != schema.PRIVATE) & documentable() & ~F.col("is_test_module") & (F.size("doc_comments") == 0)


def missing_errors() -> Column:
    return _public_fn() & F.col("returns_result") & (F.col("__errors") == 0)


def vague_errors() -> Column:
    return _public_fn() & F.col("returns_result") & (F.col("__errors") > 0) & ~F.exists("__error_body", lambda d: F.contains(d, F.lit("::")))


def missing_arguments() -> Column:
    return _public_fn() & (F.size("params") > 0) & (F.col("__arguments") == 0)


def undocumented_param() -> Column:
    """Some parameter that no line of the arguments section names."""
    return F.size("__missing") > 0


def placeholder() -> Column:
    return documentable() & F.exists("doc_comments", lambda d: has_word(d, PLACEHOLDERS[0]) | has_word(d, PLACEHOLDERS[1]) | has_word(d, PLACEHOLDERS[2]))


def bad_test_name() -> Column:
    return F.col("is_test_fn") & F.regexp_like("name", F.lit("^(test|(test|case)_[\\s\\S]*|test[0-9]+)$"))


def checks() -> list[tuple[str, str, Column, Column]]:
    """(code, severity, predicate, message) in the order of reports."""
    named = F.concat(F.lit("test function `"), F.col("name"), F.lit("` should use a behavioral name"))
    shape = F.lit(" (subject_should_expectation_when_condition), ")
    return [
        ("DOC001", "error", missing_docs(), F.lit("non-private item is missing a doc comment")),
        ("DOC002", "error", missing_errors(), F.lit("pub fn returning Result is missing a `# Errors` doc section")),
        ("DOC003", "warning", vague_errors(), F.lit("`# Errors` section does not name any concrete error variant")),
        ("DOC004", "warning", missing_arguments(), F.lit("pub fn with parameters is missing a `# Arguments` doc section")),
        ("DOC005", "warning", undocumented_param(), F.concat(F.lit("parameter(s) not documented in the `# Arguments` section: `"), F.array_join("__missing", "`, `"), F.lit("`"))),
        ("DOC006", "warning", placeholder(), F.lit("doc comment contains placeholder text (TODO/FIXME/TBD)")),
        ("TEST001", "warning", bad_test_name(), F.concat(named, shape, F.lit("not a `test_*` or "), F.lit("`case_*` prefix"))),
    ]


def run_all(items: DataFrame, codes: tuple[str, ...] = schema.LINT_CODES) -> DataFrame:
    """Records of all checks with (idx, check) to order them; items are read once."""
    found = [
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(k).alias("check"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")))
        for k, (code, severity, when, message) in enumerate(checks())
        if code in codes
    ]
    if not found:
        return items.limit(0).select("path", "idx", F.lit(0).alias("check"), F.col("start_line").alias("line"), F.lit("").alias("severity"), F.lit("").alias("code"), F.lit("").alias("message"), F.col("kind").alias("item_kind"), F.col("name").alias("item_name"))
    hit = prepared(items).select("path", "idx", "start_line", "kind", "name", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d"))
    line = F.when(F.col("start_line") > 0, F.col("start_line"))
    return hit.select("path", "idx", "d.check", line.alias("line"), "d.severity", "d.code", "d.message", F.col("kind").alias("item_kind"), F.col("name").alias("item_name"))
