"""Which operators run on which file: groups of globs, white and black lists, thresholds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe import schema

RULES = (*schema.LINT_CODES, *schema.OPS)


def glob_regex(pattern: str) -> str:
    """* and ? stay within a folder, ** crosses folders, [..] and {a,b} as in shells."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out.append(".+")
            i += 2
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed alternative in glob {pattern!r}")
    return "^" + "".join(out) + "$"


def exact_path(pattern: str) -> str | None:
    """The one path that a glob without wildcards matches; None for others."""
    return None if re.search(r"[*?\[{\\]", pattern) else pattern


def check_rules(names, what: str) -> None:
    for n in names:
        if n not in RULES:
            raise ValueError(f"unknown rule {n!r} in {what}; known: {', '.join(RULES)}")


def groups_frame(spark, groups: list[tuple[list[str], list[str]]]) -> DataFrame:
    """(grp, re, rules, exact) from (globs, rules) of each group: as many rows as the configuration has globs. exact: the path that one without wildcards matches."""
    rows = [(g, glob_regex(p), rules, exact_path(p)) for g, (globs, rules) in enumerate(groups) for p in globs]
    return spark.createDataFrame(rows, "grp int, re string, rules array<string>, exact string")


def matched_rules(files: DataFrame, groups: DataFrame) -> DataFrame:
    """(rel, rules): all rules of the groups that match; a theta join with the broadcast globs (bounded by the configuration), of which those without wildcards are looked up."""
    paths = files.select("rel").distinct()
    globs, exact = groups.where("exact is null"), groups.where("exact is not null")
    hit = paths.join(F.broadcast(globs), F.regexp_like("rel", F.col("re"))).unionByName(paths.join(F.broadcast(exact), F.col("rel") == F.col("exact")))
    return hit.select("rel", F.explode("rules").alias("rule")).groupBy("rel").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def policies(files: DataFrame, groups: DataFrame | None, white: bool, skipped: Sequence[str] = ()) -> DataFrame:
    """files with (skip, enabled, disabled). white: groups include, and a file that none matches runs nothing; else they exclude. skipped: globs.

    A file outside the configuration's folder has a null `rel`, and an empty policy.
    """
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    if groups is None:
        out = files.withColumn("rules", F.lit(None).cast("array<string>"))
    else:
        out = files.join(matched_rules(files.where("rel is not null"), groups), "rel", "left")
    inside = F.col("rel").isNotNull()
    out = out.withColumn("enabled", F.when(inside & F.lit(white), rules)).withColumn("disabled", F.when(inside & F.lit(not white), rules).otherwise(F.array().cast("array<string>"))).drop("rules")
    skip, spark = F.lit(False), files.sparkSession
    exact = {p for p in map(exact_path, skipped) if p is not None}
    if exact:  # a list of files may be as long as the table: each file looks itself up
        out = out.join(F.broadcast(spark.createDataFrame([(p, True) for p in sorted(exact)], "rel string, __exact boolean")), "rel", "left")
        skip = skip | F.col("__exact").isNotNull()
    globs = [(glob_regex(g),) for g in skipped if exact_path(g) is None]
    if globs:
        hit = files.where("rel is not null").select("rel").distinct().join(F.broadcast(spark.createDataFrame(globs, "re string")), F.regexp_like("rel", F.col("re")))
        out = out.join(hit.select("rel", F.lit(True).alias("__glob")).distinct(), "rel", "left")
        skip = skip | F.col("__glob").isNotNull()
    return out.withColumn("skip", skip).drop("__exact", "__glob")


def override(policy: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """include replaces the white list and clears the black one; exclude adds to the black one and leaves the white one."""
    if include:
        policy = policy.withColumn("enabled", F.array(*map(F.lit, include))).withColumn("disabled", F.array().cast("array<string>"))
    if exclude:
        gone = F.array(*map(F.lit, exclude))
        policy = policy.withColumn("disabled", F.array_union("disabled", gone)).withColumn("enabled", F.when(F.col("enabled").isNotNull(), F.array_except("enabled", gone)))
    return policy


def runs(op: str) -> Column:
    """Whether an operator runs on a file of this policy."""
    allowed = F.when(F.col("enabled").isNull(), ~F.array_contains("disabled", op)).otherwise(F.array_contains("enabled", op))
    return ~F.col("skip") & allowed


def lints_run() -> Column:
    some = F.array_contains("enabled", "lints") | F.arrays_overlap("enabled", F.array(*map(F.lit, schema.LINT_CODES)))
    return ~F.col("skip") & ~F.array_contains("disabled", "lints") & (F.col("enabled").isNull() | some)


def silent_codes() -> Column:
    """Lint codes that a file's policy turns off."""
    codes = F.array(*map(F.lit, schema.LINT_CODES))
    named = F.array_intersect(codes, F.col("disabled"))
    narrow = F.col("enabled").isNotNull() & ~F.array_contains("enabled", "lints")
    return F.when(narrow, F.array_union(named, F.array_except(codes, F.col("enabled")))).otherwise(named)


def suppress(lints: DataFrame, policy: DataFrame) -> DataFrame:
    """Lints without the codes that their file's policy turns off."""
    off = policy.select(F.col("path").alias("__path"), silent_codes().alias("__off")).where(F.size("__off") > 0)
    return lints.join(off, (F.col("path") == F.col("__path")) & F.array_contains("__off", F.col("code")), "left_anti")


def link_threshold(ext: Column, by_extension: dict[str, int], everywhere: int | None) -> Column:
    """The threshold of an extension, exactly as it is written, else the one for all, else 1."""
    out = F.lit(everywhere if everywhere is not None else 1)
    if by_extension:
        pairs = [F.lit(x) for kv in by_extension.items() for x in kv]
        out = F.coalesce(F.try_element_at(F.create_map(*pairs), ext), out)
    return out.cast("int")


def dead_globs(groups: DataFrame, files: DataFrame) -> DataFrame:
    """(grp, re) of globs that no file matches."""
    paths = files.select("rel").distinct()
    globs, exact = groups.where("exact is null"), groups.where("exact is not null")
    return globs.join(paths, F.regexp_like("rel", F.col("re")), "left_anti").unionByName(exact.join(paths, F.col("rel") == F.col("exact"), "left_anti")).select("grp", "re")
