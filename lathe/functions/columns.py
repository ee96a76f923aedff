"""Column expressions on lines, words and cells that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Not part of a word: neither a Unicode letter or number nor an underscore.
EDGE = r"[\p{IsAlphabetic}\p{N}_]"


def trim_all(c: Column) -> Column:
    """Trims Unicode white space; trim() takes the space alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_word(line: Column, word: Column | str) -> Column:
    """Whole-word match without regard to ASCII case."""
    w = F.lit(word) if isinstance(word, str) else word
    return F.regexp_like(line, F.concat(F.lit(rf"(?i)(?<!{EDGE})\Q"), w, F.lit(rf"\E(?!{EDGE})")))


def segments(text: Column) -> Column:
    """Lines with their terminators, as an array."""
    return F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+"), 0)


def content_of(segment: Column) -> Column:
    return F.regexp_replace(segment, "\r?\n$", "")


def terminator_of(segment: Column) -> Column:
    return F.regexp_extract(segment, "\r?\n$", 0)


def doc_prefix(content: Column) -> Column:
    return F.regexp_extract(content, "^[ \t]*//[/!] ?", 0)


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def dominant_ending(text: Column) -> Column:
    """CRLF if there is one and it is at least as common as a bare line feed."""
    crlf, lf = occurrences(text, "\r\n"), occurrences(text, "\n")
    return F.when((crlf > 0) & (crlf >= lf - crlf), F.lit("\r\n")).otherwise(F.lit("\n"))


def cells(row: Column) -> Column:
    """Cells of a table row: unescaped pipes part them; an empty cell goes at each end."""
    closed = F.regexp_replace(row, r"(?<!\\)((?:\\\\)*\\)$", "$1\n")  # an odd run of backslashes must not take the pipe that is added
    raw = F.regexp_extract_all(F.concat(closed, F.lit("|")), F.lit(r"((?:\\[\s\S]?|[^|\\])*+)\|"), 1)
    parts = F.transform(raw, trim_all)
    parts = F.when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.size(parts) - 1)).otherwise(parts)
    empty = (F.size(parts) > 0) & (F.element_at(parts, -1) == "")
    return F.when(empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def padded(cell: Column, width: Column, how: Column) -> Column:
    """how: n, l, r or c; a centred cell has its odd space on the left."""
    gap = F.greatest(width - F.length(cell), F.lit(0))
    left = F.when(how == "r", gap).when(how == "c", gap - F.floor(gap / 2)).otherwise(F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), cell, F.repeat(F.lit(" "), (gap - left).cast("int")))


def delimiter(width: Column, how: Column) -> Column:
    left, right = how.isin("l", "c").cast("int"), how.isin("r", "c").cast("int")
    return F.concat(F.repeat(F.lit(":"), left), F.repeat(F.lit("-"), F.greatest(width - left - right, F.lit(1)).cast("int")), F.repeat(F.lit(":"), right))


def alignment(mark: Column) -> Column:
    left, right = F.startswith(mark, F.lit(":")), F.endswith(mark, F.lit(":"))
    return F.when(left & right, "c").when(left, "l").when(right, "r").otherwise("n")
