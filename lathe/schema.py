"""Schemas of the relations that operators hand on."""

from __future__ import annotations

FILES = "path string, ext string, text string"

ITEM_FIELDS = (
    "idx int, start int, end int, start_line int, kind string, name string, impl_target string, is_test_module boolean, "
    "is_inline boolean, is_trait_impl boolean, vis int, doc_comments array<string>, returns_result boolean, params array<string>, is_test_fn boolean"
)
ITEMS = "path string, " + ITEM_FIELDS
RECORDS = "path string, line int, severity string, code string, message string, item_kind string, item_name string"
#: Records with the order in which they are reported.
ORDERED = "path string, op int, seq int, line int, severity string, code string, message string, item_kind string, item_name string"

KINDS = ("fn", "struct", "enum", "type", "union", "impl", "use", "const", "static", "mod", "extern", "trait", "macro", "macro-invocation", "other")
DOCUMENTABLE = ("fn", "struct", "enum", "union", "type", "trait", "const", "static")
LINT_CODES = ("DOC001", "DOC002", "DOC003", "DOC004", "DOC005", "DOC006", "TEST001")
OPS = ("tables", "fences", "links", "reorder", "vis", "lints")
PUB, RESTRICTED, PRIVATE = 0, 1, 2
