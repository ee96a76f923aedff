"""Sequential text kernels: each takes one document and runs inside an Arrow batch."""

from __future__ import annotations

import re

DOC = re.compile(r"[ \t]*//[/!] ?")
SEGMENT = re.compile(r"[^\n]*\n|[^\n]+")
RUN = re.compile(r"(`{3,}|~{3,})(.*)", re.S)
DELIMITER = re.compile(r":?-+:?\Z")
#: Unicode White_Space, which is what a trim takes; Python's own strip() also takes U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def segments(text: str) -> list[str]:
    """Lines with their terminators; a line ends at a line feed only."""
    return SEGMENT.findall(text)


def terminated(segment: str) -> tuple[str, str]:
    for end in ("\r\n", "\n"):
        if segment.endswith(end):
            return segment[: -len(end)], end
    return segment, ""


def doc_split(content: str) -> tuple[str, str]:
    """(doc prefix with its indent and one space, body)."""
    m = DOC.match(content)
    return (m.group(), content[m.end() :]) if m else ("", content)


def line_ending(text: str) -> str:
    """The dominant line ending: CRLF on ties, if there is one."""
    crlf = text.count("\r\n")
    return "\r\n" if crlf and crlf >= text.count("\n") - crlf else "\n"


# tables


def cells_of(row: str) -> list[str]:
    """Cells of a row: unescaped pipes part them; one empty cell is dropped at each end."""
    out, at, i = [], 0, 0
    while i < len(row):
        if row[i] == "\\":
            i += 2
        elif row[i] == "|":
            out.append(row[at:i].strip(SPACE))
            i += 1
            at = i
        else:
            i += 1
    out.append(row[at:].strip(SPACE))
    if out and out[0] == "":
        out = out[1:]
    if out and out[-1] == "":
        out = out[:-1]
    return out


def alignments(cells: list[str]) -> list[str] | None:
    """For a delimiter row, each column's alignment: n(one), l(eft), r(ight), c(entre)."""
    if not cells or not all(DELIMITER.match(c) for c in cells):
        return None
    return ["nlrc"[c.startswith(":") + 2 * c.endswith(":")] for c in cells]


def padded(cell: str, width: int, how: str) -> str:
    gap = max(width - len(cell), 0)
    if how == "r":
        return " " * gap + cell
    if how == "c":
        return " " * (gap - gap // 2) + cell + " " * (gap // 2)
    return cell + " " * gap


def realigned(rows: list[str]) -> list[str] | None:
    """The rows of a table, aligned; None if they are no table."""
    if len(rows) < 2:
        return None
    header = cells_of(rows[0])
    how = alignments(cells_of(rows[1]))
    if not header or how is None or len(how) != len(header):
        return None
    n = len(header)
    body = [(cells_of(r) + [""] * n)[:n] for r in rows[2:]]
    width = [max(len(r[c]) for r in (header, *body)) for c in range(n)]
    line = lambda r: "| " + " | ".join(padded(r[c], width[c], how[c]) for c in range(n)) + " |"
    marks = [(":" if h in "lc" else "") + "-" * max(w - (h in "lc") - (h in "rc"), 1) + (":" if h in "rc" else "") for w, h in zip(width, how)]
    return [line(header), "| " + " | ".join(marks) + " |", *map(line, body)]


def fix_tables(text: str) -> str:
    """Every table aligned; runs are consecutive lines with a pipe and one doc prefix. Fences don't matter here."""
    if "|" not in text:
        return text
    lines = [(*doc_split(c), t) for c, t in map(terminated, segments(text))]
    out, i = [], 0
    while i < len(lines):
        prefix, body, end = lines[i]
        j = i
        while j < len(lines) and "|" in lines[j][1] and lines[j][0] == prefix:
            j += 1
        new = realigned([x[1] for x in lines[i:j]]) if j > i else None
        if j == i:
            j = i + 1
        for k in range(i, j):
            out.append(prefix + (new[k - i] if new else lines[k][1]) + lines[k][2])
        i = j
    return "".join(out)


# fences


def fence_of(body: str) -> tuple[str, str, int, str] | None:
    """(lead, marker, length of the run, info)."""
    bare = body.lstrip(SPACE)
    m = RUN.match(bare)
    return (body[: len(body) - len(bare)], m.group(1)[0], len(m.group(1)), m.group(2)) if m else None


def fix_fences(text: str) -> tuple[str, list[int]]:
    """(text with the markers of nested fences alternated, flipped lines)."""
    if "`" not in text and "~" not in text:
        return text, []
    out, flipped, open_ = [], [], []  # open_: (source marker, length, marker written)
    for number, segment in enumerate(segments(text), 1):
        content, end = terminated(segment)
        prefix, body = doc_split(content)
        fence = fence_of(body)
        if fence is None:
            out.append(segment)
            continue
        lead, marker, run, info = fence
        if open_ and info == "" and open_[-1][0] == marker and open_[-1][1] <= run:
            want = open_.pop()[2]
        else:
            root = open_[0][0] if open_ else marker
            want = root if len(open_) % 2 == 0 else "~" if root == "`" else "`"
            open_.append((marker, run, want))
        if want != marker:
            flipped.append(number)
        out.append(prefix + lead + want * run + info + end)
    return "".join(out), flipped


# links


class OneFence:
    """Block structure for links: one open fence at most."""

    def __init__(self):
        self.open: tuple[str, int] | None = None

    def step(self, body: str) -> bool:
        """Whether the line is a delimiter."""
        fence = fence_of(body)
        if fence is None:
            return False
        _, marker, run, info = fence
        if self.open is None:
            self.open = (marker, run)
            return True
        if info == "" and self.open[0] == marker and self.open[1] <= run:
            self.open = None
            return True
        return False


def inline_links(body: str) -> list[tuple[str, str, int, int]]:
    """(text, url, start, end) of inline links: balanced brackets, then a url without white space up to the first parenthesis."""
    out, at = [], 0
    while True:
        start = body.find("[", at)
        if start < 0:
            return out
        at = start + 1
        depth, j = 1, start + 1
        while j < len(body):
            depth += (body[j] == "[") - (body[j] == "]")
            if depth == 0:
                break
            j += 1
        if depth or body[j + 1 : j + 2] != "(":
            continue
        end = body.find(")", j + 2)
        url = body[j + 2 : end]
        if end < 0 or not url or url[0] == "<" or any(c in " \t\n\r" for c in url):
            continue
        out.append((body[start + 1 : j], url, start, end + 1))
        at = end + 1


def _escaped_find(s: str, at: int, close: str, nest: str = "", bad: str = "") -> int:
    """The first place of close that no backslash escapes; nest deepens, bad fails. -1 if there is none."""
    depth = 1
    while at < len(s):
        c = s[at]
        if c == "\\":
            at += 2
            continue
        if c == close:
            depth -= 1
            if not depth or not nest:
                return at
        elif nest and c == nest:
            depth += 1
        elif c in bad and bad:
            return -1
        at += 1
    return -1


def _destination(s: str) -> int:
    """Length of the link destination at the start; -1 if there is none."""
    if s[:1] == "<":
        end = _escaped_find(s, 1, ">", bad="<")
        return end + 1 if end >= 0 else -1
    depth = i = 0
    plain = not any(c in s for c in "()\\")
    while i < len(s):
        c = s[i]
        if c in " \t":
            return i if i else -1
        if c < " " or c == "\x7f":
            return -1
        if not plain:
            if c == "\\" and s[i + 1 : i + 2] in ("(", ")"):
                i += 2
                continue
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return -1
            if c == ")" and depth == 0 and s[i + 1 : i + 2] in ("", " ", "\t"):
                return i + 1
        i += 1
    return i if i and depth == 0 else -1


def definition_label(body: str) -> str | None:
    """The label of a line that is a whole link reference definition."""
    s = body.lstrip(SPACE)
    if not s.startswith("["):
        return None
    close = _escaped_find(s, 1, "]", bad="[")
    if close < 0 or s[close + 1 : close + 2] != ":":
        return None
    label = s[1:close]
    if not label.strip(" \t"):
        return None
    rest = s[close + 2 :].lstrip(SPACE)
    n = _destination(rest)
    if n < 0:
        return None
    after = rest[n:]
    tail = after.lstrip(SPACE)
    if after and len(tail) == len(after):
        return None
    if not tail:
        return label
    if tail[0] not in "\"'(":
        return None
    end = _escaped_find(tail, 1, ")", nest="(") if tail[0] == "(" else _escaped_find(tail, 1, tail[0])
    return label if end >= 0 and not tail[end + 1 :].strip(SPACE) else None


def _blank_needed(last: str, prefix: str) -> bool:
    """Whether definitions after this line need a blank one first."""
    body = (last[len(prefix) :] if last.startswith(prefix) else last).lstrip(SPACE)
    return bool(body) and definition_label(body) is None


def _definitions(last: str, prefix: str, pairs: list[tuple[str, str]], ending: str) -> str:
    content, end = terminated(last)
    head = "" if end else ending
    if _blank_needed(content, prefix):
        head += prefix.removesuffix(" ") + ending
    return head + "".join(f"{prefix}[{t}]: {u}{ending}" for t, u in pairs)


def fix_links(text: str, least: int = 1) -> tuple[str, list[tuple[str, str]]]:
    """(text with links that occur `least` times or more hoisted to definitions, their (text, url) pairs)."""
    if "[" not in text:
        return text, []
    fence, rust = OneFence(), False
    lines = []  # (prefix, body, end, whether links count)
    counts: dict[tuple[str, str], int] = {}
    defined: set[str] = set()
    for segment in segments(text):
        content, end = terminated(segment)
        prefix, body = doc_split(content)
        delimiter = fence.step(body)
        outside = not delimiter and fence.open is None
        rust = rust or (prefix != "" and (delimiter or fence.open is None))
        if outside and "[" in body:
            label = definition_label(body)
            if label is not None:
                defined.add(label)
            for t, u, _, _ in inline_links(body):
                counts[t, u] = counts.get((t, u), 0) + 1
        lines.append((prefix, body, end, outside))
    hoist: dict[tuple[str, str], None] = {}
    for (t, u), n in counts.items():
        if n >= max(least, 1) and t not in defined:
            defined.add(t)
            hoist[t, u] = None
    if not hoist:
        return text, []
    ending = line_ending(text)
    out: list[str] = []
    used: dict[tuple[str, str], None] = {}
    block: dict[tuple[str, str], None] = {}

    def rewrite(body: str) -> str:
        done, at = [], 0
        for t, u, a, b in inline_links(body):
            if (t, u) in hoist:
                done += [body[at:a], f"[{t}]"]
                at = b
                used[t, u] = block[t, u] = None
        return "".join([*done, body[at:]])

    previous = ""
    for prefix, body, end, outside in lines:
        if rust and prefix != previous:
            if block:
                out.append(_definitions(out[-1], previous, list(block), ending))
                block.clear()
            previous = prefix
        fits = outside and "[" in body and (prefix != "" or not rust)
        out.append(prefix + (rewrite(body) if fits else body) + end)
    if rust:
        if block:
            out.append(_definitions(out[-1], previous, list(block), ending))
        pairs = list(used)
    else:
        out.append(_definitions(out[-1], "", list(hoist), ending))
        pairs = list(hoist)
    return ("".join(out), pairs) if pairs else (text, [])
