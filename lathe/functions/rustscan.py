"""A scanner of Rust source: items, references, module declarations, re-exports, visibilities.

It reads tokens and brackets, not expressions: enough for what the operators ask of valid
source. Offsets are in characters. Unbalanced brackets close at the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: White space, then a token.
TOKEN = re.compile(
    r"""\s*+(?:(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>(?:br|cr|r)(?P<h>\#*)")|(?P<str>[bc]?"(?:[^"\\]|\\.)*(?:"|\Z))"""
    r"""|(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x[0-9a-fA-F]{2}|.))')|(?P<life>'[^\W\d]\w*)|(?P<id>(?:r\#)?[^\W\d]\w*)|(?P<num>\d[\w]*(?:\.\d[\w]*)?)|(?P<punct>::|->|=>|.))""",
    re.S | re.X,
)
#: By group: its name, and the kind of its tokens if they end where the group does.
GROUP = [None, *sorted(TOKEN.groupindex, key=TOKEN.groupindex.get)]
PLAIN = [{"id": "id", "punct": "punct", "life": "life", "str": "lit", "char": "lit", "num": "lit"}.get(g) for g in GROUP]
COMMENT_EDGE = re.compile(r"/\*|\*/")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
PRIMITIVES = set("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
NAMED = {"fn", "struct", "enum", "union", "type", "const", "static", "mod", "trait"}
ELIGIBLE = NAMED | {"extern"}
STACKED = {"fn", "struct", "enum", "union", "type", "const", "static", "trait", "macro"}


@dataclass(slots=True)
class Token:
    kind: str  # id, life, lit, punct, doc (outer), note (any other comment)
    text: str
    start: int
    end: int
    match: int = -1  # index of the partner of a bracket


@dataclass(slots=True)
class Item:
    kind: str
    start: int
    end: int
    attached: int
    first: int  # tokens of the body, from the visibility on
    last: int
    name: str | None = None
    impl_target: str | None = None
    is_test_module: bool = False
    is_inline: bool = False
    is_trait_impl: bool = False
    vis: int | None = 2
    vis_span: tuple[int, int] | None = None
    docs: list[str] = field(default_factory=list)
    returns_result: bool = False
    params: list[str] = field(default_factory=list)
    is_test_fn: bool = False
    path_attr: str | None = None
    body: tuple[int, int] | None = None  # tokens inside the braces


def tokens_of(text: str) -> list[Token]:
    out, at, n = [], 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = (text.find("\n") + 1) or n
    stack: list[int] = []
    unmatched: list[int] = []
    match, add = TOKEN.match, out.append
    while m := match(text, at):
        g = m.lastindex
        at, end = m.span(g)
        kind = PLAIN[g]
        if kind:
            word = m[g]
            add(t := Token(kind, word, at, end))
            if kind == "punct":
                if word in OPEN:
                    stack.append(len(out) - 1)
                elif word in CLOSE:
                    while stack:
                        j = stack.pop()
                        if OPEN[out[j].text] == word:
                            out[j].match, t.match = len(out) - 1, j
                            break
                        unmatched.append(j)
        elif GROUP[g] == "block":
            depth, i = 1, end
            while depth:
                e = COMMENT_EDGE.search(text, i)
                if not e:
                    i = n
                    break
                depth += 1 if e.group() == "/*" else -1
                i = e.end()
            end = i
            body = text[at:end]
            outer = body.startswith("/**") and not body.startswith("/***") and body != "/**/"
            add(Token("doc" if outer else "note", body, at, end))
        elif GROUP[g] == "line":
            body = m[g]
            outer = body.startswith("///") and not body.startswith("////")
            add(Token("doc" if outer else "note", body, at, end))
        else:  # a raw literal
            at, end = m.span("raw")
            close = text.find('"' + m.group("h"), end)
            end = close + 1 + len(m.group("h")) if close >= 0 else n
            add(Token("lit", text[at:end], at, end))
        at = end
    for j in (*stack, *unmatched):
        out[j].match = len(out)
    return out


class Scan:
    """All that the operators take from one file."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens_of(text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.top = self.items_in(0, len(self.tokens))
        self._spans()

    # items

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def _skip(self, i: int) -> int:
        """The next token after a token or a whole bracket."""
        t = self.tokens[i]
        return t.match + 1 if t.kind == "punct" and t.text in OPEN else i + 1

    def _code(self, i: int, stop: int) -> int:
        while i < stop and self.tokens[i].kind in ("note", "doc"):
            i += 1
        return i

    def _is(self, i: int, stop: int, *texts: str) -> bool:
        return i < stop and self.tokens[i].kind in ("id", "punct") and self.tokens[i].text in texts

    def items_in(self, i: int, stop: int) -> list[Item]:
        out: list[Item] = []
        pending: list[tuple[int, int]] = []  # token spans of outer docs and attributes
        while i < stop:
            t = self.tokens[i]
            if t.kind == "doc":
                pending.append((i, i + 1))
                i += 1
            elif t.kind == "note" or t.text == ";":
                i += 1
            elif t.text == "#" and self._is(i + 1, stop, "["):
                j = self._skip(i + 1)
                pending.append((i, j))
                i = j
            elif t.text == "#" and self._is(i + 1, stop, "!") and self._is(i + 2, stop, "["):
                i = self._skip(i + 2)
            else:
                item, j = self._item(i, stop)
                if item is not None:
                    self._attach(item, pending)
                    out.append(item)
                    pending = []
                i = max(j, i + 1)
        return out

    def _attach(self, item: Item, pending: list[tuple[int, int]]) -> None:
        tk = self.tokens
        if pending:
            item.attached = tk[pending[0][0]].start
        for a, b in pending:
            t = tk[a]
            if t.kind == "doc":
                body = t.text[3:-2] if t.text.startswith("/*") else t.text[3:]
                item.docs.append(body.rstrip("\r\n"))
                continue
            inner = [x for x in tk[a + 2 : b - 1] if x.kind not in ("note", "doc")]
            path = []
            for k, x in enumerate(inner):
                if x.kind == "id" and (k == 0 or inner[k - 1].text == "::"):
                    path.append(x.text)
                elif x.text != "::":
                    break
            rest = inner[2 * len(path) - 1 :] if path else []
            if not path:
                continue
            value = rest[1].text if len(rest) > 1 and rest[0].text == "=" and rest[1].kind == "lit" else None
            content = self._string(value)
            if path == ["doc"] and content:
                item.docs.append(content)
            if path == ["path"] and content is not None and item.path_attr is None:
                item.path_attr = content
            if item.kind == "fn" and path[-1] == "test":
                item.is_test_fn = True
            if item.kind == "mod" and path[0] == "cfg" and [x.text for x in rest] == ["(", "test", ")"]:
                item.is_test_module = True

    @staticmethod
    def _string(literal: str | None) -> str | None:
        if literal is None:
            return None
        m = re.match(r'[bc]?r(#*)"(.*)"\1\Z', literal, re.S)
        if m:
            return m.group(2)
        m = re.match(r'[bc]?"([^\\"]*)', literal)
        return m.group(1) if m and m.group(1) else None

    def _angles(self, i: int, stop: int) -> int:
        """The token after a balanced <...> that starts here."""
        depth = 0
        while i < stop:
            t = self.tokens[i].text if self.tokens[i].kind == "punct" else ""
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            i = self._skip(i)
        return stop

    def _until(self, i: int, stop: int, ends: str) -> int:
        """The first of these marks outside brackets; a brace is one even if it opens."""
        while i < stop:
            t = self.tokens[i]
            if t.kind == "punct" and t.text in ends:
                return i
            i = self._skip(i)
        return stop

    def _item(self, first: int, stop: int) -> tuple[Item | None, int]:
        tk = self.tokens
        i, vis, span = first, 2, None
        if self._is(i, stop, "pub"):
            j = i + 1
            vis, span = 0, (tk[i].start, tk[i].end)
            if self._is(j, stop, "(") and j + 1 < stop and tk[j + 1].text in ("crate", "super", "self", "in"):
                vis, end = 1, tk[j].match
                span = (tk[i].start, tk[min(end, len(tk) - 1)].end)
                j = self._skip(j)
            i = j
        elif self._is(i, stop, "crate") and i + 1 < stop and tk[i + 1].kind == "id":
            vis, span, i = 1, (tk[i].start, tk[i].end), i + 1
        i = self._code(i, stop)
        head = i
        # modifiers
        while i < stop and tk[i].kind == "id" and tk[i].text in ("async", "unsafe", "default", "const", "extern", "safe"):
            nxt = self._code(i + 1, stop)
            if tk[i].text == "const" and not self._is(nxt, stop, "fn", "unsafe", "async", "extern"):
                break
            if tk[i].text == "extern":
                if nxt < stop and tk[nxt].kind == "lit":
                    nxt = self._code(nxt + 1, stop)
                if not self._is(nxt, stop, "fn"):
                    break
            if tk[i].text in ("default", "safe") and not (nxt < stop and tk[nxt].kind == "id"):
                break
            i = nxt
        if i >= stop:
            return None, stop
        word = tk[i].text if tk[i].kind == "id" else ""
        nxt = self._code(i + 1, stop)
        name = tk[nxt].text if nxt < stop and tk[nxt].kind == "id" else None
        make = lambda kind, last, **more: (Item(kind, 0, tk[min(last, len(tk)) - 1].end, tk[first].start, first, last, vis=vis, vis_span=span, **more), last)

        def braced(at: int) -> tuple[int, tuple[int, int] | None]:
            end = self._until(at, stop, ";{")
            if end < stop and tk[end].text == "{":
                return self._skip(end), (end + 1, min(tk[end].match, stop))
            return min(end + 1, stop), None

        if word == "fn" and name:
            last, body = braced(nxt + 1)
            if body is None:
                return None, last
            return make("fn", last, name=name, body=body, **self._signature(nxt + 1, body[0] - 1))
        if word in ("struct", "enum", "trait") and name or word == "union" and name and name not in KEYWORDS:
            last, body = braced(nxt + 1)
            return make(word, last, name=name, body=body)
        if word == "mod" and name:
            last, body = braced(nxt + 1)
            return make("mod", last, name=name, body=body, is_inline=body is not None)
        if word == "impl":
            last, body = braced(i + 1)
            vis, span = None, span
            return make("impl", last, body=body, **self._impl(i + 1, (body[0] - 1) if body else last))
        if word in ("use", "const", "static", "type"):
            end = self._until(i + 1, stop, ";")
            if word == "static" and name == "mut":
                nxt = self._code(nxt + 1, stop)
                name = tk[nxt].text if nxt < stop else None
            return make(word, min(end + 1, stop), name=None if word == "use" else name)
        if word == "extern":
            if self._is(nxt, stop, "crate"):
                end = self._until(nxt, stop, ";")
                crate = tk[nxt + 1].text if nxt + 1 < stop else None
                item, last = make("extern", min(end + 1, stop), name=crate)
                return item, last
            at = self._until(i + 1, stop, "{;")
            if at < stop and tk[at].text == "{":
                vis = None
                return make("other", self._skip(at))
            return None, at + 1
        if word == "macro_rules" and self._is(nxt, stop, "!"):
            at = self._code(nxt + 1, stop)
            group = self._until(at, stop, "({[")
            last = self._skip(group) if group < stop else stop
            if group < stop and tk[group].text != "{" and self._is(last, stop, ";"):
                last += 1
            vis = None
            return make("macro", last, name=tk[at].text if at < stop and tk[at].kind == "id" else None, body=(group + 1, min(last, stop)))
        if tk[head].kind == "id" or tk[head].text == "::":
            j, seg = head, None
            while j < stop and (tk[j].kind == "id" or tk[j].text == "::"):
                seg = tk[j].text if tk[j].kind == "id" else seg
                j += 1
            if self._is(j, stop, "!"):
                j = self._code(j + 1, stop)
                if j < stop and tk[j].kind == "punct" and tk[j].text in OPEN:
                    last = self._skip(j)
                    if self._is(last, stop, ";"):
                        last += 1
                    vis = None
                    return make("macro-invocation", last, name=seg)
        return None, self._skip(first)

    def _signature(self, i: int, stop: int) -> dict:
        tk = self.tokens
        i = self._code(i, stop)
        if self._is(i, stop, "<"):
            i = self._angles(i, stop)
        params: list[str] = []
        if self._is(i, stop, "("):
            end = min(tk[i].match, stop)
            for own in self._split(i + 1, end):
                at = 0
                while at < len(own) and own[at].text == "#":
                    at += 2
                head = [t.text for t in own[at:]]
                if head[:1] == ["mut"]:
                    head = head[1:]
                if len(head) > 1 and head[1] == ":" and re.match(r"(r#)?[^\W\d]\w*\Z", head[0]) and head[0] not in KEYWORDS and head[0] != "_":
                    params.append(head[0])
            i = end + 1
        i = self._code(i, stop)
        result = False
        if self._is(i, stop, "->"):
            j, words = i + 1, []
            while j < stop and not self._is(j, stop, "where"):
                words.append(j)
                j = self._skip(j) if tk[j].text != "<" else self._angles(j, stop)
            kinds = [tk[k] for k in words if tk[k].kind not in ("note", "doc")]
            shape = "".join("i" if t.kind == "id" and t.text not in KEYWORDS - {"crate", "self", "super"} else t.text if t.text in ("::", "<") else "?" for t in kinds)
            if re.match(r"(::)?i((::)?<)?(::i((::)?<)?)*\Z", shape):
                result = [t.text for t in kinds if t.kind == "id"][-1] == "Result"
        return {"params": params, "returns_result": result}

    def _split(self, i: int, stop: int) -> list[list[Token]]:
        """Tokens between commas outside brackets and angles; brackets and comments are left out but for their opening."""
        out, own, depth = [], [], 0
        while i < stop:
            t = self.tokens[i]
            if t.kind == "punct" and t.text == "<":
                depth += 1
            elif t.kind == "punct" and t.text == ">":
                depth -= 1
            if t.kind == "punct" and t.text == "," and depth <= 0:
                out.append(own)
                own = []
            elif t.kind not in ("note", "doc"):
                own.append(t)
            i = self._skip(i)
        return [*out, own] if own else out

    def _impl(self, i: int, stop: int) -> dict:
        tk = self.tokens
        i = self._code(i, stop)
        if self._is(i, stop, "<"):
            i = self._angles(i, stop)
        parts: list[list[Token]] = [[]]
        depth = 0
        while i < stop and not (self._is(i, stop, "where") and depth == 0):
            t = tk[i]
            depth += (t.text == "<") - (t.text == ">") if t.kind == "punct" else 0
            if t.kind == "id" and t.text == "for" and depth == 0 and not self._is(i + 1, stop, "<"):
                parts.append([])
            elif t.kind not in ("note", "doc"):
                parts[-1].append(t)
            i = self._skip(i)
        own = parts[-1]
        head = own[0].text if own and own[0].kind == "id" else None
        if head in KEYWORDS or head in PRIMITIVES:
            head = None
        return {"impl_target": head, "is_trait_impl": len(parts) > 1}

    def _spans(self) -> None:
        before = None
        for item in self.top:
            item.start = item.attached if before is None else before
            k = bisect_right(self.starts, item.end)
            item.end = before = self.starts[k] if k < len(self.starts) else len(self.text)

    @property
    def preamble_end(self) -> int:
        return self.top[0].start if self.top else 0

    @property
    def trailer_start(self) -> int:
        return self.top[-1].end if self.top else len(self.text)

    # references

    def edges(self) -> list[tuple[int, int]]:
        """(from, to) item numbers: uses of a top-level name inside a named item; a local macro's edges are reversed."""
        index: dict[str, int] = {}
        for k, item in enumerate(self.top):
            if item.name is not None and item.kind != "extern":
                index.setdefault(item.name, k)
        macros = {item.name for item in self.top if item.kind == "macro" and item.name}
        out: list[tuple[int, int]] = []
        for item in self.top:
            self._refs(item, index, macros, None, out)
        return out

    def _refs(self, item: Item, index: dict, macros: set, owner: int | None, out: list) -> None:
        tk = self.tokens
        if item.kind in STACKED and item.name in index:
            owner = index[item.name]
        if item.kind == "macro":
            for k in range(item.body[0], min(item.body[1], len(tk))):
                t = tk[k]
                # $name is a metavariable, and what follows its colon a fragment kind
                if t.kind == "id" and tk[k - 1].text != "$" and not (tk[k - 1].text == ":" and tk[k - 3].text == "$"):
                    self._ref(t.text, False, index, macros, owner, out)
            return
        if item.kind in ("impl", "mod") and item.body is None:
            return
        lo, hi = item.first, min(item.last, len(tk))
        if item.vis_span:
            while lo < hi and tk[lo].start < item.vis_span[1]:
                lo += 1
        if item.kind == "macro-invocation":
            names = [t.text for t in tk[lo:hi] if t.kind == "id"]
            if names:
                self._ref(names[0], True, index, macros, owner, out)
            return
        inner: dict[int, Item] = {}
        if item.body and item.kind in ("fn", "impl", "mod", "trait"):
            for nested in self._nested(item.body[0], min(item.body[1], hi)):
                inner[nested.first] = nested
        i, variants = lo, item.kind == "enum"
        while i < hi:
            if i in inner:
                self._refs(inner[i], index, macros, owner, out)
                i = max(inner[i].last, i + 1)
                continue
            t = tk[i]
            if t.kind != "id" or t.text in KEYWORDS:
                i += 1
                continue
            j = self._code(i + 1, hi)
            nxt = tk[j].text if j < hi else ""
            back = i - 1
            while back >= lo and tk[back].kind in ("note", "doc"):
                back -= 1
            last = tk[back].text if back >= lo else ""
            if nxt == "!" and j + 1 < hi and tk[j + 1].text in OPEN and last != "::":
                self._ref(t.text, True, index, macros, owner, out)
                i = self._skip(j + 1)
                continue
            skip = (
                last == "::" and back > lo and (tk[back - 1].kind == "id" or tk[back - 1].text == ">")
                or last == "." and not (back > lo and tk[back - 1].text == "." and tk[back - 1].end == tk[back].start)
                or nxt == ":" and last != "<"
                or t.text in PRIMITIVES
                or last in ("fn", "struct", "enum", "union", "type", "const", "static", "mod", "trait") and t.text == item.name
                or last == "static" or last == "as" and item.kind == "use"
                or variants and item.body and i >= item.body[0] and self._variant(i, item)
                or (last == "for" or last == "mut" and back > lo and tk[back - 1].text == "for") and nxt == "in"
                or (last == "let" and self._statement(back, lo) or last == "mut" and back > lo and tk[back - 1].text == "let" and self._statement(back - 1, lo)) and nxt in (":", "=", ";", "else")
            )
            if not skip:
                # a path that goes through a macro call is recorded by its first segment
                k = j
                while k < hi and tk[k].text == "::" and k + 1 < hi and tk[k + 1].kind == "id":
                    k += 2
                call = k > j and k < hi and tk[k].text == "!" and k + 1 < hi and tk[k + 1].text in OPEN
                self._ref(t.text, call, index, macros, owner, out)
                if call:
                    i = self._skip(k + 1)
                    continue
            i += 1

    def _nested(self, i: int, stop: int) -> list[Item]:
        """Items that start anywhere inside a body."""
        out, tk = [], self.tokens
        while i < stop:
            t = tk[i]
            if t.kind == "id" and t.text in ("fn", "struct", "enum", "union", "trait", "const", "static", "type", "pub", "unsafe", "async", "extern", "impl", "mod", "macro_rules") and (i == 0 or tk[i - 1].text not in (".", "::", "'", ":", "->", "<", "(", ",", "&", "=", "dyn")):
                item, last = self._item(i, stop)
                if item is not None and item.kind in STACKED | {"impl", "mod"} and item.last <= stop:
                    out.append(item)
                    i = max(last, i + 1)
                    continue
            i += 1
        return out

    def _statement(self, let: int, lo: int) -> bool:
        return not (let > lo and self.tokens[let - 1].text in ("if", "while", "&"))

    def _variant(self, i: int, item: Item) -> bool:
        back = i - 1
        while back >= item.body[0] and (self.tokens[back].kind in ("note", "doc") or self.tokens[back].text == "]"):
            back = self.tokens[back].match - 2 if self.tokens[back].text == "]" else back - 1
        inside = back >= item.body[0] and self.tokens[back].text == ","
        depth = 0
        for t in self.tokens[item.body[0] : i]:
            depth += (t.text in OPEN) - (t.text in CLOSE) if t.kind == "punct" else 0
        return depth == 0 and (back < item.body[0] or inside)

    @staticmethod
    def _ref(name: str, call: bool, index: dict, macros: set, owner: int | None, out: list) -> None:
        to = index.get(name)
        if owner is None or to is None or to == owner:
            return
        out.append((to, owner) if call and name in macros else (owner, to))

    # visibility

    def reexports(self) -> set[str]:
        """Names that bare `pub use` declarations hand on, at any depth of modules; * for a glob."""
        out: set[str] = set()

        def visit(items: list[Item]) -> None:
            for item in items:
                if item.kind == "use" and item.vis == 0:
                    lo = next(k for k in range(item.first, item.last) if self.tokens[k].text == "use") + 1
                    self._use(lo, item.last - 1, out)
                elif item.kind == "mod" and item.body:
                    visit(self.items_in(*item.body))

        visit(self.top)
        return out

    def _use(self, lo: int, hi: int, out: set[str]) -> None:
        tk = [k for k in range(lo, hi) if self.tokens[k].kind not in ("note", "doc")]
        names, k = [], 0
        while k < len(tk):
            t = self.tokens[tk[k]]
            if t.text == "{":
                end = min(t.match, hi)
                at = part = tk[k] + 1
                while part <= end:
                    stop = self._until(part, end, ",")
                    own = [self.tokens[x] for x in range(at, stop) if self.tokens[x].kind not in ("note", "doc")]
                    if [x.text for x in own] == ["self"]:
                        if names:
                            out.add(names[-1])
                    elif own:
                        self._use(at, stop, out)
                    at = part = stop + 1
                return
            if t.text == "*":
                out.add("*")
                return
            if t.text == "as":
                alias = self.tokens[tk[k + 1]].text if k + 1 < len(tk) else "_"
                if alias != "_":
                    out.add(alias)
                return
            if t.kind == "id":
                names.append(t.text)
            k += 1
        if names and names[-1] not in ("self", "crate", "super"):
            out.add(names[-1])

    def modules(self) -> list[tuple[str, str | None, str | None]]:
        """(name, path attribute, restricted visibility) of each top-level `mod name;`, in order."""
        return [(i.name, i.path_attr, self.text[slice(*i.vis_span)] if i.vis == 1 else None) for i in self.top if i.kind == "mod" and not i.is_inline]

    def narrowable(self) -> list[tuple[int, int, str, str | None]]:
        """(start, end, name, innermost restricted visibility of its inline modules) of each bare `pub` of a named item."""
        out: list[tuple[int, int, str, str | None]] = []

        def visit(items: list[Item], floor: str | None) -> None:
            for item in items:
                if item.kind in ELIGIBLE and item.name and item.vis == 0:
                    out.append((*item.vis_span, item.name, floor))
                if item.kind == "mod" and item.body:
                    inner = self.text[slice(*item.vis_span)] if item.vis == 1 else floor
                    visit(self.items_in(*item.body), inner)

        visit(self.top, None)
        return out

    def rows(self) -> list[dict]:
        out = []
        for k, i in enumerate(self.top):
            out.append(
                {
                    "idx": k, "start": i.start, "end": i.end, "start_line": self.line_of(i.attached), "kind": i.kind, "name": None if i.kind in ("extern", "use", "impl") else i.name,
                    "impl_target": i.impl_target, "is_test_module": i.is_test_module, "is_inline": i.is_inline, "is_trait_impl": i.is_trait_impl, "vis": i.vis,
                    "doc_comments": i.docs, "returns_result": i.returns_result, "params": i.params, "is_test_fn": i.is_test_fn,
                }
            )
        return out


def narrow(text: str, scan: Scan, floor: str | None, blocked: set[str]) -> str:
    """The text with each bare `pub` under a floor narrowed to it, but for re-exported names."""
    if "*" in blocked:
        return text
    for start, end, name, inner in sorted(scan.narrowable(), reverse=True):
        want = inner or floor
        if want is not None and name not in blocked:
            text = text[:start] + want + text[end:]
    return text
