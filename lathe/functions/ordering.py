"""The order of one file's items: phases, waves of dependencies, impls after the rest of the types."""

from __future__ import annotations

SPACING = {"use": 0, "mod": 1, "const": 2, "static": 2, "extern": 2}


def waves(names: list[str], edges: list[tuple[int, int]], alphabetical: bool = True) -> list[int]:
    """main first; then wave after wave of nodes without predecessors, each by name; nodes of cycles last. Work grows with nodes and edges."""
    if len(names) < 2:
        return list(range(len(names)))
    need = [0] * len(names)
    out_of: list[list[int]] = [[] for _ in names]
    for a, b in edges:
        out_of[a].append(b)
        need[b] += 1
    order: list[int] = []
    done = [False] * len(names)

    def take(wave: list[int]) -> list[int]:
        """The nodes that this wave frees."""
        freed = []
        for i in wave:
            done[i] = True
            order.append(i)
            for b in out_of[i]:
                if need[b]:
                    need[b] -= 1
                    if not need[b] and not done[b]:
                        freed.append(b)
        return freed

    key = (lambda i: (names[i].encode(), i)) if alphabetical else (lambda i: i)
    if "main" in names:
        take([names.index("main")])
    free = [i for i in range(len(names)) if not done[i] and not need[i]]
    while free:
        free = take(sorted(free, key=key))
    return order + sorted((i for i in range(len(names)) if not done[i]), key=key)


def phase(item: dict, macros: set[str]) -> int:
    kind = item["kind"]
    if kind == "macro-invocation":
        return 4 if item["name"] in macros and item["name"] else 1
    if kind == "mod":
        return 10 if item["is_test_module"] and item["is_inline"] else 3
    return {"extern": 1, "other": 1, "use": 2, "macro": 4, "const": 5, "static": 5, "struct": 6, "enum": 6, "union": 6, "type": 6, "trait": 7, "impl": 8, "fn": 9}[kind]


def order_items(items: list[dict], edges: list[tuple[int, int]]) -> list[int]:
    """Item numbers in their output order."""
    macros = {i["name"] for i in items if i["kind"] == "macro" and i["name"]}
    by: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        by.setdefault(phase(item, macros), []).append(k)

    def sorted_group(group: list[int]) -> list[int]:
        if len(group) < 2:
            return group
        place = {k: p for p, k in enumerate(group)}
        own = [(place[a], place[b]) for a, b in edges if a in place and b in place]
        return [group[p] for p in waves([items[k]["name"] or "" for k in group], own)]

    out = [*by.get(1, []), *by.get(2, []), *by.get(3, [])]
    calls: dict[str, list[int]] = {}
    for k in by.get(4, []):
        if items[k]["kind"] == "macro-invocation":
            calls.setdefault(items[k]["name"], []).append(k)
    for k in sorted_group([k for k in by.get(4, []) if items[k]["kind"] == "macro"]):
        # of definitions that share a name the first to come takes the calls
        out += [k, *calls.pop(items[k]["name"] or "", [])]
    for p in (5, 6, 7):
        out += sorted_group(by.get(p, []))
    for of_trait in (False, True):
        place: dict[str, int] = {}
        for at, k in enumerate(out):
            if items[k]["name"] is not None:
                place.setdefault(items[k]["name"], at)
        impls = [k for k in by.get(8, []) if items[k]["is_trait_impl"] == of_trait and items[k]["impl_target"] in place]
        out += sorted(impls, key=lambda k: (place[items[k]["impl_target"]], k))
    placed = set(out)
    out += [k for t in (False, True) for k in by.get(8, []) if items[k]["is_trait_impl"] == t and k not in placed]
    for tier in (0, 1, 2):
        out += sorted_group([k for k in by.get(9, []) if items[k]["vis"] == tier])
    return out + by.get(10, [])


def moves(items: list[dict], order: list[int]) -> list[tuple[int, str]]:
    """(item, message) of items that come earlier than they were."""
    out = []
    for to, k in enumerate(order):
        if k <= to:
            continue
        item = items[k]
        who = f"{item['kind']} {item['name']}" if item["name"] is not None else f"{item['kind']} at line {item['start_line']}"
        note = f"rearrange {who} from pos {k + 1} to pos {to + 1}"
        if to + 1 < len(order):
            nxt = items[order[to + 1]]
            note += f" (before {nxt['name'] if nxt['name'] is not None else '%s at line %d' % (nxt['kind'], nxt['start_line'])})"
        out.append((k, note))
    return out


def emit(text: str, items: list[dict], order: list[int], preamble_end: int, trailer_start: int, ending: str, space: str) -> str:
    """The text with items in order; use, mod, and const/static/extern stay close, other items are parted by a blank line."""
    out = [text[:preamble_end]]
    for at, k in enumerate(order):
        out += [text[items[k]["start"] : items[k]["end"]].strip(space), ending]
        if at + 1 < len(order):
            own, nxt = (SPACING.get(items[j]["kind"]) for j in (k, order[at + 1]))
            if own is None or own != nxt:
                out.append(ending)
    return "".join([*out, text[trailer_start:]])
