"""Suffix automata of token sequences, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the sequences that were added; no substring spans two of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, arcs: dict, link: int) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for the strings that p reaches by c; q keeps the longer ones."""
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, dict(nxt[q]), link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, tokens: Iterable) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in tokens:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            own = self._state(length[last] + 1, {}, 0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = own
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[own] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = own

    def statistics(self, tokens: Sequence) -> list[int]:
        """For each place, the length of the longest added substring that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        out = []
        for c in tokens:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nxt[state].get(c)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out
