"""A generalised suffix automaton over words given as integers."""

from __future__ import annotations

from collections.abc import Sequence


class Suffixes:
    """All stretches of the sequences added so far; states stand for stretches that end at the same places."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: Sequence[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        step, link, size = self.step, self.link, self.size
        if c in step[last]:
            q = step[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        new = len(size)
        step.append({}), link.append(0), size.append(size[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, size = self.step, self.link, self.size
        twin = len(size)
        step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1)
        while p != -1 and step[p].get(c) == q:
            step[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    def advance(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest known stretch that ends with word c, after (state, length)."""
        while state and c not in self.step[state]:
            state = self.link[state]
            length = self.size[state]
        if c in self.step[state]:
            return self.step[state][c], length + 1
        return 0, 0

    def factors(self, words: Sequence[int]) -> list[tuple[int, int]]:
        """The greedy parse: (start, length) of the longest known stretch from each factor's start; 0 for an unknown word."""
        out, at, n = [], 0, len(words)
        while at < n:
            state, end = 0, at
            while end < n and (to := self.step[state].get(words[end])) is not None:
                state, end = to, end + 1
            out.append((at, end - at))
            at = max(end, at + 1)
        return out

    def long_factors(self, words: Sequence[int], least: int) -> list[tuple[int, int]]:
        """Disjoint spans [start, end) of all known stretches of ``least`` words and more.

        A factor grows greedily; at its boundary, where the next word doesn't go on with it, the longest tail of it that
        does go on elsewhere is where the next one begins, so that no stretch across a boundary is missed.
        """
        spans: list[tuple[int, int]] = []
        state = length = 0
        for end, c in enumerate(words, 1):
            state, length = self.advance(state, length, c)
            if length >= least:
                if spans and spans[-1][1] >= end - length:
                    spans[-1] = (min(spans[-1][0], end - length), end)
                else:
                    spans.append((end - length, end))
        return spans
