"""Matching blocks of two texts, each found in a time that grows with their lengths alone.

The longest common block of two texts, then that of what is left of it on
either side, and so on. A block is found by a suffix automaton of the shorter
text, which the longer one is read through: one pass over either. Of several
longest blocks the first in a counts, and of its places in b the first.
"""

from __future__ import annotations

#: Below so many pairs of characters a table of runs is faster than an automaton.
SMALL = 1024


class SuffixAutomaton:
    """All blocks of a text: a state for each set of places where blocks end, and where that is first."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(text):
            last = self._add(last, i, c)

    def _state(self, length: int, first: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _add(self, last: int, i: int, c: str) -> int:
        following, link = self.next, self.link
        new, p = self._state(i + 1, i, 0, {}), last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if self.length[q] == self.length[p] + 1:
                link[new] = q
            else:  # the blocks that end in more places get a state of their own
                own = self._state(self.length[p] + 1, self.first[q], link[q], following[q].copy())
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = own
                    p = link[p]
                link[q] = link[new] = own
        return new

    def ends(self, text: str):
        """For each character of another text: (length of the longest block that ends there and is in this one, where it first ends here)."""
        following, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for c in text:
            while state and c not in following[state]:
                state = link[state]
                size = length[state]
            if c in following[state]:
                state = following[state][c]
                size += 1
            yield size, first[state]


def _longest_small(a: str, b: str) -> tuple[int, int, int]:
    best, runs = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        runs = [0, *[runs[j] + 1 if x == y else 0 for j, y in enumerate(b)]]
        size = max(runs)
        if size > best[0]:
            best = (size, i + 1 - size, runs.index(size) - size)
    return best


def longest_block(a: str, b: str) -> tuple[int, int, int]:
    """(size, place in a, place in b) of the longest common block: the first in a, and there the first in b."""
    if len(a) * len(b) <= SMALL:
        return _longest_small(a, b)
    best = (0, 0, 0)
    if len(b) <= len(a):
        for i, (size, j) in enumerate(SuffixAutomaton(b).ends(a)):
            if size > best[0]:
                best = (size, i + 1 - size, j + 1 - size)
    else:
        for j, (size, i) in enumerate(SuffixAutomaton(a).ends(b)):
            if size > best[0] or size and size == best[0] and i + 1 - size < best[1]:
                best = (size, i + 1 - size, j + 1 - size)
    return best


def matching_characters(a: str, b: str) -> int:
    """Characters in the longest common block and, again and again, in those of what is left before and after it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        if head == a1 - a0 or head == b1 - b0:  # one is the beginning of the other: it is the longest block
            total += head
            continue
        size, i, j = longest_block(a[a0:a1], b[b0:b1])
        if size:
            total += size
            todo += [(a0, a0 + i, b0, b0 + j), (a0 + i + size, a1, b0 + j + size, b1)]
    return total
