"""Suffix array of an integer sequence by grouping suffixes by their Lyndon prefixes, and its common prefixes.

Linear grouping construction (two phases, no recursion, no renaming):

1.  Suffixes start in groups by first symbol.  Groups are taken from the highest to the lowest.  For each suffix of the
    group its previous-smaller pointer goes to the nearest earlier suffix in a lower group.  Suffixes pointed to extend
    their common prefix by the group's; each group they are in splits, those pointed to more often going higher.
    What remains are groups of suffixes with the same longest Lyndon prefix, in lexicographic order.
2.  Read the suffix array from its smallest entry.  Whenever suffix s is read, s - 1 and, along previous-smaller
    pointers, every suffix whose Lyndon prefix ends at s takes the next free place of its group.

Groups are linked lists in the order of the text.  As the pointers of a group's suffixes do not fall along the text, the
suffixes that leave a group come in that order too, so no group is ever sorted; a walk along pointers passes each suffix
once, as the next walk jumps over it.  Only the different numbers of pointers, of which m pointers have fewer than
sqrt(2 m), are sorted.  So both phases take linear time.
"""

from __future__ import annotations

import numpy as np


class Groups:
    """Suffixes in ordered groups; a group is named by its first place in the order and lists its members along the text."""

    def __init__(self, text: list[int]):
        n = len(text)
        self.name = [0] * n  # of a suffix's group
        self.size = [0] * n
        self.head = [-1] * n
        self.ending = [0] * n  # the group whose last place this is
        self.after, self.before = [-1] * n, [-1] * n
        by_symbol: list[list[int]] = [[] for _ in range(max(text, default=-1) + 1)]
        for s, x in enumerate(text):
            by_symbol[x].append(s)
        place = 0
        for members in by_symbol:
            if members:
                self.gather(place, members)
                place += len(members)

    def gather(self, name: int, members: list[int]) -> None:
        """Make ``members``, in the order of the text, the group of this name."""
        last = -1
        for s in members:
            self.name[s] = name
            self.before[s] = last
            if last >= 0:
                self.after[last] = s
            last = s
        self.after[last] = -1
        self.head[name], self.size[name] = members[0], len(members)
        self.ending[name + len(members) - 1] = name

    def members(self, name: int) -> list[int]:
        out, s = [], self.head[name]
        while s >= 0:
            out.append(s)
            s = self.after[s]
        return out

    def raise_(self, leaving: list[int]) -> None:
        """Move suffixes, in the order of the text, to new groups right above those they are in."""
        moved: dict[int, list[int]] = {}
        for s in leaving:
            g = self.name[s]
            a, b = self.before[s], self.after[s]
            if a >= 0:
                self.after[a] = b
            else:
                self.head[g] = b
            if b >= 0:
                self.before[b] = a
            moved.setdefault(g, []).append(s)
        for g, members in moved.items():
            stay = self.size[g] - len(members)
            self.size[g] = stay
            if stay:
                self.ending[g + stay - 1] = g
            self.gather(g + stay, members)


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (symbols from 0) in order; a suffix that is a prefix of another comes first."""
    n = len(text)
    groups = Groups(text)
    name = groups.name
    smaller = [-1] * n  # previous-smaller pointers
    end = n
    while end:
        low = groups.ending[end - 1]
        counts: dict[int, int] = {}
        for s in groups.members(low):
            p = s - 1
            while p >= 0 and name[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        layers: dict[int, list[int]] = {}
        for p, c in counts.items():
            layers.setdefault(c, []).append(p)
        for c in sorted(layers, reverse=True):
            groups.raise_(layers[c])
        end = low
    out, done = [-1] * n, [False] * n
    free = list(range(n))  # next free place of a group

    def place(p: int) -> None:
        while p >= 0 and not done[p]:
            g = name[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = smaller[p]

    place(n - 1)
    for i in range(n):
        place(out[i] - 1)
    return out


def common_prefixes(text: list[int], order: list[int], stop: int) -> np.ndarray:
    """For each place of the suffix array the symbols that its suffix shares with the one before, up to the first ``stop``."""
    n = len(text)
    rank = [0] * n
    for k, s in enumerate(order):
        rank[s] = k
    out = np.zeros(n, dtype=np.int64)
    h = 0
    for s in range(n):
        k = rank[s]
        if not k:
            h = 0
            continue
        t = order[k - 1]
        while s + h < n and t + h < n and text[s + h] == text[t + h] != stop:
            h += 1
        out[k] = h
        if h:
            h -= 1
    return out


class RangeMinimum:
    """Minima of any range of an array: a table of the minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima over [first, last], none empty."""
        out = np.zeros(len(first), dtype=self.table[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k, row in enumerate(self.table):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
        return out
