"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefixes. Groups are taken from the largest down; every member points to the last
earlier suffix in a smaller group, and the suffixes pointed to leave their group for a larger one right above it, those
pointed to more often higher up. Then the order is emitted once, from the smallest suffix on: each emitted suffix
places the chain of suffixes that end where it begins at the next free place of their groups. Nothing is renamed or
sorted recursively."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """The start positions of text's suffixes in ascending order, a proper prefix first."""
    n = len(text)
    if n < 2:
        return list(range(n))
    symbols = np.asarray(text)
    by_symbol = np.argsort(symbols, kind="stable")
    edges = np.flatnonzero(np.diff(symbols[by_symbol])) + 1
    members: list[list[int]] = [part.tolist() for part in np.split(by_symbol, edges)]
    below = list(range(-1, len(members) - 1))  # the next smaller group of each, and the next larger one
    above = [*range(1, len(members)), -1]
    group_of = [0] * n
    for g, part in enumerate(members):
        for s in part:
            group_of[s] = g
    done = [False] * len(members)
    pointer = [-1] * n  # the last earlier suffix of a smaller group
    order: list[int] = []  # groups from the largest down, with their final members
    g = len(members) - 1
    while g >= 0:
        done[g] = True  # also while its own members are looked at: a smaller group is wanted
        part = [s for s in members[g] if group_of[s] == g]
        if part:
            part.sort()
            members[g] = part
            order.append(g)
            hits: dict[int, int] = {}
            for s in part:
                p = s - 1
                while p >= 0 and done[group_of[p]]:
                    p = pointer[p]
                pointer[s] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            if hits:
                levels: dict[int, list[int]] = {}
                for p, k in hits.items():
                    levels.setdefault(k, []).append(p)
                for k in sorted(levels, reverse=True):
                    fresh: dict[int, int] = {}
                    for p in levels[k]:
                        old = group_of[p]
                        new = fresh.get(old)
                        if new is None:
                            new = fresh[old] = len(members)
                            members.append([])
                            done.append(False)
                            up = above[old]
                            below.append(old)
                            above.append(up)
                            above[old] = new
                            if up >= 0:
                                below[up] = new
                        members[new].append(p)
                        group_of[p] = new
        g = below[g]
    return _emit(members, order, group_of, pointer, n)


def _emit(members: list[list[int]], order: list[int], group_of: list[int], pointer: list[int], n: int) -> list[int]:
    free = [0] * len(members)
    at = 0
    for g in reversed(order):
        free[g] = at
        at += len(members[g])
    array = [-1] * n
    placed = [False] * n
    # The empty suffix is the smallest; it ends the last suffix's chain.
    s = n - 1
    i = -1
    while True:
        while s >= 0 and not placed[s]:
            g = group_of[s]
            array[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = pointer[s]
        i += 1
        if i >= n:
            return array
        s = array[i] - 1
