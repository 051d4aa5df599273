"""Suffix sorting by Lyndon grouping, in linear time and without recursive renaming.

Phase 1 groups suffixes by their longest Lyndon prefix. Groups are taken in descending
order; each member looks up the previous position of a lower group, and positions are
moved to new groups directly above their old one, those with most members pointing at
them highest. Phase 2 walks the suffix array from its start and puts, for the suffix just
reached, the text position before it and that position's chain of previous-smaller
pointers at the front of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, previous-smaller pointers (-1: none), and the groups in ascending order."""
    n = len(text)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in members:
            members[c].append(i)
        else:
            members[c] = [i]
    order = sorted(members)
    lists = [members[c] for c in order]  # by group number
    number = {c: k for k, c in enumerate(order)}
    group = [number[c] for c in text]
    below = list(range(-1, len(order) - 1))
    above = [*range(1, len(order)), -1]
    done = bytearray(n)
    previous = [-1] * n
    g = len(order) - 1
    top = g
    while g >= 0:
        own = lists[g]
        if len(own) == 1:
            i = own[0]
            if group[i] == g:
                done[i] = 1
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                if p >= 0:
                    previous[i] = p
                    old = group[p]
                    if len(lists[old]) == 1:  # alone already: a new group would not change the order
                        g = below[g]
                        continue
                    new = len(lists)
                    lists.append([p])
                    group[p] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
            g = below[g]
            continue
        own = [i for i in own if group[i] == g]
        lists[g] = own
        if own:
            own.sort()
            for i in own:
                done[i] = 1
            pointed: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                if p >= 0:
                    previous[i] = p
                    pointed[p] = pointed.get(p, 0) + 1
            if pointed:
                counts = set(pointed.values())
                for k in sorted(counts, reverse=True) if len(counts) > 1 else counts:
                    into: dict[int, list[int]] = {}
                    for p, c in pointed.items():
                        if c == k:
                            old = group[p]
                            if old in into:
                                into[old].append(p)
                            else:
                                into[old] = [p]
                    for old, moved in into.items():
                        new = len(lists)
                        lists.append(moved)
                        for p in moved:
                            group[p] = new
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                        else:
                            top = new
        g = below[g]
    ascending = []
    g = top
    while g >= 0:
        ascending.append(g)
        g = below[g]
    ascending.reverse()
    return group, previous, ascending


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in lexicographic order; a prefix comes first."""
    n = len(text)
    if not n:
        return []
    group, previous, ascending = lyndon_groups(text)
    size = [0] * (max(ascending) + 1)
    for g in group:
        size[g] += 1
    free, at = [0] * len(size), 0
    for g in ascending:
        free[g] = at
        at += size[g]
    out = [0] * n
    placed = bytearray(n)

    def place(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]

    place(n - 1)  # the chain before the empty suffix
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out
