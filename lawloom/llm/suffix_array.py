"""Suffix arrays by linear grouping construction.

Suffixes are first grouped by their Lyndon prefixes.  Groups are processed in
descending order: the previous smaller suffix of each member is found along
pointers over what has been processed, and is moved to a new, higher group
because its own prefix grows by the member's.  In the end groups are in
lexicographic order, and the suffixes' order follows by walking the array once
and placing, for each suffix, those whose next smaller suffix it is.  No ranks
are renamed and no recursion is needed.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (numbers from 0) in ascending order."""
    n = len(text)
    if n == 0:
        return []
    # Groups form a doubly linked list from low to high; members may be stale, group_of decides.
    members: list[list[int]] = []
    lower: list[int] = []
    higher: list[int] = []
    group_of = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        lower.append(g - 1)
        higher.append(g + 1)
        for i in by_symbol[c]:
            group_of[i] = g
    top = len(members) - 1
    higher[top] = -1

    # previous[i]: the previous smaller suffix of i once i is processed; -1 in front of the text.
    previous = [-2] * n
    g = top
    while g >= 0:
        own = [i for i in members[g] if group_of[i] == g]
        members[g] = own
        pointed: dict[int, int] = {}
        for i in own:
            previous[i] = i - 1  # for now: marks it as not lower
        for i in own:
            p = i - 1
            while p >= 0 and previous[p] != -2:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            # More repeats of this group's prefix come higher: split off by descending count.
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_count[k]:
                    moved.setdefault(group_of[p], []).append(p)
                for old, some in moved.items():
                    new = len(members)
                    members.append(some)
                    up = higher[old]
                    lower.append(old)
                    higher.append(up)
                    higher[old] = new
                    if up >= 0:
                        lower[up] = new
                    for p in some:
                        group_of[p] = new
        g = lower[g]

    # First free place of each group.
    place = [0] * len(members)
    lowest = group_of[0]
    while lower[lowest] >= 0:
        lowest = lower[lowest]
    at, g = 0, lowest
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = higher[g]

    out = [-1] * n
    placed = [False] * n
    # The empty suffix comes first; then each suffix found places those that end at it.
    for k in range(-1, n):
        p = (n if k < 0 else out[k]) - 1
        while p >= 0 and not placed[p]:
            g = group_of[p]
            out[place[g]] = p
            place[g] += 1
            placed[p] = True
            p = previous[p]
    return out
