"""Suffix arrays by linear grouping construction.

Every suffix starts with its longest Lyndon word, its Lyndon prefix, which ends where the next smaller suffix begins.  Suffixes
are first grouped by Lyndon prefix, then ordered inside the groups:

* The previous smaller suffix of i (``previous_smaller``) makes a forest; the Lyndon prefix of i is its first symbol followed by
  the Lyndon prefixes of its children, in text order, which never ascend.
* Groups start as buckets of first symbols.  The highest group that isn't done is final.  All parents of its members are moved
  up out of their own group, as far as the number of children they have in the final group says: their prefix has become longer by as many copies.
* In the order of suffixes found so far, every suffix i lets those that end at it (their next smaller suffix is i) take the next
  free place of their groups.  No names are given again, and nothing recurs.
"""

from __future__ import annotations

from collections import Counter

_LOOK = 48


def previous_smaller(text: bytes) -> list[int]:
    """For each suffix the nearest one before it that is smaller, or -1."""
    found: list[int] = []
    stack: list[int] = []
    n = len(text)
    for i in range(n):
        own = text[i : i + _LOOK]
        while stack:
            j = stack[-1]
            other = text[j : j + _LOOK]
            if other < own:
                break
            if other == own:
                if i + _LOOK > n:  # equal as far as both reach, and j reaches further
                    pass
                elif _less(text, j + _LOOK, i + _LOOK):
                    break
            stack.pop()
        found.append(stack[-1] if stack else -1)
        stack.append(i)
    return found


def _less(text: bytes, a: int, b: int) -> bool:
    """Is suffix a smaller than suffix b?  (The one that ends first is the smaller one.)"""
    step = 512
    while True:
        x, y = text[a : a + step], text[b : b + step]
        if x != y:
            return x < y
        if len(x) < step:
            return len(text) - a < len(text) - b
        a, b, step = a + step, b + step, step * 2


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order (a suffix stands before those it is a prefix of)."""
    n = len(text)
    if n == 0:
        return []
    parent = previous_smaller(text)
    members: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        members[c].append(i)
    group = list(text)
    below = list(range(-1, 255))
    above = list(range(1, 257))
    above[255] = -1
    done: list[int] = []
    current = 255
    take = parent.__getitem__

    def move(nodes: list[int], after: int) -> int:
        """A new group of ``nodes``, just above group ``after``."""
        g = len(members)
        members.append(nodes)
        top = above[after]
        below.append(after)
        above.append(top)
        above[after] = g
        if top >= 0:
            below[top] = g
        for p in nodes:
            group[p] = g
        return g

    while current >= 0:
        own = members[current]
        if own and len(own) > 1:
            own = [i for i in own if group[i] == current]
            members[current] = own
        elif own and group[own[0]] != current:
            own = members[current] = []
        if own:
            done.append(current)
            if len(own) == 1:
                if (p := parent[own[0]]) >= 0:
                    move([p], group[p])
            else:
                counted = Counter(map(take, own))
                counted.pop(-1, None)
                sets: dict[tuple[int, int], list[int]] = {}
                for p, k in counted.items():
                    if (key := (group[p], k)) in sets:
                        sets[key].append(p)
                    else:
                        sets[key] = [p]
                if len(sets) == 1:
                    ((g, _), nodes), = sets.items()
                    move(nodes, g)
                else:
                    last: dict[int, int] = {}
                    for g, k in sorted(sets):
                        last[g] = move(sets[g, k], last.get(g, g))
        current = below[current]

    place: dict[int, int] = {}
    at = 0
    for g in reversed(done):
        place[g] = at
        at += len(members[g])
    order = [0] * n
    # the empty suffix comes first; those that end at it go up from the last position to a root
    j = n - 1
    while j >= 0:
        g = group[j]
        order[place[g]] = j
        place[g] += 1
        j = parent[j]
    for k in range(n):
        i = order[k]
        stop = parent[i]
        j = i - 1
        while j != stop:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            j = parent[j]
    return order
