"""Suffix arrays in linear time by grouping suffixes by their Lyndon prefixes.

Suffixes start in groups by first symbol. Groups are taken in descending order;
for each suffix of the group, its previous smaller suffix is the nearest one to
the left that lies in a lower group. That one's Lyndon prefix grows by the
group's, so it moves up, just above what stays of its own group, further the
more members of the group follow it. Once all groups are final, one ascending
scan puts the suffixes of every group in order along the same pointers: no
renaming and no recursion.
"""

from __future__ import annotations

from collections.abc import Iterator


def _moves(befores: list[int], group_of: list[int]) -> Iterator[tuple[int, list[int]]]:
    """(group, suffixes that leave it upwards): those that more members follow first."""
    counts: dict[int, int] = {}
    for p in befores:
        counts[p] = counts.get(p, 0) + 1
    levels: dict[int, list[int]] = {}
    for p, n in counts.items():
        levels.setdefault(n, []).append(p)
    for n in sorted(levels, reverse=True):
        parts: dict[int, list[int]] = {}
        for p in levels[n]:
            parts.setdefault(group_of[p], []).append(p)
        yield from parts.items()


def lyndon_groups(text: list[int]) -> tuple[list[int], list[list[int]], list[int]]:
    """(group of each suffix, members of each group from the highest down, previous smaller suffix or -1)."""
    n = len(text)
    symbols = sorted(set(text))
    name = {c: g for g, c in enumerate(symbols)}
    group_of = [name[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group_of):
        members[g].append(i)
    size = list(map(len, members))
    below = list(range(-1, len(symbols) - 1))
    above = list(range(1, len(symbols) + 1))
    done = bytearray(n + 1)  # done[-1], the place before the text, stays 0
    previous = [-1] * n
    jump = [-1] * n
    final: list[list[int]] = []
    g = len(symbols) - 1
    while g >= 0:
        own = members[g]
        if size[g] < len(own):
            own = [s for s in own if group_of[s] == g]
        final.append(own)
        if len(own) == 1:
            s = own[0]
            done[s] = 1
            j = k = s - 1
            while done[j]:
                j = jump[j]
            while k > j:
                jump[k], k = j, jump[k]
            previous[s] = jump[s] = j
            if j >= 0 and size[h := group_of[j]] > 1:
                size[h] -= 1
                group_of[j] = new = len(members)
                members.append([j])
                size.append(1)
                over = above[h]
                below.append(h)
                above.append(over)
                below[over] = above[h] = new
            g = below[g]
            continue
        for s in own:
            done[s] = 1
        befores = []
        for s in own:
            j = k = s - 1
            while done[j]:
                j = jump[j]
            while k > j:  # shorten the way for those to come
                jump[k], k = j, jump[k]
            previous[s] = jump[s] = j
            if j >= 0:
                befores.append(j)
        for h, moved in _moves(befores, group_of):
            if len(moved) < size[h]:
                new = len(members)
                members.append(moved)
                size.append(len(moved))
                size[h] -= len(moved)
                for p in moved:
                    group_of[p] = new
                over = above[h]
                below.append(h)
                above.append(over)
                below[over] = above[h] = new
        g = below[g]
    return group_of, final, previous


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order."""
    n = len(text)
    if not n:
        return []
    group_of, final, previous = lyndon_groups(text)
    place = [0] * (max(group_of) + 1)
    at = 0
    for own in reversed(final):
        place[group_of[own[0]]] = at
        at += len(own)
    order = [0] * n
    placed = bytearray(n)
    for i in range(-1, n):
        s = (order[i] if i >= 0 else n) - 1
        while s >= 0 and not placed[s]:
            g = group_of[s]
            order[place[g]] = s
            place[g] += 1
            placed[s] = 1
            s = previous[s]
    return order
