"""Suffix arrays by grouping suffixes by their Lyndon prefixes, in linear time and without recursion.

Phase 1 starts with suffixes grouped by their first symbol and takes the groups in descending order. For each suffix of
a group, a pointer gives the nearest suffix before it of a lower group; those that are pointed at have their group's
prefix followed by the finished group's, so they move to a new group after their old one, ordered by how often they are
pointed at. At the end, a group holds the suffixes with one longest Lyndon prefix, and groups are in order.
Phase 2 goes through the suffix array as it fills: the suffix before the current one, and those reached from it by the
pointers, take the next free places of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of integers."""
    n = len(symbols) + 1
    ranks = np.r_[np.unique(symbols, return_inverse=True)[1] + 1, 0] if n > 1 else np.zeros(1, np.int64)
    counts = np.bincount(ranks)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    order: list[int] = np.argsort(ranks, kind="stable").tolist()
    group: list[int] = starts[ranks].tolist()  # of each suffix: where its group begins
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n  # of each group, at its beginning
    for a, c in zip(starts.tolist(), counts.tolist()):
        size[a] = c
    before = [-1] * n
    end = n
    while end > 0:
        begin = group[order[end - 1]]
        members = order[begin:end]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = begin
        if not pointed:
            continue
        if len(members) == len(pointed):
            levels = [list(pointed)]
        else:
            by: dict[int, list[int]] = {}
            for p, c in pointed.items():
                by.setdefault(c, []).append(p)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for j in level:
                h = group[j]
                size[h] -= 1
                last = h + size[h]
                at = place[j]
                if at != last:
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last], place[j] = j, last
                moved[h] = moved.get(h, 0) + 1
            for h, k in moved.items():
                new = h + size[h]
                size[new] = k
                if new != h:
                    for j in order[new : new + k]:
                        group[j] = new
    free = list(range(n))
    out = [0] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(out[1:], np.int64)
