"""Suffix arrays by grouping suffixes on their longest Lyndon prefixes.

First every suffix is put into a group by its first symbol.  Groups are taken
from the greatest down: each member points to the nearest position on its left
in a lower group (previous smaller), and the suffixes pointed at are extended by
the group's Lyndon prefix, as many times as members point there.  They leave
their group and form a new one right above it.  In the end a group holds the
suffixes with one longest Lyndon prefix, groups stand in order, and the suffix
behind that prefix is smaller than the suffix itself.  So one pass from the
smallest suffix up emits each group's order: a suffix goes to the next free
place of its group when the suffix behind its prefix comes up.  Nothing is
renamed and no smaller text is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int] | np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text of whole numbers, in ascending order; a prefix comes before what extends it."""
    codes = np.concatenate((np.unique(np.asarray(text), return_inverse=True)[1] + 1, [0])) if len(text) else np.zeros(1, np.int64)
    n = codes.size
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(start, size)
    group, prefix = _grouped(order, group, start, size)
    return _emitted(np.array(group), np.array(prefix))[1:]


def _grouped(order: np.ndarray, group: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[int], list[int]]:
    """The group of each suffix, named by its first place, and by name the length of its Lyndon prefix."""
    n = order.size
    end = np.zeros(n, np.int64)
    end[start] = start + size
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    end, at, order, group = end.tolist(), at.tolist(), order.tolist(), group.tolist()
    prefix, left = [1] * n, [-1] * n
    top = n
    while top > 0:
        own = group[order[top - 1]]
        unit = prefix[own]
        if top - own == 1:
            i = order[own]
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = left[j]
            left[i] = j
            if j >= 0:
                low = group[j]
                k = end[low] - 1
                if k > low:
                    other, free = order[k], at[j]
                    order[free], at[other] = other, free
                    order[k], at[j] = j, k
                    end[low], end[k] = k, k + 1
                    group[j] = k
                    prefix[k] = prefix[low] + unit
                else:
                    prefix[low] += unit
            top = own
            continue
        times: dict[int, int] = {}
        for i in sorted(order[own:top]):
            j = i - 1
            while j >= 0 and group[j] >= own:
                j = left[j]
            left[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            by.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by, reverse=True):
            for low, moved in by[k].items():
                stop = end[low]
                if stop - low == len(moved):
                    prefix[low] += k * unit
                    continue
                place = stop
                for j in moved:
                    place -= 1
                    other, free = order[place], at[j]
                    order[free], at[other] = other, free
                    order[place], at[j] = j, place
                for j in moved:
                    group[j] = place
                end[low], end[place] = place, stop
                prefix[place] = prefix[low] + k * unit
        top = own
    return group, prefix


def _emitted(group: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Suffixes in order: each follows the suffix behind its Lyndon prefix."""
    n = group.size
    behind = np.arange(n) + prefix[group]
    kids = np.argsort(behind, kind="stable").tolist()
    first = np.searchsorted(behind[kids], np.arange(n + 1)).tolist()
    group, free = group.tolist(), list(range(n))
    out = [0] * n
    out[0] = n - 1
    for k in range(n):
        s = out[k]
        for j in kids[first[s] : first[s + 1]]:
            low = group[j]
            place = free[low]
            free[low] = place + 1
            out[place] = j
    return np.array(out)
