"""Suffix arrays of many small strings by linear grouping, side by side.

The construction of Baier (2016): phase one keeps suffixes in groups ordered
by their Lyndon prefix and takes the groups from the highest to the lowest;
every member of a group points to the last suffix before it that stands in a
lower group (its previous smaller one), and suffixes that are pointed to
equally often move together into a new group right above their old one.
Phase two emits each group's order by following those pointers from the
suffixes already placed.  Nothing is renamed recursively.

Each step is done for all strings at once: one round of phase one takes the
highest open group of every string, one round of phase two the next place of
every string.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated start[i] .. start[i] + size[i] - 1."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def suffix_arrays(symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``symbols`` holds strings one after another, string i at ``first[i]``
    with ``size[i]`` symbols, each ending with its only 0.  The result has, in
    the place of each string, its suffixes in order, as positions."""
    n = len(symbols)
    of = np.repeat(np.arange(len(first)), size)
    begin = first[of]
    order = np.argsort(of.astype(np.int64) * 65536 + symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    heads = _edges(of[order], symbols[order])
    group = np.empty(n, np.int64)       # number of a group: its first place
    count = np.zeros(n, np.int64)
    count[heads] = np.diff(np.append(heads, n))
    group[order] = np.repeat(heads, count[heads])
    previous = np.full(n, -1, np.int64)
    marked = np.zeros(n, bool)

    # phase one
    top = first + size
    open_ = np.arange(len(first))
    while len(open_):
        end = top[open_]
        start = group[order[end - 1]]
        members = np.sort(order[_ranges(start, end - start)])
        mine = group[members]
        low = begin[members]
        at = members - 1
        at[at < low] = -1
        walk = np.flatnonzero(at >= 0)
        while len(walk):
            walk = walk[group[at[walk]] > mine[walk]]
            at[walk] = previous[at[walk]]
            walk = walk[at[walk] >= 0]
        previous[members] = at
        same = np.flatnonzero(at >= 0)
        while True:
            same = same[group[previous[members[same]]] == mine[same]]
            if not len(same):
                break
            previous[members[same]] = previous[previous[members[same]]]
            same = same[previous[members[same]] >= 0]
        pointed = previous[members]
        pointed = np.sort(pointed[pointed >= 0])
        if len(pointed):
            e = _edges(pointed)
            times = np.diff(np.append(e, len(pointed)))
            moving = pointed[e]
            old = group[moving]
            by = np.lexsort((times, old))
            moving, times, old = moving[by], times[by], old[by]
            e = _edges(old)
            n_moving = np.diff(np.append(e, len(old)))
            tail = old[e] + count[old[e]] - n_moving
            place = _ranges(tail, n_moving)
            marked[moving] = True
            there = order[place]
            pushed = there[~marked[there]]
            marked[moving] = False
            freed = rank[moving]
            freed = freed[freed < np.repeat(tail, n_moving)]
            order[freed], rank[pushed] = pushed, freed
            order[place], rank[moving] = moving, place
            count[old[e]] -= n_moving
            e = _edges(old, times)
            in_new = np.diff(np.append(e, len(old)))
            group[moving] = np.repeat(place[e], in_new)
            count[place[e]] = in_new
        top[open_] = start
        open_ = open_[start > first[open_]]

    # phase two
    out = np.full(n, -1, np.int64)
    out[first] = first + size - 1
    done = np.zeros(n, bool)
    done[first + size - 1] = True
    free = np.arange(n)
    long_first = np.argsort(-size, kind="stable")
    first, size = first[long_first], size[long_first]
    alive = len(first)
    for i in range(int(size[0]) if len(size) else 0):
        while size[alive - 1] <= i:
            alive -= 1
        at = out[first[:alive] + i] - 1
        at = at[at >= first[:alive]]
        while len(at):
            at = at[~done[at]]
            g = group[at]
            out[free[g]] = at
            free[g] += 1
            done[at] = True
            at = previous[at]
            at = at[at >= 0]
    return out
