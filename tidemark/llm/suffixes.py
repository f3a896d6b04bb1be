"""Suffix arrays of many small groups of strings at once, by linear grouping.

Suffixes are grouped by their Lyndon prefix. In the first phase the groups of a string are taken in
descending order: the previous-smaller pointers of a group's suffixes lead to the suffixes whose
prefix goes on with the group's, and those move to new groups just above their old ones, by how often
it does. In the second phase groups are emitted in ascending order: every suffix puts the suffixes whose Lyndon prefix
ends where it begins to the next place of their group. Nothing is renamed or solved again.

The strings of a batch take their steps together, so each step is a few array operations.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.texts import segments


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of several runs, one after another."""
    return np.repeat(first, length) + segments(length)


def lyndon_groups(symbols: np.ndarray, base: np.ndarray, length: np.ndarray):
    """First phase. Strings lie one after another, 2 billion symbols at most; each ends in its only 0.

    Returns for every suffix the first slot of its group, and for every slot that begins a
    group its size and the length of its prefix. Slots of a string are those of its symbols.
    """
    total = len(symbols)
    owner = np.repeat(np.arange(len(base)), length)
    at = np.lexsort((symbols, owner))
    first = np.ones(total, dtype=bool)
    first[1:] = (symbols[at][1:] != symbols[at][:-1]) | (owner[at][1:] != owner[at][:-1])
    heads = np.flatnonzero(first)
    slot_head = np.repeat(heads, np.diff(np.append(heads, total)))
    head = np.empty(total, dtype=np.int32)  # of the group of a suffix
    head[at] = slot_head
    slot = np.empty(total, dtype=np.int32)  # of a suffix
    slot[at] = np.arange(total)
    at = at.astype(np.int32)
    size, prefix = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
    size[heads], prefix[heads] = np.diff(np.append(heads, total)), 1
    # The suffix before, or -1 at the front of a string; shifted by one, so that -1 has a place.
    previous = np.arange(-2, total - 1, dtype=np.int32)
    previous[0] = previous[base + 1] = -1
    lowest = np.concatenate([[-1], head]).astype(np.int32)  # the same shift; -1 is below every group

    todo = base + length  # slots from here on are done
    open_ = np.arange(len(base))
    while len(open_):
        end = todo[open_]
        group = head[at[end - 1]]
        todo[open_] = group
        members = at[_ranges(group, end - group)]
        own = np.repeat(group, end - group)
        # Previous-smaller pointers, by pointer jumping over groups that are not lower.
        pointer = previous[members + 1]
        moving = np.flatnonzero(lowest[pointer + 1] >= own)
        while len(moving):
            pointer[moving] = previous[pointer[moving] + 1]
            previous[members[moving] + 1] = pointer[moving]
            moving = moving[lowest[pointer[moving] + 1] >= own[moving]]
        previous[members + 1] = pointer
        inside = pointer >= 0
        if inside.any():
            moved, where, times = np.unique(pointer[inside], return_index=True, return_counts=True)
            added = prefix[own[inside][where]]
            order = np.lexsort((times, head[moved]))
            moved, times, added = moved[order], times[order], added[order]
            old = head[moved]
            new_old = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            count = np.diff(np.append(new_old, len(old)))
            groups = old[new_old]
            left = size[groups] - count
            # Moved suffixes go to the last slots of their group; suffixes that stay there swap with them.
            target = _ranges(groups + left, count)
            in_target = slot[moved] >= np.repeat(groups + left, count)
            sitting = at[target]
            by_place = np.sort(moved)
            found = np.minimum(np.searchsorted(by_place, sitting), len(by_place) - 1)
            staying = sitting[by_place[found] != sitting]
            holes = slot[moved[~in_target]]
            at[holes], slot[staying] = staying, holes
            at[target], slot[moved] = moved, target
            # New groups: a run of the same old group and the same number of times.
            starts = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
            run = np.diff(np.append(starts, len(old)))
            heads_new = target[starts]
            longer = prefix[old[starts]] + times[starts] * added[starts]
            size[groups] = left
            size[heads_new], prefix[heads_new] = run, longer
            head[moved] = np.repeat(heads_new, run)
            lowest[moved + 1] = head[moved]
        open_ = open_[todo[open_] > base[open_]]
    return head, size, prefix


def suffix_order(symbols: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings that lie one after another, each ended by its only 0."""
    head, size, prefix = lyndon_groups(symbols, base, length)
    total = len(symbols)
    # Suffixes whose Lyndon prefix ends where another begins, listed by that one.
    follows = np.arange(total) + prefix[head]
    last = base + length - 1
    follows[last] = total
    children = np.argsort(follows, kind="stable")
    n_children = np.bincount(follows, minlength=total + 1)[:total]
    first_child = np.cumsum(n_children) - n_children
    group_of_slot = np.empty(total, dtype=np.int64)
    heads = np.flatnonzero(size > 0)
    group_of_slot[_ranges(heads, size[heads])] = np.repeat(heads, size[heads])

    out, filled = np.full(total, -1, dtype=np.int32), np.zeros(total, dtype=np.int32)
    out[base], filled[base] = last, 1
    now, stop = base.copy(), base + length
    open_ = np.arange(len(base))
    while len(open_):
        at = now[open_]
        group = group_of_slot[at]
        until = group + filled[group]
        suffix = out[_ranges(at, until - at)]
        placed = children[_ranges(first_child[suffix], n_children[suffix])]
        if len(placed):
            target = head[placed]
            order = np.argsort(target, kind="stable")
            placed, target = placed[order], target[order]
            starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            run = np.diff(np.append(starts, len(target)))
            out[target + filled[target] + segments(run)] = placed
            filled[target[starts]] += run
        now[open_] = until
        open_ = open_[now[open_] < stop[open_]]
    return out
