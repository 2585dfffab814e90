"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefixes, groups being handled from the highest to the lowest. A suffix of the
group at hand ends the context of its previous smaller suffix, which therefore moves to a higher group beside its own,
the higher the more suffixes of the group point to it. Afterwards one pass over the growing result writes every
group's suffixes in order: a suffix comes into place with the first smaller suffix to its right.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """Places of all suffixes of text in ascending order; text holds numbers above zero."""
    letters = np.concatenate([np.asarray(text, np.int64), [0]])
    n = len(letters)
    if n == 1:
        return []
    # the first groups are those of one letter: start of each suffix's group in order, its place there, group sizes
    by_letter = np.argsort(letters.astype(np.uint16) if letters.max() < 1 << 16 else letters, kind="stable")
    _, first, sizes = np.unique(letters[by_letter], return_index=True, return_counts=True)
    heads, places, widths = np.empty((3, n), np.int64)
    heads[by_letter], places[by_letter] = np.repeat(first, sizes), np.arange(n)
    widths[:] = 0
    widths[first] = sizes
    order, head, place, size = by_letter.tolist(), heads.tolist(), places.tolist(), widths.tolist()

    before = [-1] * n  # previous smaller suffix
    top = n - 1
    while top > 0:
        group = head[order[top]]
        own = order[group : top + 1]
        if len(own) == 1:
            s = own[0]
            p = s - 1
            while p >= 0 and head[p] >= group:
                p = before[p]
            before[s] = p
            if p >= 0:  # one suffix moves to the end of its group
                h = head[p]
                last = h + size[h] - 1
                if size[h] > 1:
                    k, other = place[p], order[last]
                    order[k], order[last] = other, p
                    place[other], place[p] = k, last
                    size[h] -= 1
                    head[p] = last
                    size[last] = 1
            top = group - 1
            continue
        own.sort()
        times: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and head[p] >= group:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[int, list[int]] = {}
        for p in times:
            h = head[p]
            if h in moved:
                moved[h].append(p)
            else:
                moved[h] = [p]
        for h, those in moved.items():
            k = h + size[h]
            if len(those) == 1:
                if size[h] == 1:
                    continue
            else:
                those.sort(key=times.__getitem__)
            left = size[h] - len(those)
            # the highest go last; each swap keeps the rest of the group in front
            at, level, count = k, -1, 0
            for p in reversed(those):
                at -= 1
                q, other = place[p], order[at]
                order[q], order[at] = other, p
                place[other], place[p] = q, at
            size[h] = left
            first = at
            for q in range(at, k):
                p = order[q]
                if times[p] != level:
                    if count:
                        size[first] = count
                    first, level, count = q, times[p], 0
                head[p] = first
                count += 1
            size[first] = count
        top = group - 1

    free = list(range(n))
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            h = head[s]
            k = free[h]
            free[h] = k + 1
            out[k] = s
            done[s] = 1
            s = before[s]
    return out[1:]
