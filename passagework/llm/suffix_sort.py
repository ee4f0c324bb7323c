"""Suffix array by linear grouping, without recursion or renaming (after Baier, 2016).

Suffixes are grouped by their longest Lyndon prefix. Groups begin as first
symbols and are processed from the largest down. The pointer of each member to
the previous smaller group names the suffix whose Lyndon prefix the member's
word continues; that suffix moves to a new group just above its own, further up
the more often the word follows in a row. A second pass emits the order: the
suffixes that end where the next smallest one begins come next in their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of non-negative integers; a suffix comes before those it begins."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    bounds = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1], True])
    starts = np.empty(n, np.int64)
    starts[order] = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    # Plain lists: the passes below touch single elements.
    slot, place, group, before = order.tolist(), at.tolist(), starts.tolist(), [-1] * n
    stop = dict(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

    high = n
    while high > 0:
        low = group[slot[high - 1]]
        members = sorted(slot[low:high]) if high - low > 1 else slot[low:high]
        times: dict[int, int] = {}  # of a suffix: how often this group's word follows it in a row
        run: dict[int, int] = {}
        most = 0
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            k = 1
            if p >= 0 and group[p] == low:
                k = run[p] + 1
                p = before[p]
            before[s] = p
            if high - low > 1:
                run[s] = k
            if p >= 0:
                times[p] = k
                if k > most:
                    most = k
        counted: dict[int, list[int]] = {1: list(times)} if most == 1 else {}
        if most > 1:
            for p, k in times.items():
                counted.setdefault(k, []).append(p)
        for k in sorted(counted, reverse=True):
            moving = counted[k]
            by_group: dict[int, list[int]] = {}
            for p in moving:
                g = group[p]
                if g in by_group:
                    by_group[g].append(p)
                else:
                    by_group[g] = [p]
            for g, ps in by_group.items():
                end = stop[g]
                new = end - len(ps)
                if new == g:
                    continue
                for p in ps:
                    end -= 1
                    here, other = place[p], slot[end]
                    slot[here], slot[end] = other, p
                    place[other], place[p] = here, end
                    group[p] = new
                stop[new], stop[g] = stop[g], new
        high = low

    # The end of the text is the smallest suffix; from there the order of each group fills up.
    out, done, free = [0] * n, [False] * n, {g: g for g in set(group)}
    s = n - 1
    while s >= 0:
        g = group[s]
        out[free[g]] = s
        free[g] += 1
        done[s] = True
        s = before[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = before[s]
    return np.array(out)
