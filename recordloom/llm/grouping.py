"""Suffix sorting of a sequence of integers by grouping, in linear time and without renaming.

First phase. A group holds the suffixes that share a Lyndon prefix as far as it is known; at first that is one symbol. Groups are taken from the greatest
to the least. Each suffix of the group taken follows a nearest earlier suffix of a lower group (its previous smaller one, found through the pointers of suffixes passed before); that
suffix's Lyndon prefix grows by the group's, once for each such follower, so it moves to a new group just above its own, the higher the more followers. In the end groups stand in the
order of their Lyndon prefixes.

Second phase. The suffix sorted last shows which suffixes end their Lyndon prefix where it starts: the one before it, that one's previous smaller suffix, and so on up to one that has its
place already. In this order each group fills up from its front.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of a sequence of non-negative integers, sorted; a suffix comes before those it begins."""
    text = [int(x) + 1 for x in symbols] + [0]
    n = len(text)
    if n == 1:
        return np.zeros(0, np.int64)
    # groups: members (some may have moved on), and the next lower and higher group
    order = np.argsort(np.asarray(text), kind="stable")
    cuts = np.flatnonzero(np.diff(np.asarray(text)[order])) + 1
    members: list[list[int]] = [x.tolist() for x in np.split(order, cuts)]
    k = len(members)
    lower = list(range(-1, k - 1))
    higher = [*range(1, k), -1]
    group_of = [0] * n
    for g, own in enumerate(members):
        for s in own:
            group_of[s] = g
    previous = [-1] * n
    done = bytearray(n)
    sizes: list[tuple[int, int]] = []  # group and size, from the greatest group on
    g = k - 1
    while g >= 0:
        own = [s for s in members[g] if group_of[s] == g]
        if own:
            if len(own) > 1:
                own.sort()
            members[g] = own
            for s in own:
                done[s] = 1
            followers: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    followers[p] = followers.get(p, 0) + 1
            sizes.append((g, len(own)))
            moved: dict[tuple[int, int], list[int]] = {}
            for p, count in followers.items():
                key = (group_of[p], count)
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            for h, count in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                above = higher[h]  # groups of more followers stand there already
                new = len(members)
                own = moved[h, count]
                members.append(own)
                for p in own:
                    group_of[p] = new
                lower.append(h)
                higher.append(above)
                higher[h] = new
                if above >= 0:
                    lower[above] = new
        g = lower[g]
    place = [0] * len(members)
    at = 0
    for g, size in reversed(sizes):
        place[g] = at
        at += size
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group_of[p]
            out[place[g]] = p
            place[g] += 1
            placed[p] = 1
            p = previous[p]
    return np.asarray(out[1:], np.int64)
