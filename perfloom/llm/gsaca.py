"""Suffix arrays by linear grouping (GSACA).

Suffixes are put into groups by their longest Lyndon prefix; then the order within groups follows from that of the
suffixes behind these prefixes. No sorted names are made, and nothing recurs.
"""

from __future__ import annotations


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffixes in group order, start of each suffix's group, previous smaller suffix of each, or -1).

    Groups begin as those of the first symbol and are handled from the highest down. Each suffix of a group points to
    the nearest suffix before it in a lower group; those pointed to leave their group for a new one right above it, the
    higher, the more suffixes of the present group point to them. Symbols, numbers from 0 on, and pointers are counted
    instead of sorted, so that time is linear in the text and its largest symbol.
    """
    n = len(text)
    buckets: list[list[int]] = [[] for _ in range(max(text, default=-1) + 1)]
    for s, x in enumerate(text):
        buckets[x].append(s)
    order = [s for b in buckets for s in b]
    # Before -1, a suffix's pointer is not known yet.
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-2] * n
    start = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            start = k
        place[s] = k
        group[s] = start
        size[start] += 1
    last = n - 1
    while last >= 0:
        first = group[order[last]]
        if first == last:
            s = order[first]
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[s] = p
            if p >= 0:
                h = group[p]
                c = size[h]
                if c > 1:
                    # The one suffix goes to the end of its group and is a group from now on.
                    to, at = h + c - 1, place[p]
                    q = order[to]
                    order[to], order[at] = p, q
                    place[p], place[q] = to, at
                    group[p] = to
                    size[to] = 1
                    size[h] = c - 1
            last = first - 1
            continue
        votes: dict[int, int] = {}
        for s in order[first : last + 1]:
            if before[s] != -2:
                continue
            p = s - 1
            while p >= 0 and group[p] >= first and before[p] != -2:
                p = before[p]
            if p < 0 or group[p] < first:
                before[s] = p
                if p >= 0:
                    votes[p] = votes.get(p, 0) + 1
                continue
            # A suffix of the same group on the way that has no pointer yet gets its own first.
            todo = [(s, p), (p, p - 1)]
            while todo:
                t, p = todo.pop()
                while p >= 0 and group[p] >= first and before[p] != -2:
                    p = before[p]
                if p >= 0 and group[p] >= first:
                    todo += [(t, p), (p, p - 1)]
                    continue
                before[t] = p
                if p >= 0:
                    votes[p] = votes.get(p, 0) + 1
        by: list[dict[int, list[int]]] = [{} for _ in range(max(votes.values(), default=0) + 1)]
        for p, k in votes.items():
            by[k].setdefault(group[p], []).append(p)
        for same in reversed(by):
            for h, ps in same.items():
                end = h + size[h]
                new = end - len(ps)
                if new > h:
                    to = end
                    for p in ps:
                        to -= 1
                        at = place[p]
                        q = order[to]
                        order[to], order[at] = p, q
                        place[p], place[q] = to, at
                    for p in ps:
                        group[p] = new
                    size[new] = len(ps)
                    size[h] = new - h
        last = first - 1
    return order, group, before


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of `text`, whose last symbol must be its only smallest one."""
    n = len(text)
    if not n:
        return []
    _, group, before = lyndon_groups(text)
    free, out = {}, [-1] * n
    out[0] = n - 1
    free[group[n - 1]] = group[n - 1] + 1
    for i in range(n):
        s = out[i]
        # The suffixes whose next smaller suffix is s: each is its Lyndon prefix followed by s.
        stop, j = before[s], s - 1
        while j != stop:
            g = group[j]
            at = free.get(g, g)
            out[at] = j
            free[g] = at + 1
            j = before[j]
    return out
