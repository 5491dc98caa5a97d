"""Suffix arrays by linear grouping, without recursion or renaming.

Phase 1 sorts suffixes into groups whose members share their Lyndon prefix. Groups are taken in descending
order. Each member finds its previous smaller position by following the pointers of positions already taken;
the positions found are pulled to the end of their own group, ordered by how many members point to them, which
splits that group. Phase 2 scans the array upwards: each placed suffix puts the suffix before it, and the
previous-smaller chain of that, at the front of their groups.

``suffix_array`` does one string in plain Python; ``suffix_arrays`` does many short strings in lockstep on numpy
arrays, one group of every string a round.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in ascending order (the empty suffix left out)."""
    n = len(text) + 1
    symbol = [c + 1 for c in text]
    symbol.append(0)
    sa = sorted(range(n), key=symbol.__getitem__)
    pos, isa, end = [0] * n, [0] * n, [0] * n
    start = last = -1
    for k, i in enumerate(sa):
        if symbol[i] != last:
            last, start = symbol[i], k
        pos[i], isa[i] = k, start
        end[start] = k
    del symbol
    done, prev, top = bytearray(n), [-1] * n, n - 1
    while top > 0:
        low = isa[sa[top]]
        mine = sorted(sa[low : top + 1])
        for i in mine:
            done[i] = 1
        pulls: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pulls[p] = pulls.get(p, 0) + 1
        top = low - 1
        # from the last slot of each group downwards, those with most pointers first
        group = count = slot = -1
        for g, c, p in sorted(((isa[p], c, p) for p, c in pulls.items()), reverse=True):
            if g != group:
                group, count, slot = g, -1, end[g]
            if c != count:
                count, last = c, slot
            other, where = sa[slot], pos[p]
            sa[where], pos[other] = other, where
            sa[slot], pos[p] = p, slot
            slot -= 1
            end[slot + 1] = last
            if slot >= g:
                end[g] = slot
        group = count = start = -1
        for g, c, p in sorted((isa[p], c, pos[p]) for p, c in pulls.items()):
            if g != group or c != count:
                group, count, start = g, c, p
            isa[sa[p]] = start
    order, nxt, placed = [0] * n, list(range(n)), bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = isa[j]
            order[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = prev[j]
    return order[1:]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All of lo..hi (both in) of each pair, one after the other."""
    size = hi - lo + 1
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(lo - ends + size, size)


def suffix_arrays(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, base): the suffixes of each text in ascending order, as positions in the joined texts.

    Text k stands at base[k] of b"\\0".join-like storage: each text is followed by one end position, and its
    slice starts[base[k]:base[k + 1]] lists the end position first.
    """
    size = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(size)
    base, total = ends - size, int(ends[-1])
    symbol = np.zeros(total, np.int16)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    symbol[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    index = np.int32 if total < 2**31 - 1 else np.int64
    owner = np.repeat(np.arange(len(texts), dtype=index), size)
    sa = np.lexsort((symbol, owner)).astype(index)
    first = np.flatnonzero(np.r_[True, (symbol[sa][1:] != symbol[sa][:-1]) | (owner[sa][1:] != owner[sa][:-1])])
    count = np.diff(np.r_[first, total])
    pos, isa, end = np.empty(total, index), np.empty(total, index), np.zeros(total, index)
    pos[sa] = np.arange(total)
    isa[sa] = np.repeat(first, count)
    end[first] = first + count - 1
    prev = np.arange(-1, total, dtype=index)  # slot total stands for "none"
    prev[base] = total
    done, mark = np.zeros(total + 1, bool), np.zeros(total, bool)
    top = ends - 1
    live = np.flatnonzero(top > base)
    while live.size:
        hi = top[live]
        lo = isa[sa[hi]]
        mine = sa[_ranges(lo, hi)]
        done[mine] = True
        p = prev[mine]
        open_ = np.flatnonzero(done[p])
        while open_.size:
            p[open_] = prev[p[open_]]
            prev[mine[open_]] = p[open_]
            open_ = open_[done[p[open_]]]
        prev[mine] = p
        top[live] = lo - 1
        live = live[lo - 1 > base[live]]
        p = np.sort(p[p < total])
        if not p.size:
            continue
        cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        u, c = p[cut], np.diff(np.r_[cut, p.size])
        h = isa[u]
        o = np.lexsort((c, h))
        u, c, h = u[o], c[o], h[o]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        k = np.diff(np.r_[cut, u.size])
        last = end[h[cut]]
        low = np.repeat(last - k + 1, k)
        slot = low + np.arange(u.size) - np.repeat(cut, k)
        mark[u] = True
        there, was = sa[slot], pos[u]
        pushed, freed = there[~mark[there]], was[was < low]
        mark[u] = False
        sa[freed], pos[pushed] = pushed, freed
        sa[slot], pos[u] = u, slot
        left = last - k
        some = left >= h[cut]
        end[h[cut][some]] = left[some]
        cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        k = np.diff(np.r_[cut, u.size])
        isa[u] = np.repeat(slot[cut], k)
        end[slot[cut]] = slot[cut] + k - 1
    out, nxt = np.empty(total, index), np.arange(total, dtype=index)
    placed = np.zeros(total + 1, bool)
    placed[ends - 1] = placed[total] = True
    out[base] = ends - 1
    at = base.copy()
    j = np.where(size > 1, ends - 2, total)
    live = np.arange(len(texts))
    while live.size:
        now = j[live]
        ready = ~placed[now]
        run, x = live[ready], now[ready]
        g = isa[x]
        out[nxt[g]] = x
        nxt[g] += 1
        placed[x] = True
        j[run] = prev[x]
        wait = live[~ready]
        if wait.size:
            at[wait] += 1
            ended = at[wait] >= ends[wait]
            if ended.any():
                live = live[ready | (at[live] < ends[live])]
                wait = wait[~ended]
            s = out[at[wait]]
            j[wait] = np.where(s == base[wait], total, s - 1)
    return out, base
