"""Suffix arrays by linear grouping, and repeated windows found with them. Runs inside tasks, on bounded texts."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of text, whose last symbol is its only smallest one.

    First phase: suffixes are grouped by their Lyndon prefix. Groups lie in the array in the order of these prefixes, at
    first by single symbols. They are taken from the last to the first. The nearest suffix before a member that lies in
    a lower group is its pointer to the previous smaller one; the group's prefix extends that suffix's prefix, so it
    moves to a new group right behind its own, one that was pointed to more often further behind.

    Second phase: a suffix is its Lyndon prefix and then a smaller suffix. So going up the array, the suffix before the
    one just met, and those that its pointers lead to, take the next free places of their groups, until one has a place.
    """
    n = len(text)
    first = np.argsort(text, kind="stable")
    edges = np.flatnonzero(np.diff(text[first], prepend=-1))
    sa = (first + 1).tolist()  # suffixes count from 1; 0 stands for none
    start, stop = edges.tolist(), [*edges[1:].tolist(), n]
    place = np.empty(n + 1, np.int64)
    place[first + 1] = np.arange(n)
    place = place.tolist()
    group = np.empty(n + 1, np.int64)
    group[first + 1] = np.searchsorted(edges, np.arange(n), side="right") - 1
    group = group.tolist()
    left = list(range(n + 1))  # of a suffix that was taken: one further left, on the way to the nearest that wasn't
    before = [0] * (n + 1)

    end = n
    while end:
        g = group[sa[end - 1]]
        begin = start[g]
        if end - begin == 1:
            i = sa[begin]
            p = left[i] = i - 1
            while left[p] != p:
                left[p] = p = left[left[p]]
            left[i] = before[i] = p
            if p:
                h = group[p]
                e = stop[h] - 1
                if e != start[h]:
                    q, k = sa[e], place[p]
                    sa[k], place[q] = q, k
                    sa[e], place[p] = p, e
                    stop[h] = e
                    group[p] = len(start)
                    start.append(e)
                    stop.append(e + 1)
            end = begin
            continue
        members = sa[begin:end]
        for i in members:
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while left[p] != p:
                left[p] = p = left[left[p]]
            left[i] = before[i] = p
            if p:
                times[p] = times.get(p, 0) + 1
        levels = sorted(set(times.values()), reverse=True)
        for level in levels:
            moved: dict[int, int] = {}
            for p, t in times.items():
                if t == level:
                    h = group[p]
                    new = moved.get(h)
                    if new is None:
                        new = moved[h] = len(start)
                        start.append(0)
                        stop.append(stop[h])
                    e = stop[h] - 1
                    q, k = sa[e], place[p]
                    sa[k], place[q] = q, k
                    sa[e], place[p] = p, e
                    stop[h] = e
                    group[p] = new
            for h, new in moved.items():
                start[new] = stop[h]
        end = begin

    out, free = [0] * n, start
    placed = bytearray(n + 1)
    out[0] = n
    placed[n] = 1
    for at in range(n):
        s = out[at] - 1
        while s and not placed[s]:
            g = group[s]
            k = free[g]
            out[k] = s
            free[g] = k + 1
            placed[s] = 1
            s = before[s]
    return np.array(out, np.int64) - 1


#: Bytes that a symbol of the sorted text holds.
STEP = 16


def repeated_windows(texts: list[bytes], phases: list[int], length: int) -> list[np.ndarray]:
    """For each text, a bool for each window of `length` bytes: whether it also starts elsewhere in these texts.

    Equal windows must lie alike in their texts: phases[i] is a place in text i that equal windows of other texts have
    at the same distance. So texts are read in symbols of STEP bytes that begin at distances from the phase divisible by
    STEP, and the suffix array of the symbols is a suffix array of those byte positions. Neighbours' common bytes are
    counted up to `length`. A window that begins l bytes before a symbol is repeated if one of the suffixes that share
    length - l bytes with the symbol's has the same l bytes before it.
    """
    sizes = np.array([max(0, len(t) - length + 1) for t in texts], np.int64)
    cuts = np.cumsum(sizes)
    flags = np.zeros(int(sizes.sum()), bool)
    chosen = np.flatnonzero(sizes).tolist()
    if not chosen:
        return np.split(flags, cuts[:-1]) if len(texts) else []
    heads = [phases[i] % STEP for i in chosen]
    lens = np.array([len(texts[i]) - h for i, h in zip(chosen, heads, strict=True)], np.int64)  # bytes in symbols
    counts = -(-lens // STEP)
    at = np.cumsum(counts) - counts
    total = int(counts.sum())
    # a text's symbols, padded by zeros; its head of less than STEP bytes stands in a row of its own, flush right
    body = bytearray()
    lead = np.zeros((len(chosen), STEP), np.uint8)
    for k, (i, h) in enumerate(zip(chosen, heads, strict=True)):
        body += texts[i][h:]
        body += bytes(-len(body) % STEP)
        if h:
            lead[k, STEP - h :] = np.frombuffer(texts[i][:h], np.uint8)
    cells = np.frombuffer(bytes(body), np.uint8).reshape(total, STEP)
    owner = np.repeat(np.arange(len(chosen)), counts)
    within = np.arange(total) - at[owner]
    held = np.minimum(STEP, lens[owner] - within * STEP)
    words = np.ascontiguousarray(cells).view(">u8").astype(np.uint64).reshape(total, 2)
    by = np.lexsort((held, words[:, 1], words[:, 0]))
    new = np.ones(total, bool)
    new[1:] = (words[by][1:] != words[by][:-1]).any(axis=1) | (held[by][1:] != held[by][:-1])
    symbol = np.empty(total, np.int64)
    symbol[by] = np.cumsum(new) + len(chosen)  # numbers up to len(chosen) end the texts, the least the whole
    text = np.empty(total + len(chosen), np.int64)
    spot = np.arange(total) + owner  # of a symbol in the text with ends
    text[spot] = symbol
    text[at + counts + np.arange(len(chosen))] = np.arange(len(chosen), 0, -1)
    order = suffix_array(text)
    back = np.full(len(text), -1, np.int64)
    back[spot] = np.arange(total)
    rank = back[order]
    rank = rank[rank >= 0]  # symbols by the order of their suffixes
    common = _common(rank, cells, symbol, owner, within, counts, held, length)
    rest = lens[owner] - within * STEP
    # the STEP bytes before each symbol, as two numbers
    previous = np.zeros((total, STEP), np.uint8)
    previous[1:] = cells[:-1]
    previous[at] = lead
    prior = np.ascontiguousarray(previous).view(">u8").astype(np.uint64).reshape(total, 2)
    before = np.where(within > 0, STEP, np.array(heads)[owner])
    begins = (cuts - sizes)[chosen] + np.array(heads)  # of the first symbol of each text, among all windows
    for l in range(STEP):
        enough = common >= length - l
        near = np.zeros(len(rank), bool)
        near[1:] |= enough[1:]
        near[:-1] |= enough[1:]
        interval = np.cumsum(~enough)
        pick = near & (before[rank] >= l) & (rest[rank] >= length - l)
        own, run = rank[pick], interval[pick]
        if not len(own):
            continue
        low = prior[own, 1] if l >= 8 else prior[own, 1] & np.uint64((1 << 8 * l) - 1)
        high = np.zeros(len(own), np.uint64) if l <= 8 else prior[own, 0] & np.uint64((1 << 8 * (l - 8)) - 1)
        by = np.lexsort((low, high, run))
        same = (run[by][1:] == run[by][:-1]) & (low[by][1:] == low[by][:-1]) & (high[by][1:] == high[by][:-1])
        twice = np.zeros(len(own), bool)
        twice[1:] |= same
        twice[:-1] |= same
        p = own[by[twice]]
        flags[begins[owner[p]] + within[p] * STEP - l] = True
    return np.split(flags, cuts[:-1])


def _common(rank, cells, symbol, owner, within, counts, held, most: int) -> np.ndarray:
    """The bytes that each suffix of rank shares with the one before it, up to `most`; within their texts."""
    out = np.zeros(len(rank), np.int64)
    live = np.arange(1, len(rank))
    a, b = rank[live - 1], rank[live]
    left = np.minimum(counts[owner[a]] - within[a], counts[owner[b]] - within[b])
    for step in range(-(-most // STEP)):
        both = step < left
        live, a, b, left = live[both], a[both], b[both], left[both]
        x, y = a + step, b + step
        same = symbol[x] == symbol[y]
        off = ~same
        if off.any():
            xo, yo = x[off], y[off]
            differ = cells[xo] != cells[yo]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), STEP)
            out[live[off]] += np.minimum(first, np.minimum(held[xo], held[yo]))
        out[live[same]] += held[x[same]]
        live, a, b, left = live[same], a[same], b[same], left[same]
        if not len(live):
            break
    return np.minimum(out, most)
