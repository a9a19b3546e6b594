"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

``suffix_array`` classifies suffixes, sorts the leftmost smaller (LMS) substrings by one
inducing pass, names them, sorts the suffixes of the string of names, and induces the rest from
them in a second pass. A pass goes over the buckets of first symbols once; all suffixes that a
bucket induces are placed in one step, so the number of steps follows the alphabet and the
longest run of one symbol, and the work is linear. Names that repeat are told apart by sorting
pairs of ranks at doubling distances, as their alphabet is too large for a step per bucket.
"""

from __future__ import annotations

import numpy as np


def _classes(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last suffix is not."""
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(len(text), bool)
    if len(differs):
        rising = text[differs] < text[differs + 1]
        # Every place takes the sense of the next change at or after it.
        lengths = np.diff(np.append(-1, differs))
        smaller[: differs[-1] + 1] = np.repeat(rising, lengths)
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes induced from the LMS places ``marks``, given in their order.

    Larger suffixes are placed from the front, each by the suffix after it, and then smaller
    ones from the back.
    """
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    larger_counts = np.bincount(text[~smaller], minlength=size)
    order = np.full(n, -1, np.int64)
    marked = marks[np.argsort(text[marks], kind="stable")]
    mark_ends = np.cumsum(np.bincount(text[marks], minlength=size))
    mark_heads = np.append(0, mark_ends[:-1])
    front = heads.copy()

    def place_larger(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        symbols = text[before]
        sort = np.argsort(symbols, kind="stable")
        before, symbols = before[sort], symbols[sort]
        kinds, first, many = np.unique(symbols, return_index=True, return_counts=True)
        offset = np.arange(len(before)) - np.repeat(first, many)
        order[np.repeat(front[kinds], many) + offset] = before
        front[kinds] += many

    # The last suffix is larger than the empty one, which comes before everything.
    order[front[text[n - 1]]] = n - 1
    front[text[n - 1]] += 1
    for c in np.flatnonzero(counts).tolist():
        done, last = heads[c], heads[c] + larger_counts[c]
        while done < last:
            upto = front[c]
            if upto == done:
                break
            place_larger(order[done:upto])
            done = upto
        if mark_heads[c] < mark_ends[c]:
            place_larger(marked[mark_heads[c] : mark_ends[c]])

    back = ends.copy()

    def place_smaller(found: np.ndarray) -> None:
        """``found`` in descending order."""
        before = found[found > 0] - 1
        before = before[smaller[before]]
        if not len(before):
            return
        symbols = text[before]
        sort = np.argsort(symbols, kind="stable")
        before, symbols = before[sort], symbols[sort]
        kinds, first, many = np.unique(symbols, return_index=True, return_counts=True)
        offset = np.arange(len(before)) - np.repeat(first, many)
        order[np.repeat(back[kinds], many) - 1 - offset] = before
        back[kinds] -= many

    for c in np.flatnonzero(counts)[::-1].tolist():
        done, first = ends[c], heads[c] + larger_counts[c]
        while done > first:
            downto = back[c]
            if downto == done:
                break
            place_smaller(order[downto:done][::-1])
            done = downto
        place_smaller(order[heads[c] : heads[c] + larger_counts[c]][::-1])
    return order


def _named(text: np.ndarray, marks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; ``order`` has the marks sorted by substring."""
    # A substring ends with the first symbol of the next one; the last ends with the text.
    ends = np.append(marks[1:], len(text) - 1)
    where = np.searchsorted(marks, order)
    lengths = ends[where] - order + 1
    a, b = order[:-1], order[1:]
    new = lengths[:-1] != lengths[1:]
    active = np.flatnonzero(~new)
    depth = 0
    while len(active):
        differs = text[a[active] + depth] != text[b[active] + depth]
        new[active[differs]] = True
        active = active[~differs]
        depth += 1
        active = active[lengths[active] > depth]
    # The last substring is cut off by the end of the text and stands for itself.
    last = np.flatnonzero(order == marks[-1])[0]
    if last > 0:
        new[last - 1] = True
    if last < len(new):
        new[last] = True
    names = np.empty(len(marks), np.int64)
    names[where] = np.append(0, np.cumsum(new))
    return names


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over a large alphabet."""
    n = len(names)
    rank, step = names, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
        if fresh[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if step >= n:
            return order


def suffix_array(text: np.ndarray, size: int = 257) -> np.ndarray:
    """Places of all suffixes of ``text`` (integers below ``size``) in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller = _classes(text)
    marks = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(marks) > 1:
        rough = _induce(text, smaller, marks, size)
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        names = _named(text, marks, rough[is_mark[rough]])
        if names.max() == len(marks) - 1:
            by_name = np.argsort(names)
        else:
            by_name = _by_doubling(names)
        marks = marks[by_name]
    return _induce(text, smaller, marks, size)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for every place, how far it agrees with the place before it
    in ``order``, up to ``most``; in text order. The first of ``order`` has 0.

    ``order`` may be part of a suffix array. All places are compared at once, eight symbols a
    step; those that differ leave.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    places = np.flatnonzero(before >= 0)
    data = np.zeros(n + most + 16, np.uint8)
    data[:n] = (text - 1).astype(np.uint8) if text.dtype != np.uint8 else text
    ended = np.ones(n + most + 16, bool)
    ended[:n] = text == 0
    # Eight bytes from every place, read at once.
    words = np.zeros(n + most + 8, np.uint64)
    for k in range(8):
        words |= data[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    next_end = np.full(n + 1, n, np.int64)
    stops = np.flatnonzero(ended[:n])
    if len(stops):
        at = np.searchsorted(stops, np.arange(n + 1))
        next_end = np.append(stops, n)[np.minimum(at, len(stops))]
    prefix = np.zeros(n, np.int64)
    active, depth = places, 0
    while len(active) and depth < most:
        x = words[active + depth] ^ words[before[active] + depth]
        low = x & (~x + np.uint64(1))  # the lowest bit that differs
        same = np.full(len(active), 8, np.int64)
        differs = x != 0
        same[differs] = np.log2(low[differs].astype(np.float64)).astype(np.int64) // 8
        prefix[active] += same
        active = active[~differs]
        depth += 8
    room = np.minimum(next_end[places] - places, next_end[before[places]] - before[places])
    prefix[places] = np.minimum(np.minimum(prefix[places], room), most)
    return prefix
