"""Two-stage suffix sorting of many short byte strings at once, with numpy.

A suffix smaller than its successor (type S) is sorted directly; every other one
(type L) is induced from its already placed successor by scanning the buckets of
first bytes from small to large.  Then neighbours in the order are compared.
"""

from __future__ import annotations

import numpy as np


def _keys(padded: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> list[np.ndarray]:
    """The first ``depth`` bytes of suffixes as big-endian 64-bit numbers, zero beyond the end of the string."""
    out = []
    for step in range(0, depth, 8):
        word = np.zeros(len(at), dtype=np.uint64)
        for i in range(step, step + 8):
            byte = padded[np.minimum(at + i, len(padded) - 1)].astype(np.uint64) if i < depth else np.uint64(0)
            if i < depth:
                byte[at + i >= end] = 0
            word = (word << np.uint64(8)) | byte
        out.append(word)
    return out


def _direct(padded: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes; only ties go on to the next eight bytes."""
    order = np.arange(len(at))
    group = np.zeros(len(at), dtype=np.int64)
    live = np.arange(len(at))
    for step in range(0, depth, 8):
        key = _keys(padded, at[order[live]] + step, end[order[live]], min(8, depth - step))[0]
        place = np.lexsort((key, group[live]))
        order[live] = order[live][place]
        key, g = key[place], group[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
    return at[order]


def sort_starts(text: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at begin[i] .. begin[i] + count[i] - 1 of the strings text[begin[i]:end[i]], sorted to ``depth`` bytes.

    ``text`` is the strings' concatenation.  Only the suffixes asked for, and those that they are induced from, take part.
    """
    n = len(text)
    symbols = np.zeros(n + len(begin), dtype=np.int16)  # 0 ends each string
    shift = np.arange(len(begin))
    where = np.arange(n) + np.repeat(shift, end - begin)
    symbols[where] = text.astype(np.int16) + 1
    b, e = begin + shift, end + shift
    raw = np.zeros(len(symbols), dtype=np.uint8)
    raw[where] = text
    limit = np.repeat(e, e - b + 1)
    step = np.zeros(len(symbols), dtype=np.int8)
    step[:-1] = np.sign(symbols[1:] - symbols[:-1])
    step[e] = 1  # a terminator is smallest: type S
    decided = np.where(step != 0, np.arange(len(step)), len(step))
    after = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = step[np.minimum(after, len(step) - 1)] > 0
    stop = np.where(smaller, np.arange(len(step)), len(step))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    needed = np.zeros(len(step) + 1, dtype=np.int32)
    np.add.at(needed, b, 1)
    np.add.at(needed, np.minimum(stop[b + count - 1], e) + 1, -1)
    needed = np.cumsum(needed[:-1]) > 0
    wanted = np.zeros(len(step) + 1, dtype=np.int32)
    np.add.at(wanted, b, 1)
    np.add.at(wanted, b + count, -1)
    wanted = np.cumsum(wanted[:-1]) > 0

    own = np.flatnonzero(needed & smaller & (symbols > 0))
    direct = _direct(raw, own, limit[own], depth + 8)
    first = symbols[direct]
    edges = np.searchsorted(first, np.arange(258))
    queue: list[list[np.ndarray]] = [[] for _ in range(257)]
    done: list[np.ndarray] = []

    def induce(scanned: np.ndarray, here: int) -> np.ndarray:
        """Append the L-type predecessors of scanned suffixes to their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        c = symbols[before]
        same = before[c == here]
        other, c = before[c > here], c[c > here]
        if len(other):
            order = np.argsort(c, kind="stable")
            other, c = other[order], c[order]
            cut = np.flatnonzero(np.diff(c)) + 1
            for part in np.split(other, cut):
                queue[symbols[part[0]]].append(part)
        return same

    induce(e[needed[e]], 0)
    for c in range(1, 257):
        front = np.concatenate(queue[c]) if queue[c] else np.empty(0, dtype=np.int64)
        while len(front):
            done.append(front)
            front = induce(front, c)
        own = direct[edges[c] : edges[c + 1]]
        if len(own):
            done.append(own)
            induce(own, c)
    order = np.concatenate(done) if done else np.empty(0, dtype=np.int64)
    order = order[wanted[order]]
    return order - (np.searchsorted(b, order, side="right") - 1)


def least_owners(text: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts (positions in ``text``) in sorted order, and for each the smallest owner of a string that starts with its ``length`` bytes.

    Every start asked for must have ``length`` bytes left in its string.
    """
    order = sort_starts(text, begin, end, count, length)
    if not len(order):
        return order, owner[:0]
    keys = _keys(text, order, np.full(len(order), len(text)), length)
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for k in keys:  # common prefix of neighbours below ``length``
        new[1:] |= k[1:] != k[:-1]
    who = owner[np.searchsorted(begin, order, side="right") - 1]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(who, starts)
    return order, np.repeat(least, np.diff(np.append(starts, len(order))))


def repeats_before(text: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Starts (positions in ``text``) whose ``length`` bytes also start in a string of a smaller owner."""
    order, least = least_owners(text, begin, end, count, owner, length)
    who = owner[np.searchsorted(begin, order, side="right") - 1]
    return np.sort(order[who > least])
