"""Kneser-Ney counts and probabilities over hashed words or symbols, in sorted arrays."""

from __future__ import annotations

import numpy as np


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts."""
    return discounts_of([int(np.count_nonzero(counts == i)) for i in range(1, 5)])


def discounts_of(counts_of_counts: list[int]) -> np.ndarray:
    """The same from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n = [max(1, c) for c in counts_of_counts]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *(float(np.clip(d, 0.05, i - 0.05)) for i, d in enumerate(raw, 1))])


def discounted(counts: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(count minus discount, discount) of each count, by the discounts of ``table`` (else those of the counts themselves)."""
    d = (discounts(counts) if table is None else table)[np.minimum(counts, 3).astype(np.int64)]
    return counts - d, d


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    """values[i] where keys[i] == wanted in the sorted keys, else the default."""
    if not len(keys):
        return np.full(len(wanted), default, dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class SymbolModel:
    """Modified Kneser-Ney model of one language over small symbols, for n-grams coded as base-2**bits numbers.

    ``codes`` is sorted; ``log_p`` holds log P(last symbol | those before) of every counted n-gram.
    An n-gram that was not counted backs off order by order.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, bits: int):
        self.order, self.bits = order, bits
        order_by = np.argsort(codes)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        tables = [(codes[order_by].astype(np.int64), counts[order_by].astype(np.float64))]
        for level in range(order - 1, 0, -1):  # continuation counts: distinct symbols seen before
            suffix = tables[-1][0] & ((1 << (bits * level)) - 1)
            keys, many = np.unique(suffix, return_counts=True)
            tables.append((keys, many.astype(np.float64)))
        below = np.full(1, 1.0 / (1 << bits))
        for level, (keys, many) in enumerate(reversed(tables), 1):
            left, gone = discounted(many)
            contexts, where = np.unique(keys >> bits, return_inverse=True)
            total = np.bincount(where, many)
            spare = np.bincount(where, gone) / total
            lower = below[np.searchsorted(self.levels[-1][0], keys & ((1 << (bits * (level - 1))) - 1))] if level > 1 else below[0]
            below = left / total[where] + spare[where] * lower
            self.levels.append((keys, np.log(below), contexts, np.log(spare)))

    def log_prob(self, wanted: np.ndarray) -> np.ndarray:
        """log P of n-grams, backing off where one was not counted."""
        out = np.zeros(len(wanted))
        open_ = np.arange(len(wanted))
        for level in range(self.order, 0, -1):
            keys, log_p, contexts, spare = self.levels[level - 1]
            codes = wanted[open_] & ((1 << (self.bits * level)) - 1)
            value = lookup(keys, log_p, codes, np.nan)
            seen = ~np.isnan(value)
            out[open_[seen]] += value[seen]
            open_, codes = open_[~seen], codes[~seen]
            if not len(open_):
                return out
            out[open_] += lookup(contexts, spare, codes >> self.bits, 0.0)
        out[open_] += -self.bits * np.log(2)
        return out


class SharedOrders:
    """What all pieces of a class model share: the orders up to ``shared`` + 1, counted over all n-grams, and the discounts of those above.

    ``keys`` are the sorted n-grams of order ``shared`` + 1, ``counts`` their counts in class 0 and 1 (two
    columns), ``many`` the distinct n-grams of the top order that end in them.  ``tables`` maps each order above to its
    discounts in class 0 and 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, many: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], bits: int, shared: int):
        self.bits, self.shared, self.tables = bits, shared, tables
        self.below = SymbolModel(keys, many.astype(np.float64), shared + 1, bits)
        self.level = [_class_level(keys, counts[:, c], bits, discounts(counts[:, c])) for c in (0, 1)]


def _class_level(keys: np.ndarray, n: np.ndarray, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, discounted shares, contexts, spare shares) of one order in one class."""
    contexts, head = np.unique(keys >> bits, return_inverse=True)
    left, gone = discounted(n, table)
    total = np.bincount(head, n)
    spare = np.where(total > 0, np.bincount(head, gone) / np.maximum(total, 1), 1.0)
    return keys, left / np.maximum(total[head], 1), contexts, spare


class ClassModel:
    """One piece of two class-conditional Kneser-Ney models over symbols with shared backoff counts.

    The orders above ``shared`` are counted per class; below them both classes back off to one
    modified Kneser-Ney model of all texts, so an expression that is rare in a class says little.
    A piece holds all n-grams of some middles (the symbols without the first and the last): the counts
    and contexts of the two upper orders are whole in it, and the lower orders come from ``low``.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, low: SharedOrders):
        """codes: sorted n-grams; counts: their counts in class 0 and 1 (two columns)."""
        self.order, self.bits, self.shared, self.below = order, low.bits, low.shared, low.below
        self.levels: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = [[low.level[0]], [low.level[1]]]
        for level in range(self.shared + 2, order + 1):
            keys, where = np.unique(codes & self.mask(level), return_inverse=True)
            for c in (0, 1):
                self.levels[c].append(_class_level(keys, np.bincount(where, counts[:, c], len(keys)), self.bits, low.tables[level][c]))
        self.codes = codes
        self.ratios = self._ratio(codes).astype(np.float32)

    def mask(self, level: int) -> int:
        return (1 << (self.bits * level)) - 1

    def _ratio(self, codes: np.ndarray) -> np.ndarray:
        keys, log_p, *_ = self.below.levels[self.shared - 1]
        base = np.exp(lookup(keys, log_p, codes & self.mask(self.shared), -2.0 * self.bits * np.log(2)))
        logs = []
        for c in (0, 1):
            p = base
            for level, (keys, high, contexts, spare) in enumerate(self.levels[c], self.shared + 1):
                part = codes & self.mask(level)
                p = lookup(keys, high, part, 0.0) + lookup(contexts, spare, part >> self.bits, 1.0) * p
            logs.append(np.log(p))
        return logs[1] - logs[0]

    def log_ratio(self, codes: np.ndarray) -> np.ndarray:
        """log P_1(last symbol | those before) - log P_0(the same), for n-grams counted or not."""
        out = lookup(self.codes, self.ratios, codes, np.float32(np.nan))
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            some, where = np.unique(codes[new], return_inverse=True)
            out[new] = self._ratio(some)[where]
        return out
