"""The difference-cover suffix sort modulo 3, on numpy arrays.

Suffixes at positions 1 and 2 modulo 3 are sorted by their triples; the triples'
names make a shorter string that is sorted in the same way until the names
differ.  A suffix at 0 modulo 3 is then known by its first symbol and the rank
of the next suffix, and is counted into the others by two plain sorts: against
1 modulo 3 by (symbol, rank), against 2 modulo 3 by (symbol, symbol, rank).
"""

from __future__ import annotations

import numpy as np


def _bits(c: np.ndarray) -> int:
    return max(1, int(c.max()).bit_length())


def _order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """Order of the rows, and the sorted keys of 64 bits if they fit.

    Row numbers are packed below the key where both fit a word: sorting words is
    several times as fast as sorting their places.
    """
    own = max(1, (len(columns[0]) - 1).bit_length())
    bits = [_bits(c) for c in columns]
    while len(columns) > 2 and sum(bits) + own > 63:
        columns = [*columns[:-2], _names(columns[-2:])[0]]
        bits = [*bits[:-2], _bits(columns[-1])]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1]), None
    key = columns[0].astype(np.int64)
    for c, n in zip(columns[1:], bits[1:], strict=True):
        key <<= n
        key |= c
    if sum(bits) + own > 63:
        order = np.argsort(key)
        return order, key[order]
    key <<= own
    key |= np.arange(len(key))
    key.sort()
    return key & ((1 << own) - 1), key >> own


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The dense rank of each row from 1, and the number of ranks."""
    order, key = _order(columns)
    if key is None:
        new = np.zeros(len(order) - 1, bool)
        for c in columns:
            new |= np.diff(c[order]) != 0
    else:
        new = key[1:] != key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(new)])
    return rank, int(rank[order[-1]])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s (integers from 0) in the order of their suffixes; a suffix that ends is before what continues it."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64) + 1, np.zeros(3, np.int64)])
    ends = n % 3 == 1  # position n, if 1 modulo 3, ends the first part of the sample; its suffix is before all others
    zeros, ones, twos = (n + 2) // 3, (n + 1) // 3, n // 3
    part = lambda x, first, size: x[first::3][:size]
    both = lambda x, i, j, m, k: np.concatenate([part(x, i, m), part(x, j, k)])
    name, kinds = _names([both(s, 1 + k, 2 + k, ones + ends, twos) for k in range(3)])
    if kinds < len(name):
        order = suffix_array(name)
        name = np.empty(len(name), np.int64)
        name[order] = np.arange(1, len(name) + 1)
    rank = np.zeros(n + 4, np.int64)
    part(rank, 1, ones + ends)[:] = name[: ones + ends]
    part(rank, 2, twos)[:] = name[ones + ends :]

    def before(others: int, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each at 0 modulo 3 the number of others before it, for each of others the number at 0 before it, and the order of those at 0."""
        order, _ = _order(columns)
        is_zero = order < zeros
        own, rest = order[is_zero], order[~is_zero] - zeros
        a, b = np.empty(zeros, np.int64), np.empty(others, np.int64)
        seen = np.cumsum(is_zero)
        a[own] = np.flatnonzero(is_zero) - np.arange(zeros)
        b[rest] = seen[~is_zero]
        return a, b, own

    from_one, to_one, order = before(ones, [both(s, 0, 1, zeros, ones), both(rank, 1, 2, zeros, ones)])
    from_two, to_two, _ = before(twos, [both(s, 0, 2, zeros, twos), both(s, 1, 3, zeros, twos), both(rank, 2, 4, zeros, twos)])
    from_one += from_two
    from_one[order] += np.arange(zeros)
    out = np.empty(n, np.int64)
    out[from_one] = np.arange(0, n, 3)
    out[part(rank, 1, ones) - (1 + ends) + to_one] = np.arange(1, n, 3)
    out[part(rank, 2, twos) - (1 + ends) + to_two] = np.arange(2, n, 3)
    return out
