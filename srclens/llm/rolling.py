"""Rolling hashes and window minima over byte buffers, in numpy.

Everything here works on flat buffers that hold many texts end to end, so the
per-text cost is a few vector operations however short the texts are.  A text
longer than ``PIECE`` bytes is cut into overlapping pieces by the callers, so
memory follows the piece size and not the longest text.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time.
PIECE = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _table(7)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; grown by doubling and kept."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        inverse, k = pow(base, -1, 1 << 64), 1
        while k < size:
            up[k : 2 * k] = up[:k] * np.uint64(pow(base, k, 1 << 64))
            down[k : 2 * k] = down[:k] * np.uint64(pow(inverse, k, 1 << 64))
            k *= 2
        _powers[base] = up, down
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i; n + 1 long."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hashes of the spans [start, end); equal contents have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start] + (end - start).astype(np.uint64))


def windows(values: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all runs of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums = prefix(values, base)
    return mix((sums[k:] - sums[:-k]) * powers(len(sums), base)[1][: len(sums) - k])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i:i+w]) for each i."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    if w == 1:
        return h
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, _MASK, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    black = np.zeros(len(data) + 2, np.int8)
    black[1:-1] = ~WHITE[data]
    edge = np.diff(black)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes and offsets (rows + 1 of them); nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def blocks(offsets: np.ndarray, limit: int = PIECE):
    """Cuts rows into consecutive (first, last) ranges of at most ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last
