"""64-bit SimHash fingerprints of word shingles."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

#: Hashes summed at a time, so that a very long text needs no more memory than this many.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), BLOCK):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[i : i + BLOCK], repeat(seed)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
        for j in range(0, len(bits), 255):  # sums of 255 ones fit a byte
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")
