"""Vectorised hashes of all byte windows of a buffer."""

from __future__ import annotations


def byte_table(seed: int):
    """256 random 64-bit values, one per byte."""
    import numpy as np
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


def window_hashes(codes, width: int):
    """64-bit hash of every ``width`` consecutive entries of ``codes`` (64-bit
    byte codes), built from hashes of doubling widths."""
    import numpy as np
    known, parts, have = codes, [], 1
    todo = width
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(29)

    def join(left, right, apart):
        n = min(len(left), len(right) - apart)
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = left[:n] * multiplier
        out += right[apart:apart + n]
        out ^= out >> shift
        return out

    while True:
        if todo & have:
            parts.append((have, known))
        if have * 2 > todo:
            break
        known = join(known, known, have)
        have *= 2
    size, total = parts[-1]
    for have, known in parts[-2::-1]:
        total = join(total, known, size)
        size += have
    return total * np.uint64(0xD6E8FEB86659FD93)
