"""Words of texts as 64-bit hashes, and hashes of runs of words, in numpy.

A word is a run of bytes without \\x20 and \\x09-\\x0D. Hashes of variable runs come from prefix sums: the numbers of
a run are weighted by powers of an odd factor modulo 2^64, and the difference of two prefix sums is shifted back.
"""

from __future__ import annotations

import numpy as np

SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
FACTOR = 0x9E3779B97F4A7C15
BACK = pow(FACTOR, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of murmur hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the factor and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", FACTOR), ("down", BACK)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Runs:
    """Hashes of any run [start, end) of a sequence of 64-bit numbers."""

    def __init__(self, numbers: np.ndarray):
        up, self.down = POWERS(len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + length)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, index of the first word of each text, and the number of words)."""
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    at = np.zeros(len(raws) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raws], out=at[1:])
    return Runs(BYTES[buf])(start, end), np.searchsorted(start, at)
