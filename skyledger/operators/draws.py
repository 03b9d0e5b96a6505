"""The draws of splits.hash_uniform for many replicates at once, in numpy: same bits, a few operations per block of draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))
# Fixed value: draws made together, so that the words of a block stay in the cache.
DRAWS = 16_384


def _first_word(blocks: Sequence[Sequence]) -> np.ndarray:
    """The first word of the MD5 of messages whose 32-bit words broadcast against each other."""
    a, b, c, d = (np.full((1, 1), x, np.uint32) for x in _START)
    for words in blocks:
        a0, b0, c0, d0 = a, b, c, d
        for i in range(64):
            kind = i // 16
            if kind == 0:
                f = d ^ (b & (c ^ d))
            elif kind == 1:
                f = c ^ (d & (b ^ c))
            elif kind == 2:
                f = b ^ c ^ d
            else:
                f = c ^ (b | ~d)
            by, first = _PLACES[kind]
            f = f + (a + (words[(by * i + first) % 16] + np.uint32(_SINES[i])))
            s = _SHIFTS[kind][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
        a, b, c, d = a + a0, b + b0, c + c0, d + d0
    return a


def _words(texts: Sequence[bytes], start: int, length: int) -> np.ndarray:
    """Texts of one length as little-endian words of a message of `length` bytes, from byte `start` on, zero elsewhere."""
    size = len(texts[0])
    out = np.zeros((len(texts), length), np.uint8)
    out[:, start:start + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), size)
    return out.view("<u4").astype(np.uint32)


def _hashed(prefixes: Sequence[bytes], numbers: Sequence[bytes]) -> np.ndarray:
    """The first four bytes of the MD5 of every prefix followed by every number; each list has texts of one length."""
    head, tail = len(prefixes[0]), len(numbers[0])
    length = (head + tail + 8) // 64 * 64 + 64
    end = np.zeros(length, np.uint8)
    end[head + tail] = 0x80
    end[-8:] = np.frombuffer(((head + tail) * 8).to_bytes(8, "little"), np.uint8)
    left, right, fixed = _words(prefixes, 0, length), _words(numbers, head, length), end.view("<u4").astype(np.uint32)
    words = []
    for j in range(length // 4):
        # a word of one part only stays one column or one row
        word = left[:, j:j + 1] + fixed[j] if j * 4 < head else np.full((1, 1), fixed[j], np.uint32)
        words.append(word + right[:, j][None, :] if j * 4 < head + tail and j * 4 + 4 > head else word)
    return np.broadcast_to(_first_word([words[j:j + 16] for j in range(0, len(words), 16)]).byteswap(), (len(prefixes), len(numbers)))


@cache
def _poisson_marks(mean: float, most: int) -> tuple[int, ...]:
    """The least 32-bit numbers at which metrics.poisson_draw gives one more."""
    term, upto, marks = math.exp(-mean), 0.0, []
    for k in range(most):
        upto += term
        marks.append(math.ceil(upto * 2**32))
        term *= mean / (k + 1)
    return tuple(m for m in marks if m < 2**32)


def poisson_weights(ids: Sequence[str | None], seed: int, replicates: int, mean: float = 1.0, most: int = 16) -> np.ndarray:
    """poisson_draw(hash_uniform(id, seed, replicate)) as a matrix of ids and replicates. A null id is left out of the text, as by concat_ws."""
    out = np.empty((len(ids), replicates), np.uint8)
    groups: dict[int, list[int]] = {}
    prefixes = [(f"{seed}|" if x is None else f"{x}|{seed}|").encode() for x in ids]
    for i, p in enumerate(prefixes):
        groups.setdefault(len(p), []).append(i)
    marks = _poisson_marks(mean, most)
    first = 0
    while first < replicates:
        last = min(replicates, max(10, first * 10))
        numbers = [str(r).encode() for r in range(first, last)]
        for members in groups.values():
            step = max(1, DRAWS // len(numbers))
            for at in range(0, len(members), step):
                some = members[at:at + step]
                drawn = _hashed([prefixes[i] for i in some], numbers)
                weight = np.zeros(drawn.shape, np.uint8)
                for m in marks:
                    weight += drawn >= np.uint32(m)
                out[some, first:last] = weight
        first = last
    return out
