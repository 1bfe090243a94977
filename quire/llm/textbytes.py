"""Vectorised words and window fingerprints over UTF-8 bytes.

Fingerprints are polynomial hashes modulo 2**64 over byte values that were replaced by random 64-bit
numbers, so that the fingerprint of any window is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the weak low bits of a polynomial hash over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """One hash function; its tables of powers grow with the longest input that it has seen."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, 1 << 16)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                factors = np.full(n, b, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverses[start])


FIRST = Fingerprints(0x5851F42D4C957F2D, 11)
SECOND = Fingerprints(0xD1342543DE82EF95, 12)

#: A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Letters, digits and whatever is not ASCII; bytes of longer characters are all above 0x7F.
_ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b > 127 for b in range(256)])
#: Lower case, and a space for each byte that is in no word.
ALNUM_OR_SPACE = bytes(LOWER[b] if _ALNUM[b] else 32 for b in range(256))


def spans(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes together; a larger row stands alone."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    return spans([len(t) for t in texts], limit)


def words(texts: list[bytes], alnum: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and end of each word in them, and the first word of each text
    (with the count of all words at the end). Words are runs of letters, digits and non-ASCII if alnum, else
    of whatever is no white space."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    inside = (_ALNUM if alnum else ~_SPACE)[data].astype(np.int8)
    edges = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    return data, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted fingerprints; of fewer words, the whole sequence."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        data, starts, ends, first = words(texts[a:b], alnum=False)
        keep = ~_SPACE[data]
        keep[ends] = True  # one separator after each word, whatever stood there
        clean = np.where(_SPACE[data], np.uint8(32), data)[keep]
        at = np.cumsum(keep) - keep
        prefix, starts, ends = FIRST.prefix(clean), at[starts], at[ends]
        full = FIRST.windows(prefix, starts[: max(0, len(starts) - k + 1)], ends[k - 1 :])
        for i in range(b - a):
            f, n = first[i], first[i + 1] - first[i]
            if n >= k:
                out.append(np.unique(full[f : f + n - k + 1]))
            elif n:
                out.append(FIRST.windows(prefix, starts[f : f + 1], ends[f + n - 1 : f + n]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
