"""Word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

WORDS = 5
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Odd bases modulo 2**64; the second is for hashes that must not depend on the first.
_BASE = 0xD1342543DE82EF95
OTHER_BASE = 0x9FB21C651E98DF25


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        z = x + _G
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Hasher:
    """Hashes of substrings of a byte array, by differences of prefix sums."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.table = mix(np.arange(256, dtype=np.uint64) + np.uint64(base if base != _BASE else 0))
        self.up, self.down = powers(self.base, 1), powers(self.inverse, 1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self.up):
            self.up, self.down = powers(self.base, 2 * n + 1), powers(self.inverse, 2 * n + 1)
        out = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.down[start])


def bags(texts: list[str | None], hasher: Hasher, words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct shingle hashes, sorted, and how often each occurs.

    Words are runs of anything but ASCII white space; a text of fewer words than a
    shingle has all of them as its one shingle; without words it has none.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    hashes = hasher.between(hasher.prefix(data), start, end)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(start, bounds)
    out = []
    step = powers(_BASE, words)
    with np.errstate(over="ignore"):
        run = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            run += hashes[k : k + len(run)] * step[k]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= words:
                s = run[a : b - words + 1]
            else:
                s = np.array([(hashes[a:b] * step[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64) if b > a else run[:0]
            out.append(np.unique(mix(s), return_counts=True))
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags; two empty bags are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)
