"""Vectorised rolling hashes over a batch of texts (numpy, 64 bits, wrap-around arithmetic)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        filled = 1
        step = np.uint64(base)
        while filled < size:  # doubling: p[k:2k] = p[:k] * base**k
            k = min(filled, size - filled)
            have[filled : filled + k] = have[:k] * step
            with np.errstate(over="ignore"):
                step = step * step
            filled += k
        _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Prefix hashes of an array of codes; hashes of any [a, b) are O(1)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.n = n
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers("p", _BASE, n), out=self.prefix[1:], dtype=np.uint64)
        self.inverse = _powers("i", _INVERSE, n + 1)

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.inverse[a] + (b - a).astype(np.uint64))

    def grams(self, q: int) -> np.ndarray:
        """Hash of the q codes from each position on."""
        if self.n < q:
            return np.zeros(0, np.uint64)
        m = self.n - q + 1
        return mix((self.prefix[q:] - self.prefix[:m]) * self.inverse[:m] + np.uint64(q))
