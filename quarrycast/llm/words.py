"""Words as the text operators see them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text, in order."""
    return WORD.findall(text.lower()) if text else []


class Shingler:
    """Sets of word n-grams as sorted unique 64-bit hashes; keeps the hashes of up to `keep` words."""

    def __init__(self, n: int, keep: int = 200_000):
        self.n, self.keep, self.seen = n, keep, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        if len(tokens) < self.n:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > self.keep:
            seen.clear()
        h = np.empty(len(tokens), np.uint64)
        for i, w in enumerate(tokens):
            x = seen.get(w)
            if x is None:
                x = seen[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        out = np.zeros(len(tokens) - self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
        return np.unique(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to each element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
