"""Words, and 64-bit hashes of runs of words, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A maximal run of letters or digits of any script; `_` is neither.
WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    """The words of text, lower-cased; none for null."""
    if not text:
        return []
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bound that keeps a worker's memory flat."""

    def __init__(self, most: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(ws), dtype=np.uint64)
        for i, w in enumerate(ws):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words, from the hashes of the words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(count, dtype=np.uint64)
        for k in range(n):
            acc = (acc ^ hashes[k : k + count]) * _MIX[1]
            acc ^= acc >> np.uint64(31)
        acc *= _MIX[2]
        acc ^= acc >> np.uint64(29)
    return acc
