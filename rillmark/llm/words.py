"""Words of a text and their 64-bit hashes, for whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    """Unbroken runs of letters or digits in lower case, as UTF-8."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


class WordHashes(dict):
    """Hash of each word seen; a task's vocabulary is dropped when it exceeds ``most`` words."""

    def __init__(self, most: int = 2_000_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint64)
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, order included; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : i + n]) + np.uint64(i + 1)
    return out
