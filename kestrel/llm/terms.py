"""64-bit hashes of words and of word shingles, computed in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a worker's cache at most.
CACHE = 400_000

ODD_1, ODD_2, ODD_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


_hashes = _Hashes()


def forget() -> None:
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + ODD_1  # a copy, changed in place
    x ^= x >> np.uint64(30)
    x *= ODD_2
    x ^= x >> np.uint64(27)
    x *= ODD_3
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(hashed: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash for every run of ``size`` words; of fewer words, one for all of them."""
    n = len(hashed)
    if not n:
        return hashed
    size = min(size, n)
    out = mix(hashed[:n - size + 1])
    for i in range(1, size):
        out = mix(out ^ hashed[i:n - size + 1 + i])
    return out
