"""Word shingles as hashes, for the near-duplicate and overlap operators.

Words are the runs of a-z and 0-9 of the lower-cased text; a shingle is `width` consecutive words. A
word's hash is the xxh3 of its letters, a shingle's a fixed mixture of its words' hashes in order, so
a batch of texts is hashed by a few passes over one array.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9]+")
#: Words whose hashes a worker remembers; the memo is emptied when full, which changes no result.
MEMO_WORDS = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = WORD.findall(text.lower())
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finalizer of a well-known public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int = 3) -> np.ndarray:
    """The hash of each run of `width` words, in order; empty for shorter texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, width):
        h = mix(h) + words[i : n + i]
    return mix(h)
