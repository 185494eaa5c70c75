"""Words and word shingles of texts as 64-bit hashes, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import worker_cache

ODD = np.uint64(0x9E3779B97F4A7C15)
SHORT = np.uint64(0xD6E8FEB86659FD93)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word; hashing one again takes less time than looking it up."""
    worker_cache("word_hashes")  # nothing is kept, but what another operator learned makes room
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; fewer words are one run of their own kind."""
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        if n < width:
            out = np.full(1, SHORT * np.uint64(n), np.uint64)
            for h in hashes:
                out = mixed(out * ODD + h)
            return out
        out = hashes[: n - width + 1].copy()
        for i in range(1, width):
            out *= ODD
            out += hashes[i : n - width + 1 + i]
            out ^= out >> np.uint64(29)
        return mixed(out)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(windows(word_hashes(lower_words(text)), width))
