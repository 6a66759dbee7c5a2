"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
#: Odd multipliers of the polynomial over word hashes and of the final mixing.
P, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of anything but ASCII white space, with A-Z lower-cased.

    Hashing a word takes less than looking it up: most words of a large corpus are rare.
    """
    found = text.encode().lower().split() if text else ()
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, in order."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    n = len(hashes) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = mixed * P + hashes[k : k + n]
    mixed ^= mixed >> np.uint64(30)
    mixed *= MIX
    mixed ^= mixed >> np.uint64(27)
    return mixed


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles, ascending; a shorter text is one shingle as a whole, an empty one has none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return np.empty(0, np.uint64)
    found = np.sort(grams(hashes, min(size, len(hashes))))
    first = np.empty(len(found), bool)
    first[0] = True
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return found[first]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
