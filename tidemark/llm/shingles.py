"""Hashes of word shingles: XXH64, seed 42, of the words joined by single blanks."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash

SEED = 42
#: Shingles whose bits are counted in one step, which bounds memory for very long texts.
STEP = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words of the text with A-Z in lower case: runs of anything but blank and \\t \\n \\v \\f \\r."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all shingles of ``size`` words, repeats included; of fewer words: of them all; of none: nothing."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    ends = starts[size:]  # one past the blank after the shingle's last word
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends)], np.uint64)  # noqa: B905


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        part = hashes[at : at + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])
