"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of each of a text's word shingles, one for a shorter text, none for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line, n = memoryview(b" ".join(words)), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(line, SEED)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    starts = np.cumsum(sizes) - sizes
    ends = starts[shingle - 1 :] + sizes[shingle - 1 :] - 1
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], "<u8")
