"""Hash embeddings in numpy: for many or long texts."""

from __future__ import annotations

import numpy as np

from corpusflow.functions.vectors import HASH_DIMENSIONS


def buckets(low: str) -> np.ndarray:
    """The bucket of each word and each character 3-, 4- and 5-gram of a lowered text."""
    parts = [np.frombuffer(w.encode(), np.uint8) for w in low.split()]
    found = []
    for codes in parts:
        h = 37
        for b in codes.tolist():
            h = ((h ^ b) * 179) & 255
        found.append(h)
    whole = np.frombuffer(low.encode(), np.uint8).astype(np.int64)
    starts = np.flatnonzero((whole & 0xC0) != 0x80)
    ends = np.append(starts, len(whole))
    out = [np.array(found, np.int64)]
    for n in (3, 4, 5):
        if len(starts) < n:
            continue
        first, last = starts[: len(starts) - n + 1], ends[n:]
        h = np.full(len(first), 37)
        for k in range(int((last - first).max())):
            inside = first + k < last
            h[inside] = ((h[inside] ^ whole[first[inside] + k]) * 179) & 255
        out.append(h)
    return np.concatenate(out)


def hash_vector(text: str) -> np.ndarray:
    counts = np.bincount(buckets(text.lower()), minlength=HASH_DIMENSIONS).astype(np.float64)
    length = np.linalg.norm(counts)
    return (counts / length if length else counts).astype(np.float32)
