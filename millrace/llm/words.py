"""Words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

from .common import SegmentHash, mix64, segments

#: Bytes that belong to words: ASCII letters and digits, and all bytes beyond ASCII.
MEMBER = np.zeros(256, bool)
MEMBER[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True
MEMBER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, and n + 1 offsets of texts in them.

    A word is a run of ASCII letters, digits and bytes beyond ASCII, in lower case; it
    ends with its text.
    """
    data = LOWER[data]
    starts, ends = segments(data, MEMBER)
    inner = offsets[1:-1]
    # a run over a boundary of texts is cut there
    at = np.searchsorted(starts, inner, side="right") - 1
    cut = np.unique(inner[(at >= 0) & (starts[np.maximum(at, 0)] < inner) & (ends[np.maximum(at, 0)] > inner)]) if len(starts) else inner[:0]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    hashes = SegmentHash(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


class RunHash:
    """Hashes of runs of words, from prefix sums over the words' hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((words | np.uint64(1)) * SegmentHash._table("up", n + 1)[:n], out=self.sums[1:])
        self.down = SegmentHash._table("down", n + 1)

    def __call__(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x
