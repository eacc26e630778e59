"""Numpy helpers for ragged rows kept as one flat array with offsets."""

from __future__ import annotations

import numpy as np


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s + n]`` for every (s, n)."""
    total = int(lengths.sum())
    if total == 0:
        return flat[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return flat[index]


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of every row, and the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
