"""Words of whole Arrow columns as exact integer codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shingles import SPACE


def spans(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, its number of bytes, first word of each text and their number at last), for texts that end at `ends`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    inside = ~breaks[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = np.concatenate([[0], ends[:-1]])
    first, last = first[first < len(data)], ends[ends > 0] - 1
    begin[first], end[last] = inside[first], inside[last]
    at, to = np.flatnonzero(begin), np.flatnonzero(end)
    return at, to - at + 1, np.concatenate([[0], np.searchsorted(at, ends)]).astype(np.int64)


def coded(data: np.ndarray, size: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words as bytes): equal codes for equal words. `data` has the words and breaks, `size` is from spans."""
    kept = np.ascontiguousarray(data[~breaks[data]]) if len(data) else np.zeros(0, np.uint8)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
