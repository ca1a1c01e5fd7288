"""Word shingles as 64-bit hashes, for whole Arrow batches at a time.

Words are hashed over their UTF-8 bytes by differences of one running polynomial sum (a random value for each byte, powers
of an odd base, modulo 2^64), and shingles by mixing the hashes of k words. A text with fewer words than k, but one at
least, has its whole sequence as its only shingle. Null and wordless texts have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))
#: Bytes of text that are hashed at a time; a longer text goes alone.
CHUNK = 1 << 21
_powers: dict[str, np.ndarray] = {}

#: Words of the search operators: maximal runs without white space, or of letters, digits and all that isn't ASCII; A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get("up")
    if held is not None and len(held) >= n:
        return held, _powers["down"]
    size = max(n, CHUNK)
    up, down = np.full(size, _BASE), np.full(size, _UNDO)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if size <= CHUNK:
        _powers.update(up=up, down=down)
    return up, down


def word_hashes(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and their number at last), for texts that end at `ends` in `data`."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    apart = breaks[data]
    start = ~apart
    start[1:] &= apart[:-1]
    first = np.concatenate([[0], ends[:-1]])
    inside = first[first < len(data)]
    start[inside] = ~apart[inside]
    stop = ~apart
    stop[:-1] &= apart[1:]
    last = ends[ends > 0] - 1
    stop[last] = ~apart[last]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop)
    up, down = _power(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=running[1:])
    words = mix((running[end + 1] - running[begin]) * down[begin] + (end - begin + 1).astype(np.uint64))
    return words, np.concatenate([[0], np.searchsorted(begin, ends)]).astype(np.int64)


def byte_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of strings (not empty) that lie one after the other in `data`, as they are; `which` names one of two functions."""
    up, down = _power(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_OTHER if which else _BYTE)[data] * up[: len(data)], out=running[1:])
    return mix((running[begin + size] - running[begin]) * down[begin] + size.astype(np.uint64))


def texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, bytes, ends) of runs of texts of at most CHUNK bytes in all, or of one text; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], (offsets[i + 1 : j + 1] - offsets[i]).astype(np.int64)
        i = j


def shingle_runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of one array (also across texts)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for j in range(1, k):
        total += words[j : j + n] * _PLACE[j]
    return mix(total)


def whole(words: np.ndarray, k: int) -> np.ndarray:
    """The one shingle of a text of fewer than k words."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for j, w in enumerate(words):
            total = total + w * _PLACE[j]
        return mix(np.array([total + np.uint64(len(words)) * _PLACE[63]], np.uint64))


def shingles(column: pa.Array, k: int, breaks: np.ndarray = SPACE) -> Iterator[np.ndarray]:
    """For each text its shingles in order, with repeats."""
    for _, data, ends in texts(column):
        words, at = word_hashes(data, ends, breaks)
        runs = shingle_runs(words, k)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield runs[a : b - k + 1] if b - a >= k else whole(words[a:b], k) if b > a else runs[:0]
