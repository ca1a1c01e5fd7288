"""Rolling hashes of all windows of a text's characters, and the anchors that two texts with a common window share."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(int(_BASE), -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(chars: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` characters in a row."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars) - 1, _BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _UNDO)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(chars.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return _mixed((total[size:] - total[:-size]) * down)


def anchors(text: str, run: int) -> np.ndarray:
    """Distinct hashes of half-windows: from each window of `run` characters the half-window with the smallest hash. Equal windows give equal anchors, and
    a text has about 4 for each `run` characters, a periodic one only a few."""
    half = max(1, run // 2)
    held = windows(characters(text), half)
    width = run - half + 1
    n = len(held) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    full = np.concatenate([held, np.full(-len(held) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.unique(np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]))


def share_window(a: str, b: str, run: int, known: set[str] = frozenset()) -> bool:
    """Whether a and b have `run` characters in a row in common that aren't known; exact, in time in proportion to both."""
    x, y = windows(characters(a), run), windows(characters(b), run)
    at, to = np.flatnonzero(np.isin(x, y)).tolist(), np.flatnonzero(np.isin(y, x)).tolist()
    theirs = {b[j : j + run] for j in to} - known
    return any(a[i : i + run] in theirs for i in at)
