"""Runs (maximal periodic stretches) of the words of each document, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q, at least LEAST words and TIMES * q words long, that no neighbouring
word extends with that period. All of them are found for many documents at once:

1. Ranks by doubling: equal numbers for equal stretches of 1, 2, 4, 8... words of a document, in their order. Only stretches that are still equal to
   another go on to the next length. The last ranks are the suffix array; two positions' common extension to either side is read off
   the levels from the longest to the shortest, and so are the LCPs of neighbours in the suffix array.
2. Longest previous factors: suffixes are taken out of the list of ranks from the last position to the first; a suffix's neighbours at
   that time are the nearest ones that begin earlier. The blocks of the Lempel-Ziv parse follow from these.
3. Main's extensions: a run that crosses or touches a border between blocks has a period of at most a (TIMES - 1)th of the two blocks
   beside the last such border, so only these (border, period) pairs are extended to the left and right. Of equal stretches the
   smallest period counts.
4. A run strictly inside a block is a copy of one inside the block's earlier occurrence: such runs are copied from the bucket of runs by
   start, block by block.

Words are maximal runs without white space (space and 09-0D), compared exactly. Nulls: a null text has no words; a null id is kept. Empty texts
have no runs. Repeated rows are treated one by one. Very long texts are treated whole, one at a time, in memory in
proportion to the number of words times the doubling steps. Other columns than key and text are dropped.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .shingles import texts
from .words import coded, spans

LEAST, TIMES = 6, 4
RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Index:
    """Ranks of the stretches of 1, 2, 4... words of documents that begin at `at` (and end at its last), within each document."""

    def __init__(self, codes: np.ndarray, at: np.ndarray) -> None:
        n = self.n = len(codes)
        self.at = at
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        self.start, end = at[doc], at[doc + 1]
        key = doc * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        opens = np.ones(n, bool)
        opens[1:] = ordered[1:] != ordered[:-1]
        group = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        name = np.full(n + 1, -1, np.int64)
        name[order] = group
        self.levels = [name]
        open_ = self._shared(order, opens)
        width = 1
        while len(open_):
            name = self.levels[-1]
            after = open_ + width
            base = name[open_]
            second = np.where(after < end[open_], name[np.minimum(after, n)], -1)
            by = np.argsort(base * (n + 1) + second + 1, kind="stable")
            open_, base, second = open_[by], base[by], second[by]
            starts, opens = np.ones(len(by), bool), np.ones(len(by), bool)
            starts[1:] = base[1:] != base[:-1]
            opens[1:] = starts[1:] | (second[1:] != second[:-1])
            here = np.arange(len(by))
            name = name.copy()
            name[open_] = base + np.maximum.accumulate(np.where(opens, here, 0)) - np.maximum.accumulate(np.where(starts, here, 0))
            self.levels.append(name)
            open_ = self._shared(open_, opens)
            width *= 2
        self.rank = self.levels[-1][:n]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    @staticmethod
    def _shared(order: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """The members of groups of two and more; a group begins where `opens` is set."""
        alone = opens.copy()
        alone[:-1] &= opens[1:]
        return order[~alone]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on."""
        done = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            a, b = np.minimum(x + done, self.n), np.minimum(y + done, self.n)
            done += ((level[a] == level[b]) & (a < self.n) & (b < self.n)).astype(np.int64) << k
        return done

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y, which is behind x in the same document."""
        done, least = np.zeros(len(x), np.int64), self.start[np.minimum(x, self.n - 1)]
        for k in range(len(self.levels) - 1, -1, -1):
            level, a = self.levels[k], x - done - (1 << k)
            ok = a >= least
            a = np.maximum(a, 0)
            done += (ok & (level[a] == level[np.minimum(a + (y - x), self.n)])).astype(np.int64) << k
        return done

    def lcp(self) -> np.ndarray:
        """Of each suffix in order with the one before it; a 0 more at the end."""
        out = np.zeros(self.n + 1, np.int64)
        if self.n < 2:
            return out
        x, y, sets = self.order[:-1], self.order[1:], []
        now = np.arange(self.n - 1)
        for level in self.levels:
            now = now[level[x[now]] == level[y[now]]]
            if not len(now):
                break
            sets.append(now)
        done = np.zeros(self.n - 1, np.int64)
        for k in range(len(sets) - 1, -1, -1):
            some, level = sets[k], self.levels[k]
            a, b = x[some] + done[some], y[some] + done[some]
            done[some] += (level[a] == level[b]).astype(np.int64) << k
        out[1:-1] = done
        return out


def previous_factors(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(length of the longest stretch from each position that also begins earlier in its document, where that begins)."""
    n, lcp = index.n, index.lcp()
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    near = (lcp[:-1] > 0) | (lcp[1:] > 0)
    ranks = np.flatnonzero(near)
    if not len(ranks):
        return longest, source
    place = index.order[ranks]
    by = np.argsort(-place)
    at, shared = place.tolist(), [*lcp[ranks].tolist(), 0]
    m = len(at)
    before, after = list(range(-1, m)), list(range(1, m + 2))
    got, where = [0] * m, [-1] * m
    for r in by.tolist():
        a, b = before[r], after[r]
        left, right = shared[r], shared[b]
        if left >= right:
            got[r] = left
            if left:
                where[r] = at[a]
            shared[b] = right
        else:
            got[r], where[r], shared[b] = right, at[b], left
        before[b] = a
        if a >= 0:
            after[a] = b
    longest[place], source[place] = got, where
    return longest, source


def blocks(longest: np.ndarray) -> np.ndarray:
    """Where the blocks of the parse begin: each is the longest stretch that began earlier, or one word. Borders of documents are among them."""
    step, cuts, i, n = (np.arange(len(longest)) + np.maximum(longest, 1)).tolist(), [], 0, len(longest)
    while i < n:
        cuts.append(i)
        i = step[i]
    return np.array(cuts, np.int64)


def all_runs(codes: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (first word, last word, period), ordered, of all runs of documents that begin at `at`; words are numbered over all of them."""
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't found by two anchors a border")
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    index = Index(codes, at)
    longest, source = previous_factors(index)
    cuts = blocks(longest)
    size = np.diff(np.append(cuts, len(codes)))
    opens = index.start[cuts] == cuts
    ends = at[1:][np.diff(at) > 0]
    last = np.searchsorted(cuts, ends) - 1
    border = np.concatenate([cuts, ends])
    low = np.concatenate([index.start[cuts], at[:-1][np.diff(at) > 0]])
    high = np.concatenate([at[1:][np.searchsorted(at[1:], cuts, "right")], ends])
    span = np.concatenate([size + np.where(opens, 0, np.concatenate([[0], size[:-1]])), size[last]])
    found = [np.zeros((0, 3), np.int64)]
    for which in _portions(span // (times - 1)):
        most = span[which] // (times - 1)
        b = np.repeat(which, most)
        period = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
        for anchor, ok in ((border[b], border[b] + period < high[b]), (border[b] - 1 - period, border[b] - 1 - period >= low[b])):
            x, p = anchor[ok], period[ok]
            alike = codes[x] == codes[x + p]
            x, p = x[alike], p[alike]
            if not len(x):
                continue
            left, right = index.behind(x, x + p), index.ahead(x, x + p)
            long = left + right + p >= np.maximum(least, times * p)
            found.append(np.stack([x - left, x + right + p - 1, p], 1)[long])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    if not len(rows):
        return rows
    return _copied(rows, cuts, size, source, at, least)


def _portions(weights: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Indices with a weight, in portions of about `most` in all."""
    some = np.flatnonzero(weights)
    part = np.cumsum(weights[some]) // most
    for piece in np.split(some, np.flatnonzero(np.diff(part)) + 1):
        if len(piece):
            yield piece


def _copied(rows: np.ndarray, cuts: np.ndarray, size: np.ndarray, source: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """rows with those that lie strictly inside blocks."""
    doc_of = lambda x: np.searchsorted(at, x, "right") - 1
    here = np.isin(doc_of(cuts), doc_of(rows[:, 0])) & (size >= least + 2)
    held = list(map(tuple, rows.tolist()))
    for begin, n, src in zip(cuts[here].tolist(), size[here].tolist(), source[cuts[here]].tolist(), strict=True):
        k, stop, move = bisect_right(held, (src + 1, -1, -1)), src + n - 1, begin - src
        while k < len(held) and held[k][0] < stop:
            first, last, period = held[k]
            if last < stop:
                insort(held, (first + move, last + move, period))
            k += 1
    return np.array(held, np.int64).reshape(-1, 3)


def _summary(runs: np.ndarray, words: list[bytes] | None, text: bytes) -> tuple:
    """The results for one document; its runs are numbered from its first word. words: where they aren't those of the text."""
    if not len(runs):
        said = b" ".join(text.split() if words is None else words)
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(said).hexdigest()
    words = text.split() if words is None else words
    length = runs[:, 1] - runs[:, 0] + 1
    listed = np.lexsort((runs[:, 2], runs[:, 0]))
    best = np.lexsort((runs[:, 2], runs[:, 0], -length))[0]
    lines = "".join(f"{runs[k, 0]},{length[k]},{runs[k, 2]}\n" for k in listed)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1] + 1, -1)
    said = b" ".join(words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist())
    n, p = int(length[best]), int(runs[best, 2])
    return len(runs), int(runs[best, 0]), n, p, 1000 * n // p, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(said).hexdigest()


def collapse(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Callable | None = None) -> DataFrame:
    """A row for each document: the key and RESULT. rewrite(key, n) may give, for each of a document's n words, the word that stands for it."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = []
            for row, data, ends in texts(batch.column(1)):
                _, size, at = spans(data, ends)
                codes, _ = coded(data, size)
                moved = {}
                if rewrite is not None:
                    for d in range(len(ends)):
                        where = rewrite(keys[row + d], int(at[d + 1] - at[d]))
                        if where is not None:
                            moved[d] = where
                            codes[at[d] : at[d + 1]] = codes[at[d] + where]
                found = all_runs(codes, at, least, times)
                cut = np.searchsorted(found[:, 0], at)
                begin = np.concatenate([[0], ends[:-1]])
                for d in range(len(ends)):
                    said = data[begin[d] : ends[d]].tobytes()
                    words = None
                    if d in moved:
                        words = said.split()
                        words = [words[k] for k in moved[d].tolist()]
                    mine = found[cut[d] : cut[d + 1]] - np.array([at[d], at[d], 0])
                    rows.append((int(at[d + 1] - at[d]), *_summary(mine, words, said)))
            names = [f.split()[0] for f in RESULT.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in RESULT.split(", ")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *names])

    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, {RESULT}").withColumnRenamed("key", key)


def planted(doc_id, n: int) -> np.ndarray | None:
    """The query's own repeats: for a tenth of the documents, by the crc32 of the id, which word stands at each place; a null id has none."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    where = np.arange(n)
    where[a:] = a + (where[a:] - a) % p
    return where


def op13(spark, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "documents"), rewrite=planted)


QUERIES = {"op13_periodic_runs": op13}
ORACLE: dict[str, str] = {}
