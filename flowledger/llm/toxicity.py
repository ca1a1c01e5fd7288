"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labels here; all other text is unlabelled and holds toxic texts too, at the class prior. With the logistic loss
l, a score g, the mean over confirmed texts P and over unlabelled ones U, the risk that is minimised is

    prior * P[l(g)] + max(0, U[l(-g)] - prior * P[l(-g)])

plus a ridge. Where the second part falls below 0 (the model has begun to learn unlabelled toxic texts by heart), the step goes
against that part's gradient only. Its minimum is the log odds, so sigmoid(g) is the score.

Signals are shares of a text's words that begin with the same 5, 6, 7 or 8 bytes or are the same word (runs of letters and of
all that isn't ASCII, in lower case); the square root of a share is the value. Candidates stand in at least COMMON of the sample's confirmed
texts; how many of all documents that aren't held out have each is counted over the whole table, and the SIGNALS whose share among confirmed
texts departs most from that (by the likelihood ratio, at most four for each confirmed text) are used.

The fit is on the driver, on at most CONFIRMED labelled rows and UNLABELLED documents, each the first by a hash of the id; these bounds are parameters. The
prior is a parameter; by default it is the share of label 1 among labelled rows that aren't held out, and PRIOR where only label 1 occurs.

Rows with crc32(id as text) % 4 = 2 are held out: their labels and texts aren't read by the fit. Nulls: a null text is scored as an empty one, whose score follows
from the model's constant alone; labels without id or label are left out; a null id is never held out. An id with both labels is confirmed. Repeated rows are scored
one by one; an id counts once in the sample, with its smallest text. Without confirmed texts every score is 0. Other columns than the key and text are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .shingles import LOWER, byte_hashes, mix, texts
from .words import coded, spans

CONFIRMED, UNLABELLED, SIGNALS, COMMON = 10_000, 10_000, 2048, 0.004
PRIOR, THRESHOLD, RIDGE, STEPS, RATE = 0.1, 0.3, 1e-5, 300, 0.3
PREFIXES = (5, 6, 7, 8)
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


class Model(NamedTuple):
    signals: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    constant: float


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_signals(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct word, times) of each pair of a text and a word in it, then the hashes of each distinct word's signals (0: none)."""
    data = LOWER[data]
    _, size, at = spans(data, ends, NOT_LETTER)
    codes, distinct = coded(data, size, NOT_LETTER)
    m = max(1, len(distinct))
    pairs, times = np.unique(np.repeat(np.arange(len(ends)), np.diff(at)) * m + codes, return_counts=True)
    lower = pc.utf8_lower(distinct.cast(pa.large_string()))
    if not len(lower):
        return pairs, pairs, times, np.zeros((0, 1 + len(PREFIXES)), np.uint64)
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1)
    held = np.frombuffer(lower.buffers()[2], np.uint8, offsets[-1])
    begin, length = offsets[:-1], np.diff(offsets)
    head = held[np.minimum(begin[:, None] + np.arange(8), len(held) - 1)] * (np.arange(8) < length[:, None])
    head = np.ascontiguousarray(head.astype(np.uint8)).view("<u8").ravel()
    made = [np.where(length >= p, mix(head & np.uint64(2 ** (8 * p) - 1)) | np.uint64(1), np.uint64(0)) for p in PREFIXES]
    return pairs // m, pairs % m, times, np.stack([byte_hashes(held, begin, length) & np.uint64(2**64 - 2), *made], 1)


def found_signals(data: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in wanted, share of the text's words), in order, of the wanted signals."""
    text, word, times, signals = word_signals(data, ends)
    total = np.bincount(text, times, len(ends))
    where = np.minimum(np.searchsorted(wanted, signals), max(0, len(wanted) - 1))
    where = np.where(wanted[where] == signals, where, -1) if len(wanted) else np.full(signals.shape, -1)
    of, times = where[word], times.astype(float)
    ok = of >= 0
    key = (text[:, None] * max(1, len(wanted)) + of)[ok]
    key, back = np.unique(key, return_inverse=True)
    text, place = key // max(1, len(wanted)), key % max(1, len(wanted))
    return text, place, np.bincount(back, np.broadcast_to(times[:, None], of.shape)[ok], len(key)) / total[text]


def _counted(wanted: np.ndarray | None):
    """(signal, n): how many texts of a task's part have each signal; of all signals, or of the wanted ones."""

    def run(batches):
        total = {} if wanted is None else np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, data, ends in texts(batch.column(0)):
                if wanted is None:
                    text, word, _, signals = word_signals(data, ends)
                    key = np.unique(np.stack([np.repeat(text, signals.shape[1]).astype(np.uint64), signals[word].ravel()], 1), axis=0)[:, 1]
                    got, n = np.unique(key[key > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n)], names=["signal", "n"])
                else:
                    total += np.bincount(found_signals(data, ends, wanted)[1], minlength=len(wanted))
        if wanted is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(total[some])], names=["signal", "n"])

    return run


def _sums(df: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    return df.select("text").mapInArrow(_counted(wanted), "signal long, n long").groupBy("signal").agg(F.sum("n").alias("n"))


def _chosen(confirmed: np.ndarray, n_confirmed: int, every: np.ndarray, n_every: int, most: int) -> np.ndarray:
    """Places of the signals whose share among confirmed texts departs most from that among all."""
    p, q = confirmed / n_confirmed, np.clip(every / max(1, n_every), 1e-9, 1 - 1e-9)
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / b), 0.0)
    return np.sort(np.argsort(-(part(p, q) + part(1 - p, 1 - q)), kind="stable")[:most])


def risk(g_confirmed: np.ndarray, g_unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk, without the max."""
    loss = lambda g: np.logaddexp(0, -g)
    return prior * float(loss(g_confirmed).mean()), float(loss(-g_unlabelled).mean()) - prior * float(loss(-g_confirmed).mean())


def learn(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, confirmed: np.ndarray, width: int, prior: float, *, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """(weights, constant) by Adam's steps over all texts at once; (rows, columns, values) are the texts' signals, confirmed tells which texts are."""
    w, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    n, p, u = len(confirmed), max(1, int(confirmed.sum())), max(1, int((~confirmed).sum()))
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    for t in range(1, steps + 1):
        g = np.bincount(rows, values * w[columns], n) + w[-1]
        s = sigmoid(g)
        positive = np.where(confirmed, -prior * (1 - s) / p, 0.0)
        negative = np.where(confirmed, -prior * s / p, s / u)
        part = risk(g[confirmed], g[~confirmed], prior)[1]
        slope = positive + negative if part >= 0 else -negative
        grad = np.append(np.bincount(columns, values * slope[rows], width), slope.sum())
        grad[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * min(1.0, 3 * (1 - t / (steps + 1))) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, confirmed: int = CONFIRMED, unlabelled: int = UNLABELLED, signals: int = SIGNALS) -> Model | None:
    """The model, or None without confirmed texts."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    if prior is None:
        share = marked.agg(F.avg(F.col("y").cast("double"))).first()[0]
        prior = PRIOR if share in (None, 1.0) else min(0.9, max(1e-4, share))
    first = lambda ids, n: ids.orderBy(F.xxhash64("id"), "id").limit(n)
    sure = first(marked.where("y = 1").select("id"), confirmed)
    others = first(docs.select("id").distinct(), unlabelled)
    sample = sure.withColumn("sure", F.lit(True)).unionByName(others.withColumn("sure", F.lit(False)))
    sample = materialise(docs.join(F.broadcast(sample), "id").groupBy("id", "sure").agg(F.min("text").alias("text")))  # at most confirmed + unlabelled ids
    n_sure = sample.where("sure").count()
    if not n_sure:
        return None
    common = max(3 if n_sure > 20 else 1, int(COMMON * n_sure))
    seen = _sums(sample.where("sure"), None).where(F.col("n") >= common).collect()
    wanted = np.array([r.signal for r in seen], np.int64).view(np.uint64)
    order = np.argsort(wanted)
    wanted, near = wanted[order], np.array([r.n for r in seen], np.int64)[order]
    every = np.zeros(len(wanted), np.int64)
    for r in _sums(docs, wanted).collect():
        every[np.searchsorted(wanted, np.array([r.signal]).view(np.uint64)[0])] = r.n
    wanted = wanted[_chosen(near, n_sure, every, docs.count(), min(signals, 4 * n_sure))]

    def run(batches):
        for batch in batches:
            for row, data, ends in texts(batch.column(1)):
                at, place, share = found_signals(data, ends, wanted)
                cut = np.searchsorted(at, np.arange(len(ends) + 1))
                pack = lambda x, cut=cut: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(ends)), pack(place.astype(np.uint16)), pack(share.astype(np.float32))], names=["sure", "place", "share"])

    got = sample.orderBy("sure", F.xxhash64("id"), "id").select("sure", "text").mapInArrow(run, "sure boolean, place binary, share binary").collect()
    sizes = [len(r.place) // 2 for r in got]
    rows = np.repeat(np.arange(len(got)), sizes)
    columns = np.frombuffer(b"".join(r.place for r in got), np.uint16).astype(np.int64)
    values = np.sqrt(np.frombuffer(b"".join(r.share for r in got), np.float32).astype(float))
    w, constant = learn(rows, columns, values, np.array([r.sure for r in got]), len(wanted), prior)
    return Model(wanted, w, constant)


def score(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(f"`{key}`").alias("key"), held_out(F.col(f"`{key}`")).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch))
            if model is not None:
                for row, data, ends in texts(batch.column(2)):
                    at, place, share = found_signals(data, ends, model.signals)
                    g = np.bincount(at, np.sqrt(share) * model.weights[place], len(ends)) + model.constant
                    out[row : row + len(ends)] = 1 / (1 + np.exp(-np.clip(g, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=["key", "held_out", "score", "predicted"])

    return narrow.mapInArrow(run, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op11_positive_unlabelled": op11}
ORACLE: dict[str, str] = {}
