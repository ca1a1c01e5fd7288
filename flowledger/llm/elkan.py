"""Codes of vectors by Lloyd's rounds with Elkan's bounds: one codebook of at most ENTRIES integer entries for each of PARTS parts.

Components x become floor(256 * x); all that follows is integer. A vector's parts are assigned to the nearest entry (squared Euclidean distance,
ties to the lower index), each entry becomes the componentwise floor of its parts' mean, ROUNDS times; then they are assigned for the last time.

Bounds are kept from round to round in a table, part by part: an upper bound of the distance to the part's entry and a lower bound for every
entry, shifted by how far the entries have moved. They are whole multiples of a unit (a 200th of the first codebook's
width, 1 at least), lower bounds rounded down to a byte, upper bounds and movements rounded up; a bound that doesn't fit is held as the largest byte (still
a lower bound) or as unknown. An entry is left out only where a bound is strictly greater, so that an entry at the same distance
is always compared by integers: results are those of the search over all entries.

Distances, sums and means are int64 where the largest component allows that, and Python's integers otherwise. A round writes a table (bounds,
codes) and adds up sums by (part, entry) inside tasks first; only codebooks reach the driver.

Rows are dropped whose vector is null, holds null or non-finite components, or hasn't the length of the first kept row's vector (a positive
multiple of PARTS). First entries are those parts of the ENTRIES first rows by id (null ids last; equal ids by vector); with fewer
rows there are fewer entries. Repeated rows count each. An empty table gives an empty result. An error above the largest long is given as that.
Other columns than id, vector and label are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread_join, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
TOP, UNKNOWN, LONG = 255, 65535, 2**63 - 1
STATE = "id {id}, label {label}, parts binary, code binary, upper binary, lower binary"
_limb = 32


def roots(d: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    if d.dtype == object:
        return np.array([math.isqrt(x) for x in d.ravel().tolist()], object).reshape(d.shape)
    r = np.sqrt(d.astype(float)).astype(np.int64)
    r -= r * r > d
    return r + ((r + 1) * (r + 1) <= d)


def _down(d2: np.ndarray, unit: int, most: int = TOP) -> np.ndarray:
    """Distances in units, rounded down; larger ones count as `most`."""
    return np.minimum(roots(d2) // unit, most).astype(np.int64)


def _up(d2: np.ndarray, unit: int) -> np.ndarray:
    r = roots(d2)
    r = r + (r * r < d2)
    return np.minimum(-(-r // unit), UNKNOWN).astype(np.int64)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Books:
    """Codebooks of a round, the unit of their bounds and what pruning needs: distances between entries and how far they moved."""

    def __init__(self, entries: np.ndarray, units: list[int], moved: np.ndarray | None = None) -> None:
        self.entries, self.units = entries, units
        parts, k = entries.shape[:2]
        self.apart = np.stack([_down(_square(e[:, None], e[None]), u, UNKNOWN) for e, u in zip(entries, units, strict=True)])
        self.near = np.where(np.eye(k, dtype=bool), UNKNOWN, self.apart).min(2)
        self.moved = np.zeros((parts, k), np.int64) if moved is None else np.stack([_up(_square(a, b), u) for a, b, u in zip(entries, moved, units, strict=True)])


def first_units(entries: np.ndarray) -> list[int]:
    return [max(1, -(-int(roots(_square(e[:, None], e[None])).max(initial=0)) // 200)) for e in entries]


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Books, part: int) -> tuple[np.ndarray, int]:
    """Assign a part of many vectors; code, upper and lower (of this part) are brought up to date in place. (squared distance to the entry where it was
    computed, else -1; number of distances computed)."""
    entries, unit, apart, moved = books.entries[part], books.units[part], books.apart[part], books.moved[part]
    held = upper == UNKNOWN
    now = np.minimum(upper.astype(np.int64) + moved[code], UNKNOWN)
    now[held] = UNKNOWN
    lower[:] = np.maximum(lower.astype(np.int64) - moved, 0)
    upper[:] = now
    squared = np.full(len(x), -1, x.dtype)
    some = np.flatnonzero((books.near[part][code] <= 2 * now) | (now == UNKNOWN))
    if not len(some):
        return squared, 0
    x, mine, near = x[some], code[some].astype(np.int64), lower[some]
    best = _square(x, entries[mine])
    bound, done = _up(best, unit), len(some)
    near[np.arange(len(some)), mine] = _down(best, unit)
    for j in range(len(entries)):
        ask = np.flatnonzero((near[:, j] <= bound) & ((apart[mine, j] <= 2 * bound) | (bound == UNKNOWN)) & (mine != j))
        if not len(ask):
            continue
        d = _square(x[ask], entries[j])
        done += len(ask)
        near[ask, j] = _down(d, unit)
        closer = (d < best[ask]) | ((d == best[ask]) & (j < mine[ask]))
        to = ask[closer]
        best[to], mine[to], bound[to] = d[closer], j, _up(d[closer], unit)
    code[some], upper[some], lower[some], squared[some] = mine, bound, near, best
    return squared, done


def whole_numbers(vectors: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 * x) of finite values."""
    if exact:
        return np.floor(vectors.astype(float) * SCALE).astype(np.int64)
    return np.array([math.floor(Fraction(v) * SCALE) for v in vectors.ravel().tolist()], object).reshape(vectors.shape)


def _bytes(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows[0].size if len(rows) else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _packed(x: np.ndarray) -> pa.Array:
    """Integers as bytes, each as wide as the table's kind asks; Python's integers as text."""
    return pa.array([",".join(map(str, r)).encode() for r in x.reshape(len(x), -1).tolist()], pa.binary()) if x.dtype == object else _binary(x.reshape(len(x), -1))


def _unpacked(column: pa.Array, dim: int, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row.split(b",")] for row in column.to_pylist()], object).reshape(len(column), PARTS, dim // PARTS)
    return _bytes(column, dim, kind).astype(np.int64).reshape(len(column), PARTS, dim // PARTS)


def _opened(batch: pa.RecordBatch, dim: int, kind, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (_unpacked(batch.column(2), dim, kind), _bytes(batch.column(3), PARTS, np.uint8).copy(), _bytes(batch.column(4), PARTS, np.uint16).copy(), _bytes(batch.column(5), PARTS * k, np.uint8).copy().reshape(-1, PARTS, k))


def _begun(dim: int, kind):
    """Vectors as whole numbers with bounds that say nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            if len(batch):
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                yield batch, whole_numbers(flat.reshape(len(batch), dim), kind is not object).reshape(len(batch), PARTS, dim // PARTS)

    return run


def _round(books: Books, dim: int, kind, fresh: bool):
    """Rows of STATE after assignment; fresh: from vectors, not from STATE."""
    k = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if fresh:
            found = ((b, x, np.zeros((len(x), PARTS), np.uint8), np.full((len(x), PARTS), UNKNOWN, np.uint16), np.zeros((len(x), PARTS, k), np.uint8)) for b, x in _begun(dim, kind)(batches))
        else:
            found = ((b, *_opened(b, dim, kind, k)) for b in batches if len(b))
        for batch, x, code, upper, lower in found:
            for p in range(PARTS):
                _moved(x, code, upper, lower, books, p)
            parts = _packed(x if kind is object else x.astype(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts, _binary(code), _binary(upper), _binary(lower.reshape(len(x), -1))], names=["id", "label", "parts", "code", "upper", "lower"])

    return run


def _moved(x, code, upper, lower, books: Books, p: int) -> np.ndarray:
    mine, bound, near = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
    squared, _ = assign(x[:, p], mine, bound, near, books, p)
    code[:, p], upper[:, p], lower[:, p] = mine, bound, near
    return squared


def _last(books: Books, dim: int, kind):
    k = books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, code, upper, lower = _opened(batch, dim, kind, k)
            error = np.zeros(len(x), x.dtype)
            for p in range(PARTS):
                _moved(x, code, upper, lower, books, p)
                error += _square(x[:, p], books.entries[p][code[:, p].astype(np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array([min(int(e), LONG) for e in error], pa.int64())], names=["id", "label", "code", "error"])

    return run


def _sums(dim: int, kind, k: int):
    """(slot, limb, total): for each part and entry its number of parts and their sum, in limbs where they may exceed a long."""
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, k, width + 1), object if kind is object else np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x, code = _unpacked(batch.column(0), dim, kind), _bytes(batch.column(1), PARTS, np.uint8).astype(np.int64)
            for p in range(PARTS):
                np.add.at(total[p], code[:, p], np.concatenate([x[:, p], np.ones((len(x), 1), x.dtype)], 1))
        slots = np.flatnonzero(total.ravel() != 0)
        flat = total.ravel()[slots].tolist()
        if kind is object:
            rows = [(s, n, (1 if v > 0 else -1) * (abs(v) >> (_limb * n) & (2**_limb - 1))) for s, v in zip(slots.tolist(), flat, strict=True) for n in range(abs(v).bit_length() // _limb + 1)]
        else:
            rows = [(s, 0, v) for s, v in zip(slots.tolist(), flat, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))], names=["slot", "limb", "total"])

    return run


def _means(state: DataFrame, books: Books, dim: int, kind) -> Books:
    parts, k, width = books.entries.shape
    rows = state.select("parts", "code").mapInArrow(_sums(dim, kind, k), "slot long, limb int, total long").groupBy("slot", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(parts * k * (width + 1), object)
    for r in rows:
        total[r.slot] += int(r.total) << (_limb * r.limb)
    total = total.reshape(parts, k, width + 1)
    entries = books.entries.copy()
    for p in range(parts):
        for j in range(k):
            if total[p, j, width]:
                entries[p, j] = [v // total[p, j, width] for v in total[p, j, :width]]
    return Books(entries, books.units, books.entries)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def compress(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 for each kept vector."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    kinds = {n: kept.schema[n].dataType.simpleString() for n in ("id", "label")}
    kept = kept.where(finite(F.col("vector")) & (F.size("vector") % PARTS == 0))
    order = [F.col("id").asc_nulls_last(), "vector", "label"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"`{key}` {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(first[0].vector)
    kept = kept.where(F.size("vector") == dim)
    seeds = kept.orderBy(*order).limit(min(entries, 256)).collect()
    low, high = kept.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    most = max(abs(math.floor(Fraction(low) * SCALE)), abs(math.floor(Fraction(high) * SCALE)))
    kind = object if PARTS * dim * (2 * most + 2) ** 2 >= 2**62 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    begun = whole_numbers(np.array([r.vector for r in seeds], float), kind is not object).reshape(len(seeds), PARTS, dim // PARTS).transpose(1, 0, 2)
    books = Books(np.ascontiguousarray(begun), first_units(begun))
    state, drop = kept, None
    schema = STATE.format(**kinds)
    for n in range(rounds):
        new, remove = staged(state.mapInArrow(_round(books, dim, kind, fresh=n == 0), schema))
        books = _means(new, books, dim, kind)
        if drop:
            drop()
        state, drop = new, remove
    done = materialise(state.mapInArrow(_last(books, dim, kind), f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    drop()
    named = done.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = named.groupBy("__label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sha = hashlib.sha256(",".join(str(v) for v in books.entries.ravel().tolist()).encode()).hexdigest()
    joined = spread_join(named, by_label, "__label", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return joined.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_elkan_codes": op12}
ORACLE: dict[str, str] = {}
