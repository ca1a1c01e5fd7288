"""Rows that no other row dominates, by fronts of parts that are merged in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tuples that are compared at a time, parts that are merged into one, and best tuples that prune before anything is merged.
BLOCK, MERGED, FIRST = 512, 8, 32


def front_of(points: np.ndarray) -> np.ndarray:
    """Indices of the rows (distinct, larger is better) that no other row dominates. In order of falling sums a row can only be dominated by an earlier
    one, and only by one of the front so far."""
    order = np.argsort(-points.sum(1), kind="stable")
    front = np.zeros((0, points.shape[1]))
    kept: list[np.ndarray] = []
    for at in range(0, len(order), BLOCK):
        some = order[at : at + BLOCK]
        block = points[some]
        alive = np.ones(len(block), bool)
        for f in range(0, len(front), BLOCK):
            left = np.flatnonzero(alive)
            if not len(left):
                break
            alive[left] &= ~(front[f : f + BLOCK][None] >= block[left][:, None]).all(2).any(1)
        left = np.flatnonzero(alive)
        inner = (block[left][None] >= block[left][:, None]).all(2)
        np.fill_diagonal(inner, False)
        left = left[~inner.any(1)]
        kept.append(some[left])
        front = np.concatenate([front, block[left]])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _fronts(n: int):
    """The front of each task's rows; a task holds its front and one batch at a time."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            points = np.stack([held.column(i).to_numpy().astype(float) for i in range(n)], 1)
            held = held.take(pa.array(np.sort(front_of(points)))) if len(points) else held
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def skyline(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """The distinct tuples of `metrics` (numbers that a double holds exactly; larger is better) that no other tuple dominates. Tuples with a null
    or NaN are compared with none and are left out.

    The best by sum prune the others in one expression; then each part gives its front, and fronts are merged, MERGED parts
    at a time, until one part is left. What moves between tasks are fronts only."""
    known = F.lit(True)
    for m in metrics:
        known = known & F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double"))
    points = scores.where(known).select(*metrics).distinct()
    total = sum((F.col(m).cast("double") for m in metrics), F.lit(0.0))
    best = points.orderBy(total.desc(), *metrics).limit(FIRST).collect()
    dominated = F.lit(False)
    for b in best:
        worse, equal = F.lit(True), F.lit(True)
        for m in metrics:
            value = F.lit(b[m]).cast(scores.schema[m].dataType)
            worse, equal = worse & (F.col(m) <= value), equal & (F.col(m) == value)
        dominated = dominated | (worse & ~equal)
    run, parts = _fronts(len(metrics)), None
    out = points.where(~dominated).mapInArrow(run, points.schema)
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // MERGED)
        out = out.repartition(parts).mapInArrow(run, points.schema)
    return out
