"""Ordered sums and digests of groups that may hold most rows: in range parts side by side, or streamed in order."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.canon import sha

#: Parts of a table whose running sums are formed side by side, and rows of the sample that their borders come from.
PARTS, SAMPLE = 64, 8192


def range_parts(rows: DataFrame, columns: list[str], parts: int = PARTS, sample: int = SAMPLE) -> Column:
    """The number of the range part that a row of these columns falls into. Borders come from rows picked by a hash; they decide how even the
    parts are, and nothing else."""
    n = rows.count()
    share = max(1, n // sample)
    some = rows.select(*columns).distinct().where(F.pmod(F.xxhash64(*columns), F.lit(share)) == 0).orderBy(*columns).limit(4 * sample).collect()
    step = max(1, -(-len(some) // parts))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    cast = lambda r: F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, r, strict=True))).cast(f"struct<{kinds.replace('` ', '`: ')}>")
    borders = [cast(r) for r in some[step::step]]
    return F.size(F.filter(F.array(*borders), lambda b: b <= F.struct(*columns))) if borders else F.lit(0)


def prefix_sums(rows: DataFrame, key: str, order: list[str], values: Mapping[str, Column], parts: int = PARTS) -> DataFrame:
    """rows with the running sum of each value in its key's order, however many rows a key has.

    Each (key, range part) is summed on its own; the parts' totals, one row for each, are summed in order, and each row adds what came before its part. Rows that are
    equal in key and order are taken one after the other, so the order should be unique in its key."""
    keyed = rows.withColumns({f"__v_{n}": v for n, v in values.items()})
    keyed = keyed.withColumn("__part", range_parts(keyed, [key, *order], parts))
    totals = keyed.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values))
    before = W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__k", "__p", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in values))
    here = W.partitionBy(key, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = keyed.join(totals, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    return met.select(*rows.columns, *((F.col(f"__t_{n}") + F.sum(f"__v_{n}").over(here)).alias(n) for n in values))


def stream_digest(rows: DataFrame, key: str, order: list[str], value: str, between: str = "\n") -> DataFrame:
    """(key, digest): SHA-256 of a key's values, joined in order. The values stream through the digest, so no group is held."""
    kind = rows.schema[key].dataType.simpleString()
    laid = rows.select(key, *order, value).repartition(F.col(key)).sortWithinPartitions(key, *order).select(key, value)

    def run(batches):
        now, state, first = None, None, True
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first or k != now:
                    if not first:
                        yield [now], [state.hexdigest()]
                    now, state, first = k, hashlib.sha256(), False
                else:
                    state.update(between.encode())
                state.update((v or "").encode())
        if not first:
            yield [now], [state.hexdigest()]

    def batched(batches):
        for keys, digests in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, typed), pa.array(digests, pa.string())], names=["key", "digest"])

    from pyspark.sql.pandas.types import to_arrow_type

    typed = to_arrow_type(rows.schema[key].dataType)
    return laid.mapInArrow(batched, f"key {kind}, digest string").withColumnRenamed("key", key)


#: Children of a node of a digest tree.
WIDTH = 64


def leaves(rows: DataFrame, key: str, place: str, value: Column, width: int = WIDTH) -> DataFrame:
    """(key, level 0, node, digest): the digests of `width` places in a row, by a whole-number place that is unique in its key."""
    return _parents(rows.select(key, F.col(place).alias("node"), sha(value).alias("digest")), key, 0, width)


def _parents(nodes: DataFrame, key: str, level: int, width: int) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most `width` of them
    made = nodes.groupBy(key, F.floor(F.col("node") / width).cast("long").alias("__up")).agg(listed.alias("__all"))
    return made.select(key, F.lit(level).alias("level"), F.col("__up").alias("node"), sha(F.array_join("__all.digest", "\n")).alias("digest"))


def merkle(rows: DataFrame, key: str, place: str, value: Column, levels: int, width: int = WIDTH) -> DataFrame:
    """(key, level, node, digest): a digest tree of each key over places below width ** (levels + 1); the last level has the roots."""
    out = level = leaves(rows, key, place, value, width)
    for n in range(1, levels + 1):
        level = _parents(level, key, n, width)
        out = out.unionByName(level)
    return out


def merkle_update(tree: DataFrame, rows: DataFrame, changed: DataFrame, key: str, place: str, value: Column, levels: int, width: int = WIDTH) -> DataFrame:
    """The tree after rows at the places of `changed` (key, place) were added, edited or taken away: only the nodes above them are computed. rows are all rows now."""
    up = lambda c: F.floor(c / width).cast("long")
    touched = changed.select(F.col(key).alias("__k"), up(F.col(place)).alias("__n")).distinct()
    mine = rows.join(touched, F.col(key).eqNullSafe(F.col("__k")) & (up(F.col(place)) == F.col("__n")), "left_semi")
    level = leaves(mine, key, place, value, width)
    out = None
    for n in range(levels + 1):
        on = F.col(key).eqNullSafe(F.col("__k")) & (F.col("node") == F.col("__n"))
        kept = tree.where(F.col("level") == n).join(touched, on, "left_anti")
        now = kept.unionByName(level)
        out = now if out is None else out.unionByName(now)
        if n < levels:
            touched = touched.select("__k", up(F.col("__n")).alias("__n")).distinct()
            children = now.join(touched, F.col(key).eqNullSafe(F.col("__k")) & (up(F.col("node")) == F.col("__n")), "left_semi")
            level = _parents(children, key, n + 1, width)
    return out
