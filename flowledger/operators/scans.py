"""Ordered folds by a Python function, streamed: each chain's rows come in order and only its carry is held."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task turns into Python values at a time.
ROWS = 2000


def carried(value) -> str:
    """A carry as it is stored and compared: canonical JSON."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def step_key(source: str, item_sha: str, carry_sha: str) -> str:
    """The key of a step of a scan: what computes it, its item, and the content of what is carried into it."""
    return sha("\x1f".join((source, item_sha, carry_sha)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield from batch.slice(at, ROWS).to_pylist()


def _batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def laid_out(rows: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """A chain's rows in one task and in order; they stream from the sort, which spills."""
    return rows.repartition(F.col(chain)).sortWithinPartitions(chain, *order)


def fold(rows: DataFrame, chain: str, order: list[str], start, step: Callable, out: str) -> DataFrame:
    """(chain, order..., out columns): step(carry, row) gives (next carry, dict of the row's results); the first carry of each chain is `start`.

    Rows are dicts. A null chain is a chain like any other. Ties in the order are in no certain order, so the order should be unique in its chain."""
    keep = [chain, *order]
    names = [f.name for f in StructType.fromDDL(out)]
    schema = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(out).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        def folded():
            now, carry, first = None, None, True
            for row in _rows(batches):
                if first or row[chain] != now:
                    now, carry, first = row[chain], start, False
                carry, made = step(carry, row)
                yield {**{c: row[c] for c in keep}, **{n: made[n] for n in names}}

        return _batched(folded(), arrow)

    return laid_out(rows, chain, order).mapInArrow(run, schema)


def suffixes(items: DataFrame, held: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """(chain, __first): the least place of each chain at which items (chain, order..., item_sha) differ from the held ones, by a new, changed or
    missing item. Chains without a difference have no row."""
    at = [chain, *order]
    mine, theirs = items.select(*at, "item_sha"), held.select(*at, F.col("item_sha").alias("__held"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at]
    both = mine.alias("a").join(theirs.alias("b"), on, "full_outer")
    there = F.col("a.item_sha").isNotNull()
    pick = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    off = both.where(~F.col("a.item_sha").eqNullSafe(F.col("b.__held"))).select(*(pick(c) for c in at))
    return off.groupBy(chain).agg(F.min(F.struct(*order)).alias("__first"))


def resumed(rows: DataFrame, chain: str, order: list[str], source: str, start, step: Callable, out: str) -> DataFrame:
    """(chain, order..., item_sha, carry_sha, __key, hit, carry, out columns) of rows (chain, order, __kind, __carry, __item_sha, __held_sha, __held_carry, __held_in, item columns...).

    A row of kind 0 only gives the carry with which its chain begins. A row whose item and carry are those that were held is a hit: its held carry goes
    on, and the function isn't called; its out columns are null."""
    names = [f.name for f in StructType.fromDDL(out)]
    keep = [chain, *order]
    extra = StructType.fromDDL("item_sha string, carry_sha string, __key string, hit boolean, carry string")
    schema = StructType([rows.schema[c] for c in keep] + extra.fields + StructType.fromDDL(out).fields)
    arrow, hidden = to_arrow_schema(schema), {"__kind", "__carry", "__item_sha", "__held_sha", "__held_carry", "__held_in"}
    begin = carried(start)

    def run(batches):
        def folded():
            now, carry, first = None, None, True
            for row in _rows(batches):
                if first or row[chain] != now:
                    now, carry, first = row[chain], begin, False
                if row["__kind"] == 0:
                    carry = row["__carry"]
                    continue
                item, into = row["__item_sha"], sha(carry)
                done = {c: row[c] for c in keep} | {"item_sha": item, "carry_sha": into, "__key": step_key(source, item, into)}
                if row["__held_sha"] == item and row["__held_in"] == into:
                    carry = row["__held_carry"]
                    yield done | {"hit": True, "carry": carry} | dict.fromkeys(names)
                    continue
                state, made = step(json.loads(carry), {k: v for k, v in row.items() if k not in hidden})
                carry = carried(state)
                yield done | {"hit": False, "carry": carry} | {n: made[n] for n in names}

        return _batched(folded(), arrow)

    return laid_out(rows, chain, ["__kind", *order]).mapInArrow(run, schema)
