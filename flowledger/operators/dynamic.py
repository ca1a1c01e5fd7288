"""Data-driven fan-out (map), fan-in (aggregate) and ordered folds (scan)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.canon import sha


PIECE = 128  # items of a chain that are folded at a time


def check_items(items: DataFrame, item: str = "id") -> DataFrame:
    """items, if every id is a non-empty text or a number and none repeats; else a ValueError that names some. One aggregation."""
    bad = items.groupBy(F.col(item).cast("string").alias("__id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR __id IS NULL OR trim(__id) = '' OR contains(__id, '@')")
    found = bad.orderBy("__id").limit(5).collect()
    if found:
        raise ValueError("item ids must be unique, not empty and without @: " + ", ".join(f"{r['__id']!r} ({r['n']} times)" for r in found))
    return items


def with_keys(items: DataFrame, source: str, item: str, *, shared: Column | None = None, params: Column | None = None, files: Column | None = None, name: str = "key") -> DataFrame:
    """items with the key of each: a digest of the function's fingerprint, the whole item, and what it shares, is set to or reads."""
    body = F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"})
    parts = [F.lit(source), F.col(item).cast("string"), body, *(x if x is not None else F.lit("") for x in (shared, params, files))]
    return items.withColumn(name, sha(F.concat_ws("\x1f", *(sha(p) for p in parts))))


def carry_keys(folded: DataFrame, chain: str, order: list[str], item: Column, carry: Column, start: str) -> DataFrame:
    """folded with the key of each step: a digest of the item and of the content that is carried into it."""
    before = F.lag(carry).over(W.partitionBy(chain).orderBy(*order))
    return folded.withColumn("key", sha(F.concat_ws("\x1f", sha(item), sha(F.coalesce(before, F.lit(start))))))


def all_hit(rows: DataFrame, hit: str = "hit", by: str | None = None) -> DataFrame:
    """(all_hit, items, hits): whether there are items and every one is a hit."""
    made = rows.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("hits"))
    return made.withColumn("all_hit", (F.col("items") > 0) & (F.col("items") == F.col("hits")))


def map_items(items: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn over the rows of items. It must be row by row; the item's key and position pass through."""
    return fn(items)


def aggregate(rows: DataFrame, node: str, item: str, order: list[str]) -> DataFrame:
    """(node, order, count): the ids of each node's items in order. The items themselves stay rows."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("__id"))))
    return rows.groupBy(node).agg(listed.alias("__all"), F.count(F.lit(1)).alias("count")).select(node, F.col("__all.__id").alias("order"), "count")


def running_total(rows: DataFrame, chain: str, order: list[str], value: Column, name: str) -> DataFrame:
    """An associative scan: one window over each chain."""
    return rows.withColumn(name, F.sum(value).over(W.partitionBy(chain).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def fold(rows: DataFrame, chain: str, order: list[str], columns: list[str], start: Column, step: Callable[[Column, Column], Column], result: Callable[[Column, Column], Column]) -> DataFrame:
    """(chain, order..., out): a fold that a window can't express. step(state, item) gives the next state, result(state before, item) the item's
    output. A chain is one array; chains run side by side. It is folded in pieces, so that rows are copied a bounded number of times."""
    listed = rows.groupBy(chain).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("__all"))
    none = F.slice(F.transform("__all", lambda x: F.struct(x.alias("item"), result(start, x).alias("out"))), 1, 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / PIECE).cast("int")), lambda i: F.slice("__all", i * PIECE + 1, PIECE))

    def one(a: Column, x: Column) -> Column:
        return F.struct(step(a["state"], x).alias("state"), F.concat(a["rows"], F.array(F.struct(x.alias("item"), result(a["state"], x).alias("out")))).alias("rows"))

    def piece(a: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(a["state"].alias("state"), none.alias("rows")), one)
        return F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(a["rows"], F.array(d["rows"])).alias("rows")))[0]

    done = F.aggregate(parts, F.struct(start.alias("state"), F.slice(F.array(none), 1, 0).alias("rows")), piece)
    return listed.select(chain, F.explode(F.flatten(done["rows"])).alias("r")).select(chain, *(F.col(f"r.item.{c}").alias(c) for c in order), F.col("r.out").alias("out"))


def prefix_reuse(rows: DataFrame, chain: str, order: list[str], same: Column) -> DataFrame:
    """rows with `hit`: this item and all before it in its chain are unchanged."""
    miss = F.max((~F.coalesce(same, F.lit(False))).cast("int")).over(W.partitionBy(chain).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("hit", miss == 0)


def per_item(items: DataFrame, item: str, fn: Callable[[dict], list[dict]], out: str) -> DataFrame:
    """(item, out columns, error): fn gives an item's rows as dicts, any number of them. An item for which it raises has one row with what it raised as
    `error`, and the others go on."""
    fields = StructType.fromDDL(out).fields
    schema = StructType([items.schema[item], *fields, StructField("error", StringType())])
    arrow, names = to_arrow_schema(schema), [f.name for f in fields]

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows += [{item: row[item], **{n: made.get(n) for n in names}, "error": None} for made in fn(row)]
                except Exception as e:  # noqa: BLE001 - becomes the item's row
                    rows.append({item: row[item], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return items.mapInArrow(run, schema)
