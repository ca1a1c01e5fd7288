"""Digests of tables: sums of row hashes, so that parts of a table can be hashed apart and their sums added."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .identity import digest

SUMS = "n long, s1 decimal(38,0), s2 decimal(38,0)"


def row_hashes(schema: T.StructType, columns: Iterable[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row: of plain values with a mark of which are null, and of nested ones as JSON."""
    names = sorted(columns)
    nested = lambda t: isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    parts = [F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) if nested(schema[c].dataType) else F.col(f"`{c}`") for c in names]
    nulls = F.concat(F.lit("n"), *(F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in names))
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit(2), nulls, *parts)


def sums(df: DataFrame, columns: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """(by..., n, s1, s2) of the named columns."""
    a, b = row_hashes(df.schema, columns)
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total(a).alias("s1"), total(b).alias("s2"))


def sums_digest(dtypes: Iterable[tuple[str, str]], n, s1, s2) -> str:
    return digest([sorted(map(list, dtypes)), str(n or 0), str(s1 or 0), str(s2 or 0)])


def content_digest(df: DataFrame) -> str:
    """Of all rows and columns, whatever the order of the rows: the number of rows and two sums of 64-bit hashes."""
    got = sums(df, df.columns).first()
    return sums_digest(df.dtypes, got.n, got.s1, got.s2)
