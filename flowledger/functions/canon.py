"""Canonical JSON and content digests as Column expressions.

Canonical JSON sorts keys, indents by two spaces, keeps non-ASCII characters and nulls. The text is built from the column's
type, because to_json has another order, other spaces, and drops nulls. Floating-point numbers are not supported: their text
differs between engines, so cast them to strings or integers first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters whose escape has a letter; canonical JSON writes it in lower case.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def json_string(col: Column) -> Column:
    """A JSON string literal, quotes included."""
    held = F.to_json(F.struct(col.alias("s")))
    out = F.substring(held, F.lit(6), F.length(held) - 6)
    lowered = out
    for code in _LETTERED:
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(out.contains("\\u00"), lowered).otherwise(out)


def _render(col: Column, kind: T.DataType, depth: int) -> Column:
    inner, outer = "  " * (depth + 1), "  " * depth
    if isinstance(kind, T.StructType):
        parts: list[Column] = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.lit(("" if not i else ",\n") + f'{inner}"{f.name}": '), _render(col[f.name], f.dataType, depth + 1)]
        body = F.concat(F.lit("{\n"), *parts, F.lit(f"\n{outer}}}")) if parts else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        items = F.transform(col, lambda x: F.concat(F.lit(inner), _render(x, kind.elementType, depth + 1)))
        body = F.when(F.size(col) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{outer}]")))
    elif isinstance(kind, T.MapType):
        rows = F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(F.lit(inner), json_string(e["key"]), F.lit(": "), _render(e["value"], kind.valueType, depth + 1)))
        body = F.when(F.size(col) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(rows, ",\n"), F.lit(f"\n{outer}}}")))
    elif isinstance(kind, T.StringType):
        body = json_string(col)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        body = col.cast("string")
    else:
        raise TypeError(f"canonical JSON of {kind.simpleString()} is not defined")
    return F.when(col.isNull(), "null").otherwise(body)


def canonical_json(col: Column, kind: T.DataType) -> Column:
    return _render(col, kind, 0)


def canonical_struct(**columns: tuple[Column, str]) -> Column:
    """Canonical JSON of an object of named columns, each with its SQL type."""
    kind = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, (_, t) in columns.items()])
    return canonical_json(F.struct(*(c.cast(t).alias(n) for n, (c, t) in columns.items())), kind)


def sha(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, or of bytes, in lower-case hex."""
    return F.sha2(text.cast("binary"), 256)


def component_digest(*labelled: tuple[str, Column]) -> Column:
    """Digest of labelled digests: of the canonical JSON of the object that has them."""
    return sha(canonical_struct(**{label: (value, "string") for label, value in labelled}))
