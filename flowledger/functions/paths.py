"""Typed paths into nested values: keys and list places from either end, over VARIANT, JSON text, structs, maps and arrays.

A path is written `a.b[0].c[-1]`, or given as a tuple of keys and places. Strict paths fail the query where a part is missing, and say which; lenient ones
give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r"(?:^|\.)([^.\[\]]+)|\[(-?\d+)\]")


def parse(path: str | Sequence[str | int]) -> tuple[str | int, ...]:
    """The parts of a path; ('a', 'b', 0) of 'a.b[0]'."""
    if not isinstance(path, str):
        parts = tuple(path)
        if not parts or not all(isinstance(p, (str, int)) and not isinstance(p, bool) and p != "" for p in parts):
            raise ValueError(f"a path has keys and whole numbers: {path!r}")
        return parts
    parts, at = [], 0
    while at < len(path):
        m = _PART.match(path, at)
        if not m or path[0] == ".":
            raise ValueError(f"not a path: {path!r}")
        parts.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end()
    if not parts:
        raise ValueError("a path has at least one part")
    return tuple(parts)


def shown(parts: Sequence[str | int]) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in parts).removeprefix(".")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value as a variable, so that expressions in which it stands several times stay small."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))  # transform looks at how many parameters a function has


def key_of(value: Column, key: str) -> Column:
    """What a VARIANT object has under a key, or null."""
    if re.fullmatch(r"[\w .-]+", key):
        return F.try_variant_get(value, f"$['{key}']", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string, variant>"), F.lit(key))


def _broke(parts: Sequence, i: int, why: str | Column, kind: str) -> Column:
    start = F.lit(f"path {shown(parts)!r} broke at {shown(parts[i : i + 1])!r}: ")
    return F.raise_error(F.concat(start, why if isinstance(why, Column) else F.lit(why))).cast(kind)


def _step(value: Column, parts: Sequence, i: int, strict: bool) -> Column:
    """One part of a path; value is a variable."""
    part, before = parts[i], shown(parts[:i]) or "the value"
    if isinstance(part, str):
        if not strict:
            return key_of(value, part)
        is_map = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return let(key_of(value, part), lambda found: F.when(~is_map, _broke(parts, i, f"{before} is not a mapping", "variant")).when(found.isNull(), _broke(parts, i, "key is missing", "variant")).otherwise(found))

    def item(items: Column) -> Column:
        found = F.get(items, F.lit(part) if part >= 0 else F.size(items) + part)
        if not strict:
            return found
        inside = (F.size(items) > part) if part >= 0 else (F.size(items) >= -part)
        said = F.concat(F.lit(f"{before} has "), F.size(items).cast("string"), F.lit(" items"))
        return F.when(items.isNull(), _broke(parts, i, f"{before} is not a list", "variant")).when(~inside, _broke(parts, i, said, "variant")).otherwise(found)

    return let(F.try_variant_get(value, "$", "array<variant>"), item)


def _in_variant(value: Column, parts: Sequence, first: int, strict: bool) -> Column:
    for i in range(first, len(parts)):
        value = let(value, lambda v, i=i: _step(v, parts, i, strict))
    return value


def value_at(value: Column, schema: T.DataType, path: str | Sequence[str | int], kind: str | None = None, *, strict: bool = True, _named: Sequence = ()) -> Column:
    """What stands at the path below `value`, a column of type `schema`, cast to `kind`. A text is read as JSON. A null on the way is missing; at the end it
    is a value."""
    parts = (*_named, *parse(path))
    for i in range(len(_named), len(parts)):
        part, before = parts[i], shown(parts[:i]) or "the value"
        if isinstance(schema, (T.VariantType, T.StringType)):
            held = value if isinstance(schema, T.VariantType) else F.try_parse_json(value)
            if strict:
                held = F.when(held.isNull(), _broke(parts, i, f"{before} is not a mapping or list", "variant")).otherwise(held)
            found = _in_variant(held, parts, i, strict)
            return found if kind is None else (F.variant_get if strict else F.try_variant_get)(found, "$", kind)
        ddl = schema.simpleString
        if isinstance(schema, T.StructType) and isinstance(part, str):
            if part not in schema.fieldNames():
                raise ValueError(f"path {shown(parts)!r} broke at {part!r}: {before} has no such field")
            found, inner, missing = value.getField(part), schema[part].dataType, value.isNull()
        elif isinstance(schema, T.MapType) and isinstance(part, str):
            found, inner, missing = F.try_element_at(value, F.lit(part)), schema.valueType, ~F.coalesce(F.map_contains_key(value, F.lit(part)), F.lit(False))
        elif isinstance(schema, T.ArrayType) and isinstance(part, int):
            found, inner = F.get(value, F.lit(part) if part >= 0 else F.size(value) + part), schema.elementType
            missing = value.isNull() | ((F.size(value) <= part) if part >= 0 else (F.size(value) < -part))
        else:
            raise ValueError(f"path {shown(parts)!r} broke at {shown([part])!r}: {before} is {ddl()}")
        if strict:
            found = F.when(missing, _broke(parts, i, "it is missing", inner.simpleString())).otherwise(found)
        value, schema = found, inner
    return value if kind is None else value.cast(kind)


def column_at(df: DataFrame, path: str | Sequence[str | int], kind: str | None = None, *, strict: bool = True) -> Column:
    """As value_at, with a column's name as the path's first part."""
    parts = parse(path)
    if not isinstance(parts[0], str) or parts[0] not in df.columns:
        raise ValueError(f"path {shown(parts)!r} broke at {shown(parts[:1])!r}: there is no such column")
    whole = F.col(f"`{parts[0]}`")
    if len(parts) == 1:
        return whole if kind is None else whole.cast(kind)
    return value_at(whole, df.schema[parts[0]].dataType, parts[1:], kind, strict=strict, _named=parts[:1])


def items_at(df: DataFrame, path: str | Sequence[str | int], kind: str = "variant", *, keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """(kept columns, pos, item): a row for each item of the list at the path, in place of the whole value."""
    return df.select(*(F.col(f"`{c}`") for c in keep), F.posexplode(column_at(df, path, f"array<{kind}>", strict=strict)).alias("pos", "item"))


def projected(df: DataFrame, fields: dict[str, str | Sequence[str | int]]) -> DataFrame:
    """A view that has what stands at each path, by name."""
    return df.select(*(column_at(df, path).alias(name) for name, path in fields.items()))
