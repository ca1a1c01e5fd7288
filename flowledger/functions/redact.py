"""Redaction of JSON and nested columns by structure: contents become digests, other values stay, all in expressions that Spark compiles.

JSON's shape isn't known beforehand: one aggregation finds the union of all rows' shapes, from which the rewriting is built. Where values differ in
kind at a place (an object in one row or list item, a number in another), one more aggregation finds the shapes of that place's objects and lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import canonical_struct, json_string, sha
from .paths import key_of, let

#: Keys (in lower case, with _ for -) whose values are contents.
CONTENT_KEYS = ("arguments", "content", "input", "inputs", "output", "outputs", "prompt", "reasoning", "reasoning_content", "text", "thinking", "thinking_content")

_TOKEN = re.compile(r"\s*(OBJECT<|ARRAY<|>|,|:|`(?:[^`]|``)*`|[A-Za-z_][\w]*(?:\([\d, ]+\))?)")


def shape_of(ddl: str):
    """A shape of an aggregated variant schema: ('object', {key: shape}), ('array', shape), or ('value', name)."""
    tokens = [m[1] for m in _TOKEN.finditer(ddl)]
    at = 0

    def one():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "ARRAY<":
            inner = one()
            at += 1
            return "array", inner
        if token == "OBJECT<":
            fields = {}
            while tokens[at] != ">":
                if tokens[at] == ",":
                    at += 1
                name = tokens[at].strip("`").replace("``", "`") if tokens[at].startswith("`") else tokens[at]
                at += 2
                fields[name] = one()
            at += 1
            return "object", fields
        return "value", token

    return one()


def _shape(values: DataFrame):
    """The shape of a column `v` of variants; ('mixed', shape of its objects, shape of its lists) where they differ in kind."""
    found = values.where("v IS NOT NULL").agg(F.schema_of_variant_agg("v")).first()[0]
    return _filled(values, shape_of(found) if found else ("value", "VOID"))


def _filled(values: DataFrame, shape):
    if shape == ("value", "VARIANT"):
        kind = F.schema_of_variant("v")
        return "mixed", *(_shape(values.where(kind.startswith(k))) for k in ("OBJECT", "ARRAY"))
    if shape[0] == "array":
        return "array", _filled(values.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")), shape[1])
    if shape[0] == "object":
        return "object", {k: _filled(values.select(key_of(F.col("v"), k).alias("v")), s) for k, s in shape[1].items()}
    return shape


def redacted(content: Column, **more: tuple[Column, str]) -> Column:
    """The object that stands for a content (canonical JSON or other text): its digest and number of bytes."""
    return let(content, lambda c: canonical_struct(redacted=(F.lit(True), "boolean"), sha256=(sha(c), "string"), bytes=(F.octet_length(c), "bigint"), **more))


def _nested(text: Column, depth: int) -> Column:
    """Canonical JSON moved in by some levels."""
    return F.replace(text, F.lit("\n"), F.lit("\n" + "  " * depth)) if depth else text


def _render(value: Column, shape, depth: int, keys: frozenset, strings: Callable[[Column], Column]) -> Column:
    inner, outer, kind = "  " * (depth + 1), "  " * depth, shape[0]
    if kind == "object":
        fields = []
        for name in sorted(shape[1]):
            child = key_of(value, name)
            content = name.lower().replace("-", "_") in keys

            def field(c: Column, name=name, content=content) -> Column:
                if content:
                    said = _nested(redacted(_render(c, shape[1][name], 0, frozenset(), lambda x: x)), depth + 1)
                else:
                    said = _render(c, shape[1][name], depth + 1, keys, strings)
                return F.when(c.isNotNull(), F.concat(F.lit(inner), json_string(F.lit(name)), F.lit(": "), said))

            fields.append(let(child, field))
        there = F.filter(F.array(*fields), lambda f: f.isNotNull()) if fields else F.array().cast("array<string>")
        body = let(F.array_join(there, ",\n"), lambda t: F.when(t == "", "{}").otherwise(F.concat(F.lit("{\n"), t, F.lit(f"\n{outer}}}"))))
    elif kind == "array":
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.concat(F.lit(inner), _render(x, shape[1], depth + 1, keys, strings)))
        body = let(F.array_join(items, ",\n"), lambda t: F.when(t == "", "[]").otherwise(F.concat(F.lit("[\n"), t, F.lit(f"\n{outer}]"))))
    elif kind == "mixed":
        is_a = F.schema_of_variant(value)
        body = F.when(is_a.startswith("OBJECT"), _render(value, shape[1], depth, keys, strings)).when(is_a.startswith("ARRAY"), _render(value, shape[2], depth, keys, strings)).otherwise(_render(value, ("value", ""), depth, keys, strings))
    else:
        is_text = F.schema_of_variant(value) == "STRING"
        plain = F.when(is_text, json_string(strings(F.try_variant_get(value, "$", "string")))).otherwise(F.to_json(value))
        body = plain
    return F.when(F.is_variant_null(value), "null").otherwise(body)


def _parsed(text: Column, shape, keys: frozenset, strings: Callable[[Column], Column], other: Column) -> Column:
    return let(F.try_parse_json(text), lambda value: F.when(value.isNull(), other).otherwise(_render(value, shape, 0, keys, strings)))


def redact_json(df: DataFrame, column: str, name: str, *, lines: bool = False, keys=CONTENT_KEYS, strings: Callable[[Column], Column] = lambda c: c, media_type: str = "application/json") -> DataFrame:
    """df with `name`: the column's JSON (or JSON lines) in canonical form, each value under one of `keys`, at any depth, in the form of `redacted`, and each other text
    through `strings` (a scrubber). What isn't JSON is redacted whole: a line by itself, a text with its media type. Nulls stay null, null lines don't occur."""
    text = F.col(f"`{column}`")
    if lines:
        whole = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n$", "")
        split = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))
        probe = df.select(F.explode(split).alias("l")).select(F.try_parse_json("l").alias("v"))
    else:
        probe = df.select(F.try_parse_json(text).alias("v"))
    shape, wanted = _shape(probe), frozenset(keys)
    if lines:
        each = F.transform(split, lambda t: _parsed(t, shape, wanted, strings, redacted(t)))
        return df.withColumn(name, F.when(text.isNull(), None).when(F.size(split) == 0, "").otherwise(F.concat(F.array_join(each, "\n"), F.lit("\n"))))
    other = redacted(text, media_type=(F.lit(media_type), "string"))
    return df.withColumn(name, F.when(text.isNotNull(), _parsed(text, shape, wanted, strings, other)))
