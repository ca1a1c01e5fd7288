"""Text that tells a model the shape of the JSON it has to give: fields of a StructType, and an example."""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Wordings of the section.
HEAD, FIELDS, EXAMPLE = "输出格式", "字段：", "示例："
REQUIRED, OPTIONAL, UNDESCRIBED = "必填", "可选", "无描述"
JSON_ONLY = "只输出一个 JSON 对象；不要输出解释、前后缀或代码围栏。"
_NAMES = {"string": "str", "boolean": "bool", "double": "float", "float": "float", "void": "None"}
_EXAMPLES = {"string": "<string>", "boolean": False, "double": 0.0, "float": 0.0, "void": None}


def label(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"list[{label(kind.elementType)}]"
    if isinstance(kind, T.MapType):
        return f"dict[{label(kind.keyType)}, {label(kind.valueType)}]"
    if isinstance(kind, T.StructType):
        return "object"
    return "int" if isinstance(kind, T.IntegralType) else _NAMES.get(kind.simpleString(), kind.simpleString())


def example(kind: T.DataType):
    if isinstance(kind, T.StructType):
        return {f.name: example(f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [example(kind.elementType)]
    if isinstance(kind, T.MapType):
        return {}
    return 0 if isinstance(kind, T.IntegralType) else _EXAMPLES.get(kind.simpleString(), "<value>")


def schema_section(kind: T.StructType, *, with_example: bool = True) -> str:
    """A nullable field is optional; metadata `choices` lists the values of an enumeration, and the comment describes the field."""
    lines = [f"## {HEAD}", "", FIELDS]
    shown = {}
    for f in kind.fields:
        choices = f.metadata.get("choices")
        name = " | ".join(map(repr, choices)) if choices else label(f.dataType)
        if f.nullable and f.metadata.get("or_null"):
            name += " | None"
        lines.append(f"- `{f.name}`：`{name}`；{OPTIONAL if f.nullable else REQUIRED}；{f.metadata.get('comment') or UNDESCRIBED}")
        shown[f.name] = choices[0] if choices else example(f.dataType)
    if with_example:
        lines += ["", EXAMPLE, "```json", json.dumps(shown, ensure_ascii=False, indent=2), "```", ""]
    return "\n".join([*lines, JSON_ONLY, ""])
