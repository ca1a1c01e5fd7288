"""Deterministic text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canon import canonical_json, sha

# Wordings and patterns that results contain or follow.
TITLE = "## {}\n\n"
CLIPPED = ("(已截断：原文 ", " 字，保留 ", " 字)")
CUT = "（已截断）"
SLOT = r"\{\{([a-z_][a-z0-9_]*)\}\}"
SENTENCE_END = "[。！？.!?]"
BEARER = r"(?i)\b(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]+"
REPAIR_ECHO = "你上一轮的输出如下："
REPAIR_PREAMBLE, REPAIR_ROUND, REPAIR_STUCK = "上次输出未通过校验。下面是错误：", "这是第 {} 轮修复。", "检测到输出与上次完全相同；请逐项修正错误，不得原样重交。"


def fence(body: Column) -> Column:
    """Backticks, at least three, and one more than the longest run in the body."""
    runs = F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def inject(body: Column, *, lang: str = "", title: str | None = None) -> Column:
    """The body in a fenced block, under a title if one is given."""
    mark = fence(body)
    return F.concat(F.lit(TITLE.format(title) if title is not None else ""), mark, F.lit(lang + "\n"), body, F.lit("\n"), mark, F.lit("\n"))


def section(title: str, value: Column) -> Column:
    text = F.concat(F.lit(TITLE.format(title)), value)
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, "").otherwise(F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))))


def slot_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SLOT), F.lit(1)))


def slots_match(text: Column, supplied: Column) -> Column:
    """struct(missing, extra): what a template asks for and isn't given, and the reverse, both sorted."""
    names = slot_names(text)
    return F.struct(F.array_sort(F.array_except(names, supplied)).alias("missing"), F.array_sort(F.array_except(supplied, names)).alias("extra"))


def render_template(text: Column, slots: Column) -> Column:
    """The template with its slots filled from a map, in one pass: filled text is not searched again.

    The map has to have exactly the template's slots, none null; anything else is an error that names them."""
    wrong = slots_match(text, F.map_keys(slots))
    nulls = F.array_sort(F.map_keys(F.map_filter(slots, lambda _, v: v.isNull())))
    said = F.concat(F.lit("slots missing: "), F.array_join(F.array_union(wrong["missing"], nulls), ", "), F.lit("; not in the template: "), F.array_join(wrong["extra"], ", "))
    filled = _filled(text, slots)
    bad = (F.size(wrong["missing"]) + F.size(wrong["extra"]) + F.size(nulls)) > 0
    return F.when(text.isNull() | slots.isNull(), F.lit(None).cast("string")).when(bad, F.raise_error(said)).otherwise(filled)


def _filled(text: Column, slots: Column) -> Column:
    between = F.split(text, SLOT, -1)
    names = F.regexp_extract_all(text, F.lit(SLOT), F.lit(1))
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.when(i < F.size(names), F.element_at(slots, F.get(names, i))).otherwise(""))), "")


def clip(text: Column, limit: int, boundary: str = "line") -> Column:
    """struct(text, clipped, original_chars, kept_chars): cut after the last line or sentence end within the limit, else hard; cuts are disclosed."""
    if limit < 0 or boundary not in ("line", "sentence"):
        raise ValueError("limit must not be negative; boundary is line or sentence")
    prefix, n = F.substring(text, 1, limit), F.length(text)
    found = F.regexp_extract(prefix, r"(?s)^(.*\n)" if boundary == "line" else f"(?s)^(.*{SENTENCE_END})", 1)
    kept = F.when(found == "", prefix).otherwise(found)
    gap = F.when((kept == "") | kept.endswith("\n"), "").otherwise("\n")
    noted = F.concat(kept, gap, F.lit(CLIPPED[0]), n.cast("string"), F.lit(CLIPPED[1]), F.length(kept).cast("string"), F.lit(CLIPPED[2]))
    return F.struct(F.when(n <= limit, text).otherwise(noted).alias("text"), (n > limit).alias("clipped"), n.alias("original_chars"), F.when(n <= limit, n).otherwise(F.length(kept)).alias("kept_chars"))


def render_bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), F.replace(x, F.lit("\n"), F.lit("\n  ")))), "\n")


def render_items(items: Column, kind, form: str = "json") -> Column:
    """A list as canonical JSON (kind is the list's type) or as bullets."""
    if form not in ("json", "bullets"):
        raise ValueError("form is json or bullets")
    return canonical_json(items, kind) if form == "json" else render_bullets(items)


def inject_object(value: Column, kind, *, title: str | None = None) -> Column:
    """Any value as canonical JSON in a fenced block that is tagged json."""
    return inject(canonical_json(value, kind), lang="json", title=title)


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_cell(text: Column) -> Column:
    """A cell of a Markdown table."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def strip_json_fence(raw: Column) -> Column:
    """Without a surrounding three-backtick fence (plain or tagged json), else as it is."""
    lines = F.split(F.regexp_replace(raw, r"^\s+|\s+$", ""), "\\n", -1)
    plain = F.transform(lines, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    fenced = (F.size(lines) >= 2) & F.element_at(plain, 1).isin("```", "```json") & (F.element_at(plain, -1) == "```")
    return F.when(fenced, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(raw)


def extract_fenced(raw: Column) -> Column:
    """What stands between the first and the last fence line, stripped; null with fewer than two."""
    found = F.regexp_extract(raw, r"(?s)^(?:.*?\n)??```[^\n]*(\n.*)(?<=\n)```[^\n]*(?:\n(?!.*(?<=\n)```).*)?$", 1)
    count = F.size(F.regexp_extract_all(raw, F.lit("(?m)(^```[^\n]*$)"), F.lit(1)))
    return F.when(count >= 2, F.regexp_replace(found, r"^\s+|\s+$", ""))


def scrub_bearer(text: Column) -> Column:
    return F.regexp_replace(text, BEARER, "***")


def scrub_values(text: Column, secrets: list[str]) -> Column:
    """Known secrets replaced, the longest first."""
    for s in sorted(secrets, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def preflight_tokens(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def budget_tokens(chars: Column, allowance: int = 0) -> Column:
    """Two tokens for each whole four characters, at least one, and the output allowance."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4).cast("long") * 2) + allowance


def mermaid_label(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit("<br/>"))


def mermaid_id(name: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(sha(name), 1, 12))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def example_summary(canonical: Column) -> Column:
    return F.when(F.length(canonical) <= 500, canonical).otherwise(F.concat(F.substring(canonical, 1, 500), F.lit(CUT)))


def jitter_fraction(run_id: Column, target: Column, attempt: Column, digest: Column) -> Column:
    """The first 64 bits of a digest as a fraction of 2^64. The parts are joined by a backslash and a zero."""
    held = sha(F.concat_ws("\\0", run_id, target, attempt.cast("string"), digest))
    return F.conv(F.substring(held, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64
