"""Declared prompts over rows: a base text whose slots take fixed fragments, fragments that a value of the row chooses, and fenced material.

A declaration names values by typed paths into the row (`paths`), so what a prompt depends on is known before any row is read: `Prompt.paths` is
what a step has to consume. Prompt texts are those of a catalog, taken once. `resolve` is one projection, with a join by path for each material
that is a file; it gives each row its prompt, the record of what the prompt was made of, or what is wrong. A record belongs to its exact text:
`with_lineage` takes it away from a text that has since been changed.

Nulls: a value that is null or missing is a problem of its row, never an error of the query. Rows that repeat are resolved one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text
from ..functions.canon import canonical_json, sha
from ..functions.identity import digest
from ..sources import files as sources
from .prompts import RECORD, SCHEMA
from .prompts import digest as record_digest

# Names of prompts and slots, and kinds of files.
NAME = r"[a-z_][a-z0-9_]*"
KINDS = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "html": "text/html", "csv": "text/csv", "xml": "text/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg"}
OTHER_KIND = "application/octet-stream"
#: What all texts of a catalog may have in bytes: they are part of the plan.
MOST_BYTES = 4 << 20


class DeclarationError(ValueError):
    """A declaration that no row could make right."""


def _named(value: str, what: str) -> None:
    if not isinstance(value, str) or not re.fullmatch(NAME, value):
        raise DeclarationError(f"{what} matches {NAME}, unlike {value!r}")


def _referred(name: str) -> None:
    parts = name.split("/") if isinstance(name, str) else [""]
    if {"", ".", ".."} & set(parts) or "\\" in name or "\0" in name or name.endswith(".md"):
        raise DeclarationError(f"a prompt text is named by a relative path without .md, unlike {name!r}")


@dataclass(frozen=True)
class Choice:
    """A fragment chosen, among a finite number, by the text at a path of the row."""

    name: str
    by: str
    among: Mapping[str, str]

    def __post_init__(self) -> None:
        _named(self.name, "a choice's name")
        paths.parse(self.by)
        if not self.among or not all(isinstance(v, str) and v for v in self.among):
            raise DeclarationError(f"choice {self.name!r} has variants, none without a name")
        for ref in self.among.values():
            _referred(ref)


@dataclass(frozen=True)
class Material:
    """What stands at a path of the row, fenced; with `file`, the text of the file that this path names."""

    value: str
    title: str | None = None
    file: bool = False

    def __post_init__(self) -> None:
        paths.parse(self.value)
        if self.title is not None and not self.title.strip():
            raise DeclarationError("a title isn't empty")


@dataclass(frozen=True)
class Prompt:
    """One prompt: the base's slots, each with a fragment's name, a choice or a material."""

    name: str
    base: str
    layers: Mapping[str, str | Choice] = field(default_factory=dict)
    materials: Mapping[str, Material] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _named(self.name, "a prompt's name")
        _referred(self.base)
        for slot in (*self.layers, *self.materials):
            _named(slot, "a slot")
        for ref in self.layers.values():
            if not isinstance(ref, Choice):
                _referred(ref)
        if twice := sorted(self.layers.keys() & self.materials.keys()):
            raise DeclarationError(f"prompt {self.name!r} fills slots twice: {', '.join(twice)}")
        names = [c.name for c in self.choices()]
        if len(set(names)) < len(names):
            raise DeclarationError(f"prompt {self.name!r} has two choices of one name")

    def choices(self) -> list[Choice]:
        return [c for c in self.layers.values() if isinstance(c, Choice)]

    def refs(self) -> list[str]:
        """Names of all texts that the prompt may be made of."""
        made = [self.base]
        for layer in self.layers.values():
            made += layer.among.values() if isinstance(layer, Choice) else [layer]
        return list(dict.fromkeys(made))

    def paths(self) -> list[str]:
        """What of a row the prompt depends on."""
        return list(dict.fromkeys([c.by for c in self.choices()] + [m.value for m in self.materials.values()]))

    def structure(self) -> dict:
        """The declaration, without any text."""
        layers = {s: {"choice": v.name, "by": v.by, "among": dict(v.among)} if isinstance(v, Choice) else v for s, v in self.layers.items()}
        return {"name": self.name, "base": self.base, "layers": layers, "materials": {s: {"value": m.value, "title": m.title, "file": m.file} for s, m in self.materials.items()}}

    @property
    def structure_digest(self) -> str:
        return digest(self.structure())


def check(prompts: Iterable[Prompt], columns: Iterable[str], kind: str = "node") -> None:
    """Declarations of one step, against the columns that its rows have. `item` is there in maps and scans only, `carry` in scans only."""
    known, seen = set(columns), set()
    for p in prompts:
        if p.name in seen:
            raise DeclarationError(f"two prompts are named {p.name!r}")
        seen.add(p.name)
        for path in p.paths():
            first = paths.parse(path)[0]
            if first == "item" and kind not in ("map", "scan") or first == "carry" and kind != "scan":
                raise DeclarationError(f"prompt {p.name!r} uses {first!r} in a {kind}")
            if first not in known:
                raise DeclarationError(f"prompt {p.name!r} uses {first!r}, which the step's rows don't have")


class Catalog:
    """Prompt texts by name, as they were when they were taken. They are few and small, which is checked, and become literals of the plan."""

    def __init__(self, texts: Mapping[str, str]) -> None:
        self.texts = dict(texts)
        if sum(len(t.encode()) for t in self.texts.values()) > MOST_BYTES:
            raise DeclarationError(f"prompt texts have over {MOST_BYTES} bytes; long texts are material")

    @classmethod
    def of(cls, table: DataFrame, prompts: Iterable[Prompt]) -> Catalog:
        """From a table (name, text), of which only declared names are read, once their size is known."""
        names = sorted({n for p in prompts for n in p.refs()})
        rows = table.where(F.col("name").isin(names)).select("name", "text").distinct()
        size, nulls, most = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("text").isNull()), F.count(F.lit(1))).first()
        if nulls or most > len(names):
            raise DeclarationError("a prompt text isn't null, and there is one for each name")
        if size > MOST_BYTES:
            raise DeclarationError(f"prompt texts have over {MOST_BYTES} bytes; long texts are material")
        held = {r.name: r.text for r in rows.collect()}
        if missing := [n for n in names if n not in held]:
            raise DeclarationError(f"no such prompt text: {', '.join(missing)}")
        made = cls(held)
        for p in prompts:
            made.check(p)
        return made

    @classmethod
    def read(cls, spark: SparkSession, root: str, prompts: Iterable[Prompt]) -> Catalog:
        """From files `name.md` below a folder, which have to be UTF-8."""
        prompts = list(prompts)
        found = sources.scan(spark, root, [f"{n}.md" for p in prompts for n in p.refs()])
        decoded = F.col("content").cast("string")
        return cls.of(found.select(F.regexp_replace("path", r"\.md$", "").alias("name"), F.when(F.is_valid_utf8(decoded), decoded).alias("text")), prompts)

    def check(self, p: Prompt) -> None:
        """The base's slots are those declared, and fragments have none."""
        if missing := [n for n in p.refs() if n not in self.texts]:
            raise DeclarationError(f"no such prompt text: {', '.join(missing)}")
        asked, given = set(re.findall(text.SLOT, self.texts[p.base])), p.layers.keys() | p.materials.keys()
        if asked != given:
            raise DeclarationError(f"prompt {p.name!r}: not declared: {', '.join(sorted(asked - given))}; not in the base: {', '.join(sorted(given - asked))}")
        for ref in p.refs()[1:]:
            if re.search(text.SLOT, self.texts[ref]):
                raise DeclarationError(f"fragment {ref!r} has a slot")

    def declaration(self, p: Prompt) -> str:
        """Digest of a declaration with all its texts, chosen or not: what a run that is taken up again must find unchanged."""
        return digest([p.structure(), {n: self.texts[n] for n in p.refs()}])


def _typed(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    found = paths.column_at(df, path, strict=False)
    return found, df.select(found).schema[0].dataType


def _text_at(df: DataFrame, path: str) -> Column:
    """The text at a path; null where there is none or something else."""
    found, kind = _typed(df, path)
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))
    return found if isinstance(kind, T.StringType) else F.lit(None).cast("string")


def _block_at(df: DataFrame, path: str, title: str | None) -> Column:
    """What stands at a path, fenced: texts as they are, typed values as canonical JSON."""
    found, kind = _typed(df, path)
    if isinstance(kind, (T.StringType, T.VariantType)):
        return text.inject(_text_at(df, path), title=title)
    return F.when(found.isNotNull(), text.inject(canonical_json(found, kind), lang="json", title=title))


def _with_files(df: DataFrame, slot: str, m: Material, files: DataFrame | None) -> DataFrame:
    """df with __path, and of the file that it names __slot (its fenced text, null unless UTF-8) and __file (digest and size). Files are read and
    digested once each, before the join, however many rows name them."""
    if files is None:
        raise DeclarationError(f"material {slot!r} is a file, but no files are given")
    held = files.where("path IS NOT NULL AND content IS NOT NULL").select(F.col("path").alias("__held"), "content").dropDuplicates(["__held"])
    decoded, raw = F.col("content").cast("string"), F.col("content")
    block = F.when(F.is_valid_utf8(decoded), text.inject(decoded, title=m.title))
    held = held.select("__held", block.alias(f"__slot_{slot}"), F.struct(sha(raw).alias("sha"), F.octet_length(raw).cast("long").alias("bytes")).alias(f"__file_{slot}"))
    df = df.withColumn(f"__path_{slot}", _text_at(df, m.value))
    return df.join(held, F.col(f"__path_{slot}") == F.col("__held"), "left").drop("__held")


def _mime(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(OTHER_KIND))


def resolve(df: DataFrame, p: Prompt, catalog: Catalog, *, files: DataFrame | None = None, into: str = "prompt") -> DataFrame:
    """df with `prompt` (the text), `prompt_record` (a struct with the fields of a stored resolution, for `prompts.sealed`) and `prompt_problem`; the
    first two are null where the last isn't. files: (path, content) of what file materials may name; of rows with one path, any one is taken.
    Only chosen fragments are in the record, so a change of another variant leaves it as it is."""
    catalog.check(p)
    before, problem, null = df.columns, F.lit(None).cast("string"), F.lit(None).cast("string")
    layers, axes, materials, attached = [], [], [], []
    pair = lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))
    for slot, layer in p.layers.items():
        if not isinstance(layer, Choice):
            df = df.withColumn(f"__slot_{slot}", F.lit(catalog.texts[layer]))
            layers.append(pair(name=F.lit(layer), digest=sha(F.lit(catalog.texts[layer]))))
            continue
        df = df.withColumn(f"__by_{slot}", _text_at(df, layer.by))
        by, ref, body = F.col(f"__by_{slot}"), null, null
        for variant, name in sorted(layer.among.items()):
            ref, body = F.when(by == variant, name).otherwise(ref), F.when(by == variant, catalog.texts[name]).otherwise(body)
        df = df.withColumns({f"__slot_{slot}": body, f"__ref_{slot}": ref})
        layers.append(pair(name=F.col(f"__ref_{slot}"), digest=sha(F.col(f"__slot_{slot}"))))
        axes.append(pair(name=F.lit(layer.name), variant=by))
        unknown = F.concat(F.lit(f"choice {layer.name}: unknown variant "), by)
        problem = F.coalesce(problem, F.when(by.isNull(), f"choice {layer.name}: no text").when(F.col(f"__slot_{slot}").isNull(), unknown))
    for slot, m in p.materials.items():
        if m.file:
            df = _with_files(df, slot, m, files)
            path, file, said = F.col(f"__path_{slot}"), F.col(f"__file_{slot}"), lambda what, path, slot=slot: F.concat(F.lit(f"material {slot}: {what} "), path)
            attached.append(pair(path=path, content_hash=file["sha"], mime_type=_mime(path), size_bytes=file["bytes"]))
            why = F.when(path.isNull(), f"material {slot}: no path").when(file.isNull(), said("no file", path)).when(F.col(f"__slot_{slot}").isNull(), said("not UTF-8:", path))
        else:
            df = df.withColumn(f"__slot_{slot}", _block_at(df, m.value, m.title))
            why = F.when(F.col(f"__slot_{slot}").isNull(), f"material {slot}: no value")
        materials.append(pair(name=F.lit(slot), digest=sha(F.col(f"__slot_{slot}"))))
        problem = F.coalesce(problem, why)
    pieces = re.split(text.SLOT, catalog.texts[p.base])
    filled = F.concat(*(F.col(f"__slot_{x}") if i % 2 else F.lit(x) for i, x in enumerate(pieces)))
    df = df.withColumn(f"{into}_problem", problem).withColumn(into, F.when(F.col(f"{into}_problem").isNull(), filled))
    whole = F.col(into)
    parts = {
        "prompt_resolution_schema": F.lit(SCHEMA), "spec": F.lit(p.name), "structure_digest": F.lit(p.structure_digest), "base": pair(name=F.lit(p.base), digest=sha(F.lit(catalog.texts[p.base]))),
        "layers": F.array(*layers), "axes": F.array(*axes), "materials": F.array(*materials), "rendered": pair(sha256=sha(whole), bytes=F.octet_length(whole).cast("long")),
        "messages": F.array(pair(role=F.lit("user"), parts=F.array(whole))), "attachments": F.array(*attached), "response_spec": pair(schema_sha256=sha(F.lit("{}")), format=F.lit("text")),
    }
    record = F.struct(*(parts[n].cast(t).alias(n) for n, t in RECORD.items()))
    made = df.withColumn(f"{into}_record", F.when(whole.isNotNull(), record))
    return made.select(*(F.col(f"`{c}`") for c in before if c not in (into, f"{into}_record", f"{into}_problem")), into, f"{into}_record", f"{into}_problem")


def with_lineage(df: DataFrame, prompt: str = "prompt", record: str | None = None) -> DataFrame:
    """df whose records stay only beside the very texts that they were made with; a text that was changed in any way has none."""
    record = record or f"{prompt}_record"
    same = sha(F.col(prompt)) == F.col(record)["rendered"]["sha256"]
    return df.withColumn(record, F.when(same, F.col(record)))


def resolution_digest(record: str = "prompt_record") -> Column:
    """The digest under which a record is stored; null without one."""
    return F.when(F.col(record).isNotNull(), record_digest(F.col(record)))
