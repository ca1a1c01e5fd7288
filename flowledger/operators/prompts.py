"""Stored prompt resolutions: sealed records, what is wrong with stored ones, and the limits of requests before they are sent.

A record is a JSON text with the fields of RECORD, its digest and, where a call was made of it, the call's lineage. The digest is
that of the canonical JSON of RECORD without the attachments' paths, so a file that moved leaves it as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonical_json, sha

#: The fields of a stored resolution and their types.
RECORD = {
    "prompt_resolution_schema": "INT",
    "spec": "STRING",
    "structure_digest": "STRING",
    "base": "STRUCT<name: STRING, digest: STRING>",
    "layers": "ARRAY<STRUCT<name: STRING, digest: STRING>>",
    "axes": "ARRAY<STRUCT<name: STRING, variant: STRING>>",
    "materials": "ARRAY<STRUCT<name: STRING, digest: STRING>>",
    "rendered": "STRUCT<sha256: STRING, bytes: BIGINT>",
    "messages": "ARRAY<STRUCT<role: STRING, parts: ARRAY<STRING>>>",
    "attachments": "ARRAY<STRUCT<path: STRING, content_hash: STRING, mime_type: STRING, size_bytes: BIGINT>>",
    "response_spec": "STRUCT<schema_sha256: STRING, format: STRING>",
}
DIGEST = "resolution_digest"
LINEAGE = {"base_resolution_digest": "STRING", "phase": "STRING", "repair_round": "INT"}
ROLES = ("system", "user", "assistant")
SCHEMA = 1


def digest(record: Column) -> Column:
    """Digest of a record (a struct with the fields of RECORD)."""
    files = F.transform(record["attachments"], lambda a: a.dropFields("path"))
    fields = {n: (files if n == "attachments" else record[n], t if n != "attachments" else t.replace("path: STRING, ", "")) for n, t in RECORD.items()}
    kind = T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, (_, t) in fields.items()])
    return sha(canonical_json(F.struct(*(c.cast(t).alias(n) for n, (c, t) in fields.items())), kind))


def sealed(df: DataFrame, record: str, into: str, *, phase: Column | None = None, repair_round: Column | None = None) -> DataFrame:
    """df with the stored JSON text of a record column; with a phase, also the lineage of the call that was made of it."""
    df = df.withColumn("__digest", digest(F.col(record)))
    fields = [F.col(record)[n].cast(t).alias(n) for n, t in RECORD.items()] + [F.col("__digest").alias(DIGEST)]
    if phase is not None:
        fields += [F.col("__digest").alias("base_resolution_digest"), phase.alias("phase"), repair_round.cast("int").alias("repair_round")]
    return df.withColumn(into, F.to_json(F.struct(*fields))).drop("__digest")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def problems(df: DataFrame, text: str, into: str = "problem") -> DataFrame:
    """df with what is wrong with the record in column `text`, or null: the first of schema, missing or extra fields (sorted,
    comma-joined), types, contents, digest and lineage. A text that isn't a JSON object has a wrong schema, as a null has."""
    names, ddl = sorted([*RECORD, DIGEST]), ", ".join(f"{n}: {t}" for n, t in {**RECORD, DIGEST: "STRING", **LINEAGE}.items())
    df = df.withColumns({"__keys": F.array_sort(F.json_object_keys(text)), "__v": F.try_parse_json(text), "__r": F.from_json(text, f"STRUCT<{ddl}>")})
    r, keys = F.col("__r"), F.col("__keys")
    part = lambda n: F.try_variant_get(F.col("__v"), f"$.{n}", "variant")
    wanted = {n: "OBJECT" if t.startswith("STRUCT") else t.split("<")[0].replace("INT", "BIGINT") for n, t in RECORD.items()} | {DIGEST: "STRING"}
    mistyped = F.filter(F.array(*(F.when(~_kind(part(n)).eqNullSafe(F.lit(k)), n) for n, k in sorted(wanted.items()))), lambda x: x.isNotNull())
    void = lambda c: F.coalesce(c == "", F.lit(True))
    lacks = lambda n, *fields: F.exists(r[n], lambda x: F.greatest(*(void(x[f]) for f in (*fields, fields[0]))))
    below = lambda c: F.coalesce(c < 0, F.lit(True))
    wrong = {
        "spec": void(r["spec"]), "structure_digest": void(r["structure_digest"]), "base": void(r["base"]["name"]) | void(r["base"]["digest"]), "layers": lacks("layers", "name", "digest"),
        "axes": lacks("axes", "name", "variant"), "materials": lacks("materials", "name", "digest"), "rendered": void(r["rendered"]["sha256"]) | below(r["rendered"]["bytes"]),
        "messages": F.exists(r["messages"], lambda m: F.coalesce(~m["role"].isin(*ROLES), F.lit(True)) | m["parts"].isNull()),
        "attachments": lacks("attachments", "path", "content_hash", "mime_type") | F.exists(r["attachments"], lambda a: below(a["size_bytes"])),
        "response_spec": void(r["response_spec"]["schema_sha256"]) | void(r["response_spec"]["format"]),
    }
    df = df.withColumns({
        "__missing": F.array_except(F.array(*(F.lit(n) for n in names)), keys), "__extra": F.array_except(keys, F.array(*(F.lit(n) for n in (*names, *LINEAGE)))), "__types": mistyped,
        "__wrong": F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in wrong.items())), lambda x: x.isNotNull()), "__digest": digest(r),
    })
    said, turn = F.size(F.array_intersect(keys, F.array(*(F.lit(n) for n in LINEAGE)))), r["repair_round"]
    rounds = F.when(r["phase"] == "primary", turn == 0).when(r["phase"] == "repair", turn > 0)
    listed = lambda label, c: F.concat(F.lit(label + ": "), F.array_join(c, ", "))
    found = (
        F.when(keys.isNull() | ~_kind(part("prompt_resolution_schema")).eqNullSafe(F.lit("BIGINT")) | ~r["prompt_resolution_schema"].eqNullSafe(F.lit(SCHEMA)), "schema")
        .when(F.size("__missing") > 0, listed("missing", F.col("__missing")))
        .when(F.size("__extra") > 0, listed("extra", F.col("__extra")))
        .when(F.size("__types") > 0, listed("types", F.col("__types")))
        .when(F.size("__wrong") > 0, listed("contents", F.col("__wrong")))
        .when(~r[DIGEST].eqNullSafe(F.col("__digest")), "digest")
        .when((said > 0) & (said < len(LINEAGE)), "incomplete lineage")
        .when((said > 0) & ~F.coalesce(rounds, F.lit(False)), "lineage of another round")
        .when((said > 0) & ~r["base_resolution_digest"].eqNullSafe(r[DIGEST]), "lineage of another record")
    )
    return df.withColumn(into, found).drop("__keys", "__v", "__r", "__missing", "__extra", "__types", "__wrong", "__digest")


@dataclass(frozen=True)
class Limits:
    """What a request may hold; checked before a cache or a provider sees it."""

    tokens: int = 200_000
    attachments: int = 50
    attachment_bytes: int = 100 * 1024 * 1024

    def __post_init__(self) -> None:
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in (self.tokens, self.attachments, self.attachment_bytes)):
            raise ValueError("limits are whole numbers from 0 up")


def over_limits(messages: DataFrame, attachments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(request_id, check, limit, actual) of each limit that a request exceeds; messages: request_id, text; attachments: request_id,
    size_bytes. Tokens are estimated as a quarter of the messages' bytes, rounded up. Both sides are combined before one shuffle."""
    rows = messages.select("request_id", F.octet_length("text").cast("long").alias("__text"), F.lit(None).cast("long").alias("__file"), F.lit(0).alias("__one"))
    rows = rows.unionByName(attachments.select("request_id", F.lit(None).cast("long").alias("__text"), F.col("size_bytes").cast("long").alias("__file"), F.lit(1).alias("__one")))
    sums = rows.groupBy("request_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("__text", "__file", "__one")))
    tokens = F.floor((F.col("__text") + 3) / 4).cast("long")
    checks = (("token_count", limits.tokens, tokens), ("attachment_count", limits.attachments, F.col("__one")), ("byte_size", limits.attachment_bytes, F.col("__file")))
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.lit(m).cast("long").alias("limit"), a.alias("actual")) for n, m, a in checks))
    return sums.select("request_id", F.inline(each)).where("actual > limit")
