"""Deterministic stand-ins for a model service, as steps over request rows (key, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scripted(requests: DataFrame, routes: list[tuple[str, str]]) -> DataFrame:
    """(key, response) by the first route whose marker is a whole line of the request; none is an error."""
    lines = F.split("text", "\n", -1)
    fits = F.array(*(F.when(F.array_contains(lines, marker), F.struct(F.lit(i).alias("i"), F.lit(reply).alias("reply"))) for i, (marker, reply) in enumerate(routes)))
    first = F.array_min(fits)
    return requests.select("key", F.when(first.isNull(), F.raise_error(F.concat(F.lit("no route for "), "key"))).otherwise(first["reply"]).alias("response"))


def matches(requests: DataFrame, tape: DataFrame) -> DataFrame:
    """requests (seq, key, text) with the recorded response and `same`: whether the tape has this request at this place."""
    both = requests.join(tape.select("seq", "request_sha", "response"), "seq", "left")
    return both.withColumn("same", F.coalesce(F.sha2("text", 256) == F.col("request_sha"), F.lit(False))).drop("request_sha")


def cassette(requests: DataFrame, tape: DataFrame) -> DataFrame:
    """(key, response) of requests (seq, key, text) from a tape (seq, request_sha, response); another request at a place is an error."""
    both = matches(requests, tape)
    return both.select("key", F.when(F.col("same"), F.col("response")).otherwise(F.raise_error(F.concat(F.lit("not the recorded request at "), F.col("seq").cast("string")))).alias("response"))
