"""Cached batches of model calls, their keys and gates, and the bounded repair of responses that aren't valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import sha
from ..functions.text import REPAIR_ECHO, REPAIR_PREAMBLE, REPAIR_ROUND, REPAIR_STUCK

MESSAGE = "struct<role:string,content:string>"


class DryRunError(RuntimeError):
    """A dry run would have called the model."""


class RepairExhausted(ValueError):
    """Responses that stayed invalid to the last round."""


def request_key(*parts: Column) -> Column:
    return sha(F.concat_ws("\x1f", *parts))


def call_key(messages: Column, *, model: str, seed: int | None = None, transport: str = "", response: str = "") -> Column:
    """The key of a call: its messages, model, seed, transport and response specification."""
    return sha(F.concat_ws("\x1f", F.to_json(messages), F.lit(model), F.lit("" if seed is None else str(seed)), F.lit(transport), F.lit(response)))


def gate(text: Column, finish: Column) -> Column:
    """truncated, empty or kept. Only kept responses may be cached."""
    return F.when(finish == "length", "truncated").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise("kept")


def call_batch(requests: DataFrame, cache: DataFrame, send: Callable[[DataFrame], DataFrame], *, dry: bool = False) -> DataFrame:
    """requests (with key) with response and `cached`. Equal keys are sent once; send maps distinct missing rows to (key, response).

    dry: misses are not sent; their response is null."""
    known = requests.join(cache.select("key", F.col("response").alias("__held")), "key", "left")
    if dry:
        return known.withColumn("cached", F.col("__held").isNotNull()).withColumnRenamed("__held", "response")
    fresh = send(known.where("__held IS NULL").drop("__held").dropDuplicates(["key"])).select("key", F.col("response").alias("__new"))
    done = known.join(fresh, "key", "left")
    return done.select(*requests.columns, F.coalesce("__held", "__new").alias("response"), F.col("__held").isNotNull().alias("cached"))


def require_cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached responses; an error that names some keys where any is missing."""
    found = call_batch(requests, cache, lambda df: df, dry=True)
    missing = found.where("NOT cached").select("key").distinct().orderBy("key").limit(5).collect()
    if missing:
        raise DryRunError("not cached: " + ", ".join(r.key for r in missing))
    return found


def observed(done: DataFrame, *, model: str, key: str = "key", prompt: str = "text") -> DataFrame:
    """(key, model, cache, prompt_sha): what a batch called, a row for each request."""
    return done.select(F.col(key).alias("key"), F.lit(model).alias("model"), F.when(F.col("cached"), "hit").otherwise("miss").alias("cache"), sha(F.col(prompt)).alias("prompt_sha"))


def correction(error: Column, raw: Column, round_: int, stuck: Column, *, reminder: str | None = None, echo: bool = True) -> Column:
    """What the model is told after an invalid response."""
    parts = [F.lit(REPAIR_PREAMBLE), error, F.lit(REPAIR_ROUND.format(round_)), F.when(stuck, F.lit(REPAIR_STUCK))]
    if reminder is not None:
        parts.append(F.lit(reminder))
    if echo:
        parts.append(F.concat(F.lit(REPAIR_ECHO + "\n"), raw))
    return F.concat_ws("\n\n", *parts)  # leaves nulls out


def repair_loop(
    rows: DataFrame, key: str, messages: str, ask: Callable[[DataFrame, int], DataFrame], validate: Callable[[Column], Column], *, mode: str = "rebuild", max_repairs: int = 2,
    reminder: str | None = None, exhausted: str = "error", cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """rows with value, ok, rounds and `attempts` (round, raw, error, stuck).

    ask(df, round) maps (key, messages) to (key, response); validate(response) gives struct(value, error), error null where it is valid. Only
    rows that are still invalid are asked again, with a correction: `rebuild` appends it (and the response) to the first messages,
    `continue` to the whole exchange. max_repairs rounds are asked at most. exhausted: `error` fails the query with the last error, `keep`
    gives ok = false. cut is applied to each round's rows; pass one that writes and reads them so that nothing is asked twice."""
    if mode not in ("rebuild", "continue") or max_repairs < 0 or exhausted not in ("error", "keep"):
        raise ValueError("mode is rebuild or continue, exhausted error or keep, and max_repairs not negative")
    rest = [c for c in rows.columns if c not in (key, messages)]
    attempt = "array<struct<round:int,raw:string,error:string,stuck:boolean>>"
    open_ = rows.select(F.col(key).alias("__key"), F.struct(*rest).alias("__rest") if rest else F.lit(None).alias("__rest"), F.col(messages).cast(f"array<{MESSAGE}>").alias("__base"))
    open_ = open_.withColumn("__now", F.col("__base")).withColumn("__log", F.array().cast(attempt))
    done = []
    for r in range(max_repairs + 1):
        reply = ask(open_.select(F.col("__key").alias("key"), F.col("__now").alias("messages")), r).select(F.col("key").alias("__key"), F.col("response").alias("__raw"))
        seen = open_.join(reply, "__key", "left").withColumn("__v", validate(F.col("__raw")))
        wrong = F.col("__v")["error"].isNotNull()
        stuck = F.coalesce(F.element_at("__log", -1)["raw"] == F.col("__raw"), F.lit(False)) if r else F.lit(False)
        entry = F.struct(F.lit(r + 1).alias("round"), F.col("__raw").alias("raw"), F.col("__v")["error"].alias("error"), stuck.alias("stuck"))
        seen = cut(seen.withColumn("__log", F.when(wrong, F.concat("__log", F.array(entry).cast(attempt))).otherwise(F.col("__log"))).withColumn("__round", F.lit(r)))
        last = r == max_repairs
        done.append(seen if last else seen.where(~wrong))
        if last:
            break
        said = correction(F.col("__v")["error"], F.col("__raw"), r + 1, F.element_at("__log", -1)["stuck"], reminder=reminder, echo=mode == "rebuild")
        user = F.struct(F.lit("user").alias("role"), said.alias("content"))
        answer = F.struct(F.lit("assistant").alias("role"), F.col("__raw").alias("content"))
        more = F.concat("__base", F.array(user)) if mode == "rebuild" else F.concat("__now", F.array(answer, user))
        open_ = seen.where(wrong).withColumn("__now", more.cast(f"array<{MESSAGE}>")).drop("__raw", "__v", "__round")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    ok = F.col("__v")["error"].isNull()
    value = F.col("__v")["value"]
    if exhausted == "error":
        said = F.concat(F.lit(f"still invalid after {max_repairs} repairs, "), F.col("__key").cast("string"), F.lit(": "), F.col("__v")["error"])
        value = F.when(ok, value).otherwise(F.raise_error(said).cast(out.schema["__v"].dataType["value"].dataType))
    return out.select(F.col("__key").alias(key), *(F.col("__rest")[c].alias(c) for c in rest), value.alias("value"), ok.alias("ok"), F.col("__round").alias("rounds"), F.col("__log").alias("attempts"))


def repair(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], valid: Column, max_repairs: int = 2) -> DataFrame:
    """rows with response, rounds and ok: those whose response isn't valid are asked again, at most max_repairs times."""
    open_, done = rows, None
    for r in range(max_repairs + 1):
        state = attempt(open_, r).withColumn("rounds", F.lit(r)).withColumn("ok", F.coalesce(valid, F.lit(False)))
        part = state if r == max_repairs else state.where("ok")
        done = part if done is None else done.unionByName(part)
        open_ = state.where("NOT ok").select(*rows.columns)
    return done


def batches(requests: DataFrame, order: str, tokens: str, limit: int, groups: int = 64) -> DataFrame:
    """requests with a batch: consecutive ones by `order` within each of `groups` hash groups, so that a batch has about `limit` tokens."""
    from pyspark.sql import Window as W

    dealt = requests.withColumn("__group", F.pmod(F.xxhash64(order), F.lit(groups)))
    before = F.coalesce(F.sum(tokens).over(W.partitionBy("__group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("batch", F.concat_ws("-", F.col("__group").cast("string"), F.floor(before / limit).cast("string"))).drop("__group")
