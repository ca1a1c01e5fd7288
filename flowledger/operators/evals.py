"""Evaluation: gated judgments, variant grids, Pareto selection and leak checks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import sha
from ..functions.rolling import anchors, share_window
from .skyline import skyline

#: So many texts at most are in a Python worker at a time, whatever the size of the tables.
TEXTS = 200


def gated(gate: Column, quality: Column, gate_tags: Column, quality_tags: Column) -> Column:
    """The gate's judgment where it isn't passed in full, else the quality score with both sets of tags."""
    failed = F.struct(gate.alias("score"), gate_tags.alias("tags"))
    return F.when(gate < 1, failed).otherwise(F.struct(quality.alias("score"), F.concat(gate_tags, quality_tags).alias("tags")))


def grid(variants: DataFrame, examples: DataFrame, seeds: list[int]) -> DataFrame:
    """A row for each variant, example and seed. Variants and seeds are declared lists, so they multiply the examples by a fixed number."""
    tried = variants.withColumn("seed", F.explode(F.lit(seeds)))
    return examples.crossJoin(F.broadcast(tried))


def summary(trials: DataFrame, threshold: float) -> DataFrame:
    return trials.groupBy("variant").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("stdev"), F.avg((F.col("score") >= threshold).cast("double")).alias("pass_rate"))


def pareto(scores: DataFrame, key: str, metrics: list[str], shorter: str) -> DataFrame:
    """Rows that no other row dominates: as good in all metrics and better in one, or equal in all and shorter. Rows with a null metric are left out."""
    front = skyline(scores, metrics)
    best = scores.groupBy(*metrics).agg(F.min(shorter).alias("__short")).join(front, metrics)
    return scores.join(best, metrics).where(F.col(shorter).eqNullSafe(F.col("__short"))).select(key, *metrics)


def evaluate(examples: DataFrame, task: Callable[[dict], object], metric: Callable[[dict, object], tuple], key: str) -> DataFrame:
    """(key, score, feedback, tags) of each example (a row as a dict). task makes an output, metric(example, output) gives (score, feedback,
    tags). An exception of either is a score of 0 with its text as feedback and the tag task_error or metric_error, and never
    ends the batch; so is a score outside 0 to 1."""
    kind = examples.schema[key].dataType.simpleString()

    def judged(example: dict) -> tuple[float, str, list[str]]:
        try:
            output = task(example)
        except Exception as e:  # noqa: BLE001 - becomes the example's result
            return 0.0, f"{type(e).__name__}: {e}", ["task_error"]
        try:
            score, feedback, tags = metric(example, output)
            return in_range(float(score)), str(feedback), [str(t) for t in tags]
        except Exception as e:  # noqa: BLE001
            return 0.0, f"{type(e).__name__}: {e}", ["metric_error"]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            done = [judged(r) for r in rows]
            cols = [batch.column(batch.schema.get_field_index(key)), pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "score", "feedback", "tags"])

    return examples.mapInArrow(run, f"key {kind}, score double, feedback string, tags array<string>").withColumnRenamed("key", key)


def in_range(score: float) -> float:
    if not 0.0 <= score <= 1.0:
        raise ValueError(f"a score is from 0 to 1, not {score}")
    return score


def checked_score(score: Column) -> Column:
    """The score; outside 0 to 1 (or null) the query fails."""
    return F.when(score.between(0, 1), score).otherwise(F.raise_error(F.concat(F.lit("a score is from 0 to 1, not "), F.coalesce(score.cast("string"), F.lit("null")))).cast("double"))


@dataclass(frozen=True)
class Variant:
    """A subject of a bench: score(examples with seed) gives a row (example_id, seed, score, error) for each. identity says what it is."""

    name: str
    identity: dict
    score: Callable[[DataFrame], DataFrame]
    hypothesis: str = ""
    incumbent: bool = False


def function_subject(task: Callable[[dict], object], metric: Callable[[dict, object], tuple]) -> Callable[[DataFrame], DataFrame]:
    """A subject that is a Python function of an example (which has its seed)."""

    def score(trials: DataFrame) -> DataFrame:
        keyed = trials.withColumn("__trial", F.struct("example_id", "seed"))
        got = evaluate(keyed.withColumn("__key", F.concat_ws("@", F.col("example_id"), F.col("seed").cast("string"))).drop("__trial"), task, metric, "__key")
        at = F.split("__key", "@(?=[0-9-]+$)", 2)
        failed = F.arrays_overlap("tags", F.array(F.lit("task_error"), F.lit("metric_error")))
        return got.select(at[0].alias("example_id"), at[1].cast("int").alias("seed"), "score", F.when(failed, F.col("feedback")).alias("error"))

    return score


def bench(variants: list[Variant], examples: DataFrame, *, seeds: list[int], key: str, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(trials, report) of every variant, seed and example. It never chooses a winner.

    Exactly one variant is the incumbent, the others state a hypothesis, and names, seeds and example contents don't repeat. A trial's id is
    a digest of variant, identity, example and seed."""
    names = [v.name for v in variants]
    if len(set(names)) != len(names) or sum(v.incumbent for v in variants) != 1:
        raise ValueError("variants need different names and exactly one incumbent")
    if any(not v.incumbent and not v.hypothesis.strip() for v in variants):
        raise ValueError("every challenger states its hypothesis")
    if not seeds or len(set(seeds)) != len(seeds):
        raise ValueError("seeds must not be empty or repeat")
    content = sha(F.to_json(F.struct(*sorted(c for c in examples.columns if c != key)), {"ignoreNullFields": "false"}))
    named = examples.withColumn("example_id", content)
    if not named.groupBy("example_id").count().where("count > 1").isEmpty():
        raise ValueError("examples must not repeat a content")
    tried = named.withColumn("seed", F.explode(F.lit(list(seeds))))
    parts = []
    for i, v in enumerate(variants):
        identity = F.lit(json.dumps(v.identity, sort_keys=True, ensure_ascii=False))
        parts.append(v.score(tried).select(F.lit(i).alias("place"), F.lit(v.name).alias("variant"), "example_id", "seed", "score", "error", sha(F.concat_ws("\x1f", F.lit(v.name), identity, "example_id", F.col("seed").cast("string"))).alias("trial_id")))
    trials = reduce(DataFrame.unionByName, parts)
    figures = [F.count(F.lit(1)).alias("trials"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("stdev"), F.min("score").alias("least"), F.max("score").alias("most"), F.count_if(F.col("error").isNotNull()).alias("errors")]
    if threshold is not None:
        figures.append(F.avg((F.col("score") >= threshold).cast("double")).alias("pass_rate"))
    return trials, trials.groupBy("place", "variant").agg(*figures)


def winner(candidates: DataFrame) -> DataFrame:
    """The best of candidates (text, place, train_mean, val_mean): by mean on validation, then the shorter, then the earlier; with its
    generalisation gap."""
    best = F.min_by(F.struct("text", "place", "train_mean", "val_mean"), F.struct((-F.col("val_mean")).alias("a"), F.length("text").alias("b"), F.col("place").alias("c")))
    return candidates.agg(best.alias("w")).select("w.*", (F.col("w.train_mean") - F.col("w.val_mean")).alias("generalization_gap"))


def leak_windows(texts: DataFrame, samples: DataFrame, run: int, seed: str | None = None) -> DataFrame:
    """(id, sample_id): texts that have any `run` characters in a row from a sample, not counting runs that stand in `seed` too (the text
    that a candidate was made from). Both sides are (id, text), with ids of any type; an id may repeat, null texts have no runs.

    Texts with a common window have a common anchor, so both sides' distinct anchors are joined, and each pair that met is compared by all its windows, in
    time in proportion to both texts however repetitive they are. Python workers are handed TEXTS texts at a time, which sets the session's
    largest Arrow batch where that is larger."""
    size, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", texts.sparkSession
    if not 0 < int(spark.conf.get(size)) <= TEXTS:
        spark.conf.set(size, str(TEXTS))
    allowed = {seed[i : i + run] for i in range(len(seed) - run + 1)} if seed else set()

    def anchored(batches):
        for batch in batches:
            found = [anchors(t, run) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(batch)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], names=["key", "anchor"])

    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select("text_hash", "text").mapInArrow(anchored, "key long, anchor long").withColumnRenamed("key", name)

    def keyed(df: DataFrame) -> DataFrame:
        return df.where(F.length("text") >= run).select("id", "text", F.xxhash64("text").alias("text_hash"))  # texts that share it are all compared

    def compared(batches):
        for batch in batches:
            ok = [share_window(a, b, run, allowed) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "sample_id"]).filter(pa.array(ok, pa.bool_()))

    mine, theirs = keyed(texts), keyed(samples)
    pairs = marked(mine, "t").join(marked(theirs, "s").distinct(), "anchor").select("t", "s").distinct()
    met = pairs.join(mine.select(F.col("text_hash").alias("t"), F.col("text").alias("a"), "id"), "t").join(theirs.select(F.col("text_hash").alias("s"), F.col("text").alias("b"), F.col("id").alias("sample_id")), "s")
    met = met.select("id", "sample_id", "a", "b")
    return met.mapInArrow(compared, met.select("id", "sample_id").schema).distinct()
