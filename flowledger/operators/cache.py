"""Content-addressed results: lookup, integrity, forecasts, explanations, differences and collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.canon import sha

MISSING = "<缺失>"


def lookup(keyed: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """keyed with the cached artifact and a state: missing, valid, or corrupt if the artifact doesn't match its digest."""
    held = cache.select(F.col(key), "artifact", "artifact_sha256")
    state = F.when(F.col("artifact_sha256").isNull(), "missing").when(F.coalesce(sha(F.col("artifact")) == F.col("artifact_sha256"), F.lit(False)), "valid").otherwise("corrupt")
    return keyed.join(held, key, "left").withColumn("state", state)


def incremental(keyed: DataFrame, cache: DataFrame, compute: Column, *, forced: Column | None = None, key: str = "key") -> DataFrame:
    """keyed with artifact and `hit`: cached rows as they are, the others computed. A corrupt row fails the query."""
    found = lookup(keyed, cache, key)
    hit = (F.col("state") == "valid") & ~(forced if forced is not None else F.lit(False))
    checked = F.when(F.col("state") == "corrupt", F.raise_error(F.concat(F.lit("corrupt cache entry "), F.col(key)))).when(hit, F.col("artifact")).otherwise(compute)
    return found.withColumn("hit", hit).withColumn("artifact", checked).drop("artifact_sha256", "state")


def forecast(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, state) for steps (name, cached): hit, miss, or unknown where anything upstream has no known result."""
    from .graph import closure

    spark = steps.sparkSession
    late = closure(spark, edges, steps.where("NOT cached").select("name")).select("name").distinct().withColumn("late", F.lit(True))
    return steps.join(late, "name", "left").select("name", F.when(F.col("late"), "unknown").when(F.col("cached"), "hit").otherwise("miss").alias("state"))


def explain(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Labels whose digests differ between two component tables (by..., label, digest)."""
    a, b = old.withColumnRenamed("digest", "old"), new.withColumnRenamed("digest", "new")
    both = a.join(b, [*by, "label"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(*by, "label", F.coalesce("old", F.lit(MISSING)).alias("old"), F.coalesce("new", F.lit(MISSING)).alias("new"))


def diff(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): changed, only_a or only_b; equal rows are left out."""
    both = a.select(key, F.col(digest).alias("x")).join(b.select(key, F.col(digest).alias("y")), key, "full_outer")
    change = F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").when(F.col("x") != F.col("y"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def manifest_changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    both = before.select(key, F.col(digest).alias("x")).join(after.select(key, F.col(digest).alias("y")), key, "full_outer")
    return both.select(key, F.when(F.col("x").isNull(), "created").when(F.col("y").isNull(), "deleted").when(F.col("x") != F.col("y"), "modified").otherwise("unchanged").alias("change"))


def last_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The `keep` newest runs: conventional names (run-N) by number, after all others."""
    number = F.regexp_extract("run_id", r"^run-(\d+)$", 1)
    order = W.orderBy(F.desc(number != ""), F.desc(F.when(number != "", number).cast("long")), F.desc("run_id"))
    return runs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def unreferenced(entries: DataFrame, uses: DataFrame, runs: DataFrame, keep: int, key: str) -> DataFrame:
    """Entries that none of the newest runs uses."""
    return entries.join(uses.join(F.broadcast(last_runs(runs, keep).select("run_id")), "run_id", "left_semi"), key, "left_anti")
