"""Better prompts from replies, as tables: proposals, gates and the front of a round are each a few joins; who asks the model is not said here.

Tables: candidates (place, text), replies (place, parent, reply), scores (place, example_id, score); `place` numbers candidates in the order in which they came. A round is
`proposals`, then the scores of what is left, then `gates`, and `front` over the candidates that passed. All of it can be stored by a cached run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_fenced
from .evals import leak_windows


def proposals(replies: DataFrame, candidates: DataFrame, *, max_chars: int, examples: DataFrame | None = None, run: int = 40, seed: str | None = None) -> DataFrame:
    """(place, parent, text, problem): the fenced block of each reply, and why it can't be tried: no block, too long, a text that is a candidate already, or
    one that repeats `run` characters of an example (id, text) that the seed hasn't."""
    made = replies.select("place", "parent", F.trim(extract_fenced(F.col("reply"))).alias("text"))
    known = candidates.select("text").distinct().withColumn("__known", F.lit(True))
    made = made.join(known, "text", "left")
    if examples is not None:
        leaks = leak_windows(made.select(F.col("place").alias("id"), "text"), examples, run, seed=seed).select(F.col("id").alias("place")).distinct()
        made = made.join(leaks.withColumn("__leak", F.lit(True)), "place", "left")
    else:
        made = made.withColumn("__leak", F.lit(None).cast("boolean"))
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    problem = F.when(empty, "no block").when(F.length("text") > max_chars, "too long").when(F.col("__known"), "known").when(F.col("__leak"), "repeats an example")
    return made.select("place", "parent", "text", problem.alias("problem"))


def gates(children: DataFrame, train: DataFrame, val: DataFrame) -> DataFrame:
    """(place, no_regression, mean_ok) of children (place, parent): as good as the parent on each training example that both have, and on
    validation not worse by mean. A child without scores passes neither."""

    def beside(scores: DataFrame) -> DataFrame:
        mine = children.join(scores, "place").select("place", "parent", "example_id", F.col("score").alias("c"))
        return mine.join(scores.select(F.col("place").alias("parent"), "example_id", F.col("score").alias("p")), ["parent", "example_id"])

    kept = beside(train).groupBy("place").agg(F.bool_and(F.col("c") >= F.col("p")).alias("no_regression"))
    means = beside(val).groupBy("place").agg((F.avg("c") >= F.avg("p")).alias("mean_ok"))
    out = children.select("place").join(kept, "place", "left").join(means, "place", "left")
    return out.select("place", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("no_regression", "mean_ok")))


def front(candidates: DataFrame, val: DataFrame) -> DataFrame:
    """The candidates that no other one dominates over all validation examples: as good on each and better on one, or equal on all and shorter, or equal
    in that too and earlier. Each example's scores meet by its id, so pairs of candidates are counted up, not examples."""
    held = val.join(candidates.select("place", F.length("text").alias("n")), "place")
    a, b = held.alias("a"), held.alias("b")
    both = a.join(b, (F.col("a.example_id") == F.col("b.example_id")) & (F.col("a.place") != F.col("b.place")))
    pair = both.groupBy(F.col("a.place").alias("place"), F.col("b.place").alias("other")).agg(
        F.bool_and(F.col("b.score") >= F.col("a.score")).alias("as_good"), F.bool_or(F.col("b.score") > F.col("a.score")).alias("better"),
        F.first("a.n").alias("mine"), F.first("b.n").alias("theirs"),
    )
    ahead = F.col("better") | (F.col("theirs") < F.col("mine")) | ((F.col("theirs") == F.col("mine")) & (F.col("other") < F.col("place")))
    return candidates.join(pair.where(F.col("as_good") & ahead).select("place").distinct(), "place", "left_anti")
