"""What may happen to the targets of a run, to the run's own status and to its output paths, decided from rows.

Each question is one aggregate over rows that are joined by run, so a run of any number of targets is spread over tasks and
combined before it is shuffled. Nothing here changes a row; `sources.ledger` appends what was admitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import sha

#: What a run can be, and what an attempt can be.
RUN_STATUSES = ("running", "pending_retry", "ambiguous", "checkpoint_pending", "completed", "failed")
ATTEMPT_STATUSES = ("running", "success_candidate", "retry_scheduled", "ambiguous", "failed", "checkpoint_pending", "completed")
#: A run status, and the attempt status without which it has nothing to tell.
NEEDS = {"pending_retry": "retry_scheduled", "ambiguous": "ambiguous", "checkpoint_pending": "checkpoint_pending"}


def latest(states: DataFrame) -> DataFrame:
    """One row of a run's target: that of the highest generation."""
    return states.groupBy("run_id", "target").agg(F.max_by(F.struct(*states.columns), F.col("generation")).alias("__s")).select("__s.*")


def actions(targets: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """(run_id, target, action, attempt) of targets (run_id, target, declaration) that a run takes up at `now`.

    states: run_id, target, generation, status, attempt, declaration, side_effect, due, candidate, candidate_sha. Actions are run,
    pending, candidate, completed, failed and ambiguous; `changed` where the target is declared otherwise than when it was tried,
    `damaged` where a candidate isn't what its digest says, and `invalid` where the status is none. A target without a state
    is run for the first time; states of targets that weren't asked for are left out. A null side effect is one that did not begin."""
    held = latest(states).withColumnRenamed("declaration", "__declared").withColumn("__known", F.lit(True))
    both = targets.select("run_id", "target", "declaration").join(held, ["run_id", "target"], "left")
    status, due = F.col("status"), F.coalesce(F.col("due") <= now, F.lit(False))
    acted = (
        F.when(F.col("__known").isNull(), "run")
        .when(~F.col("declaration").eqNullSafe(F.col("__declared")), "changed")
        .when(status == "running", F.when(F.coalesce("side_effect", F.lit(False)), "ambiguous").otherwise("run"))
        .when(status == "checkpoint_pending", "run")
        .when(status == "retry_scheduled", F.when(due, "run").otherwise("pending"))
        .when(status == "success_candidate", F.when(sha(F.col("candidate")) == F.col("candidate_sha"), "candidate").otherwise("damaged"))
        .when(status.isin("completed", "failed", "ambiguous"), status)
        .otherwise("invalid")
    )
    attempt = F.coalesce("attempt", F.lit(0)) + F.when(F.col("__known").isNull() | ((status == "retry_scheduled") & (F.col("__act") == "run")), 1).otherwise(0)
    return both.withColumn("__act", acted).select("run_id", "target", F.col("__act").alias("action"), attempt.cast("int").alias("attempt"))


def updates(asked: DataFrame, states: DataFrame) -> DataFrame:
    """asked (run_id, current, wanted) with `refused`: why the run may not take the wanted status, or null.

    A completed run stays completed; asking it to be running is no change and is admitted. A run is completed when no attempt is
    still open or failed, failed when one failed or none is running, and else what one of its attempts is. A run without
    attempts can be running, completed or failed."""
    flag = {s: F.bool_or(F.col("status") == s).alias(f"__{s}") for s in ATTEMPT_STATUSES}
    held = latest(states).groupBy("run_id").agg(*flag.values())
    has = {s: F.coalesce(F.col(f"__{s}"), F.lit(False)) for s in ATTEMPT_STATUSES}
    opened = has["running"]
    for s in ATTEMPT_STATUSES[1:-1]:
        opened = opened | has[s]
    wanted, ended = F.col("wanted"), F.col("current").eqNullSafe(F.lit("completed"))
    refused = (
        F.when(wanted.isNull() | ~wanted.isin(*RUN_STATUSES), "unknown status")
        .when(ended & wanted.isin("running", "completed"), F.when((wanted == "completed") & opened, "open attempts"))
        .when(ended, "already completed")
        .when((wanted == "completed") & opened, "open attempts")
        .when((wanted == "failed") & ~has["failed"] & (has["running"] | (has["completed"] & ~opened)), "no failure")
    )
    for status, needed in NEEDS.items():
        refused = refused.when((wanted == status) & ~has[needed], f"no attempt is {needed}")
    return asked.join(held, "run_id", "left").select(*asked.columns, refused.alias("refused"))


def contested(outputs: DataFrame) -> DataFrame:
    """(run_id, path, owners, first_owner) of paths that more than one step or item of a run writes.

    outputs: run_id, path, owner; an item's owner is `step@item`. A mapping step may hold what one of its items wrote. Owners are
    counted, not listed, so a path that very many write is no large row. Null owners claim nothing."""
    claims = outputs.where("owner IS NOT NULL").select("run_id", "path", "owner").distinct()
    step, item = F.split_part("owner", F.lit("@"), F.lit(1)), F.contains("owner", F.lit("@")) & ~F.endswith("owner", F.lit("@"))
    of_step = claims.groupBy("run_id", "path", F.when(item, step).otherwise(F.col("owner")).alias("__step")).agg(F.greatest(F.count_if(item), F.lit(1)).alias("__n"), F.min("owner").alias("__first"))
    whole = of_step.groupBy("run_id", "path").agg(F.sum("__n").alias("owners"), F.min("__first").alias("first_owner"))
    return whole.where("owners > 1")
