"""Whether a stored run is whole: states, candidates, results, their sidecars and declarations held against each other.

The five relations are put under each other as marks of one (run, target) and aggregated once: one shuffle with map-side
combine in place of four outer joins, and contents are digested where they lie, before it. A target whose sidecar belongs to
no state and no declaration is foreign and left out, with its result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import sha

KEYS = ("run_id", "target")
#: States beside which a sidecar may lie.
SUCCEEDING = ("running", "success_candidate", "completed")
_PARTS = ("state", "candidate", "sidecar", "result", "declared")
_FIELDS = {"status": "string", "said": "string", "is": "string", "cache": "string"}


def _marks(rows: DataFrame, part: str, **fields: Column) -> DataFrame:
    made = [fields.get(f, F.lit(None)).cast(t).alias(f"__{f}") for f, t in _FIELDS.items()]
    return rows.select(*KEYS, F.lit(part).alias("__part"), *made)


def targets(states: DataFrame, candidates: DataFrame, sidecars: DataFrame, results: DataFrame, declared: DataFrame) -> DataFrame:
    """One row of each (run, target): how many rows each relation has of it, and what they say."""
    marks = [
        _marks(states, "state", status=F.col("status")),
        _marks(candidates, "candidate", said=F.col("digest"), **{"is": sha(F.col("content"))}),
        _marks(sidecars, "sidecar", said=F.col("digest"), cache=F.col("cache")),
        _marks(results, "result", **{"is": sha(F.col("content"))}),
        _marks(declared, "declared"),
    ]
    here = {p: F.col("__part") == p for p in _PARTS}
    pick = lambda p, f: F.max(F.when(here[p], F.col(f"__{f}")))
    return reduce(DataFrame.unionByName, marks).groupBy(*KEYS).agg(
        *(F.count_if(here[p]).alias(f"n_{p}") for p in _PARTS), pick("state", "status").alias("status"), pick("candidate", "said").alias("candidate_said"), pick("candidate", "is").alias("candidate_is"),
        pick("sidecar", "said").alias("sidecar_said"), pick("sidecar", "cache").alias("cache"), pick("result", "is").alias("result_is"),
    )


def violations(states: DataFrame, candidates: DataFrame, sidecars: DataFrame, results: DataFrame, declared: DataFrame) -> DataFrame:
    """(run_id, target, violation): one row of each fault; a whole run has none.

    states: status; candidates: digest, content; sidecars: digest, cache (`hit` where the result came from the cache);
    results: content; declared: keys only; all with run_id and target. A null digest or content differs from any other. A target
    with several rows in one relation is a fault of its own, and its greatest values are compared."""
    state, cand, side, res, known = (F.col(f"n_{p}") > 0 for p in _PARTS)
    done, foreign = state & F.col("status").eqNullSafe(F.lit("completed")), side & ~state & ~known
    differ = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    rules = {
        "completed without candidate": done & ~cand,
        "completed without sidecar": done & ~side,
        "candidate without state": cand & ~state & ~foreign,
        "candidate digest": cand & ~foreign & differ("candidate_said", "candidate_is"),
        "sidecar without state": side & ~state & known & ~F.col("cache").eqNullSafe(F.lit("hit")),
        "sidecar of no success": side & state & ~F.coalesce(F.col("status").isin(*SUCCEEDING), F.lit(False)),
        "sidecar without result": side & ~foreign & ~res,
        "sidecar differs from candidate": side & state & cand & differ("sidecar_said", "candidate_said"),
        "result digest": side & ~foreign & res & differ("sidecar_said", "result_is"),
        "result without sidecar": res & ~side,
        "repeated rows": ~foreign & (F.greatest(*(F.col(f"n_{p}") for p in _PARTS)) > 1),
    }
    found = F.filter(F.array(*(F.when(c, name) for name, c in rules.items())), lambda x: x.isNotNull())
    return targets(states, candidates, sidecars, results, declared).select(*KEYS, F.explode(found).alias("violation"))
