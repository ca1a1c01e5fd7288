"""Durable attempts: retry policy, transitions, receipts and recovery, as functions of attempt rows."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.canon import sha
from ..functions.failures import kind_of
from ..functions.identity import digest as digest_of
from ..functions.text import jitter_fraction
from .graph import closure


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 3
    initial_delay: float = 1.0
    multiplier: float = 2.0
    max_delay: float = 120.0
    jitter: str = "full"
    retry_on: tuple[str, ...] = ("connection", "rate_limit", "server_error", "timeout")

    def __post_init__(self) -> None:
        if self.jitter not in ("full", "none"):
            raise ValueError("jitter is full or none")
        if self.max_attempts < 1 or self.initial_delay < 0 or self.multiplier < 1 or self.max_delay < self.initial_delay:
            raise ValueError("a retry policy needs an attempt, delays from 0 up, and a multiplier from 1 up")

    def delay(self, run_id: Column, target: Column, attempt: Column, digest: Column, asked_ms: Column) -> Column:
        """Seconds until the next attempt: full jitter below a growing cap, or what the provider asks for if that is more."""
        cap = F.least(F.lit(self.max_delay), self.initial_delay * F.pow(F.lit(self.multiplier), attempt - 1))
        drawn = cap * jitter_fraction(run_id, target, attempt, digest) if self.jitter == "full" else cap
        return F.greatest(drawn, F.greatest(F.lit(0.0), F.coalesce(asked_ms, F.lit(0)) / 1000))

    def wait(self, run_id: str, target: str, attempt: int, error: BaseException | None) -> float | None:
        """As `delay`, on the driver: seconds until a step's next attempt after it raised an error, or None where the step is not tried again. An error may
        have `retry_after_ms`. Without an error (items of a map failed, whose kinds aren't known), attempts alone count."""
        if attempt >= self.max_attempts or (error is not None and kind_of(error) not in self.retry_on):
            return None
        held = hashlib.sha256("\\0".join((run_id, target, str(attempt), digest_of(asdict(self)))).encode()).hexdigest()
        cap = min(self.max_delay, self.initial_delay * self.multiplier ** (attempt - 1))
        asked = getattr(error, "retry_after_ms", None)
        return max(cap * (int(held[:16], 16) / 2.0**64 if self.jitter == "full" else 1.0), asked / 1000 if isinstance(asked, (int, float)) and asked > 0 else 0.0)

    def next_status(self, failed: Column, kind: Column, side_effect: Column, attempt: Column) -> Column:
        again = (attempt < self.max_attempts) & F.coalesce(kind.isin(*self.retry_on), F.lit(False))
        return F.when(~failed, "success_candidate").when(side_effect, "ambiguous").when(again, "retry_scheduled").otherwise("failed")


def receipts(states: DataFrame, target: str, order: list[str], state: str) -> DataFrame:
    """states with sequence (1..n of a target) and the digest of the state before."""
    w = W.partitionBy(target).orderBy(*order)
    return states.withColumns({"sequence": F.row_number().over(w), "previous": F.lag(sha(F.col(state))).over(w)})


def broken_receipts(chain: DataFrame, target: str, state: str) -> DataFrame:
    """Rows of a stored chain whose number or link is wrong."""
    w = W.partitionBy(target).orderBy("sequence")
    right = (F.col("sequence") == F.row_number().over(w)) & F.col("previous").eqNullSafe(F.lag(sha(F.col(state))).over(w))
    return chain.withColumn("__ok", right).where("NOT __ok").drop("__ok")


def inherited(nodes: DataFrame, edges: DataFrame, recovered: DataFrame) -> DataFrame:
    """Steps whose results a recovery keeps: neither recovered nor downstream of what is."""
    below = closure(nodes.sparkSession, edges, recovered).select("name").unionByName(recovered.select("name")).distinct()
    return nodes.join(below, "name", "left_anti")
