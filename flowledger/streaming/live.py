"""A map over a stream of items with the store as its memo: each micro-batch computes only keys that no earlier one has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canon import sha
from ..sources.store import Store

SCHEMA = "key string, artifact string, artifact_sha256 string"


def live_map(items: DataFrame, store: Store, table: str, key: Column, compute: Column, checkpoint: str) -> StreamingQuery:
    """Start the query (all that is there, then it ends). A batch that is run again after a crash finds its rows and adds none."""

    def batch(df: DataFrame, number: int) -> None:
        keyed = df.withColumn("key", key).dropDuplicates(["key"])
        known = store.read(table, SCHEMA).select("key").distinct()
        fresh = keyed.join(known, "key", "left_anti").withColumn("artifact", compute)
        store.append(table, fresh.select("key", "artifact", sha(F.col("artifact")).alias("artifact_sha256")), f"batch-{number}")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
