"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all runs on one machine, a local
    one that this sets. On a cluster without the setting it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rstrip("/").rpartition("/")[0]
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="flowledger-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the files then stay in the checkpoint folder
            pass


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    With by, the last column of df, each of its values has a folder of its own, so that a filter on it reads no other."""
    return staged(df, by)[0]


def staged(df: DataFrame, by: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """As materialise, with a call that deletes the files when nothing needs them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowledger-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), lambda: _delete(spark, path)


def spread_join(left: DataFrame, right: DataFrame, key: str, tie: Column, *, share: int = 1000, parts: int = 64) -> DataFrame:
    """left with the columns of right, which has one row for each key: a left join in which no key's rows go to one task.

    Keys with more than one of `share` rows of left are hot; there are fewer than `share` of them, so their list is
    broadcast. Their rows are dealt over `parts` by a hash of `tie`, and their row of right is repeated as often. Null keys match
    nothing and are dealt alike."""
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(hot.where(F.col("__n") > F.greatest(F.lit(left.count() // share), F.lit(1000))).select(F.col(key).alias("__hot")).limit(share))
    salt = F.pmod(F.xxhash64(tie), F.lit(parts))
    mine = left.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0).cast("long")))
    theirs = right.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return mine.drop("__hot").join(theirs.drop("__hot"), [key, "__part"], "left").drop("__part")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also where body has lambdas that use it."""
    return F.transform(F.array(value), body)[0]


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of text are among chars (ASCII, none repeated). A class of a pattern costs half of what `translate` does."""
    if len(chars) == 1:
        return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(chars), F.lit("")))).cast("long")
    return F.regexp_count(text, F.lit("[" + "".join(c if c.isalnum() else f"\\{c}" for c in chars) + "]")).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers then hold at most so many texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
