"""Reading the driver's tables, and the two versions of a table that incremental queries compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changed(docs: DataFrame, every: int = 10) -> DataFrame:
    """The second version: every so many documents have one more character."""
    return docs.withColumn("text", F.when(F.col("doc_id") % every == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


#: The same in SQL.
V1, V2 = "documents", "(SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text) FROM documents)"


def literal_rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small table of literals, without leaving the JVM."""
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names.split(), row, strict=True))) for row in rows))
    return spark.range(1).select(F.inline(each))
