"""The flagship: documents are ingested with their labels, extracted, validated, counted and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, text
from ..operators.graph import Pipeline
from .tables import read

SQL = """WITH x AS (SELECT lang, quality, length(text) AS n, sha256(text) AS digest, CASE WHEN length(text) > 500 THEN 1 ELSE 0 END AS clipped FROM documents JOIN labels USING (doc_id)),
s AS (SELECT lang, count(*) AS items, count(*) FILTER ((n >= 200) <> (quality = 1)) AS wrong, sum(clipped)::BIGINT AS clipped, count(DISTINCT digest) AS distinct_texts FROM x GROUP BY lang)
SELECT lang, items, wrong, clipped, distinct_texts, lang || ': ' || wrong || ' of ' || items || ' wrong' AS report FROM s"""


def ticket_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline()
    p.node("documents")(lambda _: read(spark, sf_dir, "documents"))
    p.node("labels")(lambda _: read(spark, sf_dir, "labels"))
    p.node("ingest", ["documents", "labels"], consumes={"documents": ["doc_id", "lang", "text"], "labels": ["doc_id", "quality"]})(lambda i: i["documents"].join(i["labels"], "doc_id"))
    p.map("extract", items_from="ingest")(lambda i: i["ingest"].select("doc_id", "lang", "quality", F.length("text").alias("n"), text.clip(F.col("text"), 500)["clipped"].alias("clipped"), canon.sha(F.col("text")).alias("digest")))
    p.map("validate", items_from="extract")(lambda i: i["extract"].withColumn("wrong", (F.col("n") >= 200) != (F.col("quality") == 1)))
    p.node("stats", ["validate"])(lambda i: i["validate"].groupBy("lang").agg(F.count(F.lit(1)).alias("items"), F.count_if("wrong").alias("wrong"), F.count_if("clipped").alias("clipped"), F.count_distinct("digest").alias("distinct_texts")))
    p.node("report", ["stats"])(lambda i: i["stats"].withColumn("report", F.concat("lang", F.lit(": "), F.col("wrong").cast("string"), F.lit(" of "), F.col("items").cast("string"), F.lit(" wrong"))))
    return p.run(["report"]).artifacts["report"]


QUERIES, ORACLE = {"ticket_pipeline": ticket_pipeline}, {"ticket_pipeline": SQL}
