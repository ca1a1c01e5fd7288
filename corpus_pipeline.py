"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm import decontam, neardup, packing, ranker, rules
from flowledger.llm.common import materialise, table
from flowledger.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff of their language reject.

    The verdicts are joined back by document and text, so that rows that share an id are judged one by one."""
    marked = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("__text"))
    measured = materialise(rules.with_features(marked))
    judged = rules.judge(measured, rules.cutoffs(measured, table(spark, sf_dir, "labels"), unit="__text"))
    rejected = judged.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash"), F.col("lang").alias("__lang")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")) & F.col("lang").eqNullSafe(F.col("__lang"))
    return docs.join(rejected, same, "left_anti").select(*COLUMNS)


def quality_classifier(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise-ranking score is above the cut.

    The verdicts are written before they are asked for: a filter on them would be pushed below the steps of the signals, with all of
    their patterns written out again wherever a step is used, and each text would be searched many times over."""
    model = ranker.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.withColumn("__text", F.col("text"))
    scored = ranker.score(whole, model, text="text").withColumnRenamed("__text", "text")
    return materialise(scored.select(*COLUMNS, "predicted")).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; of rows with the same id and text, one.

    Rows that share an id with different texts are one document for the comparison, and all stay or all go. A null id is in no
    group, so each different text under it stays."""
    verdict = neardup.near_duplicates(docs)
    dropped = verdict.where("NOT kept").select("doc_id").distinct()
    rest = docs.join(dropped, "doc_id", "left_anti").withColumn("__text", F.xxhash64("text"))
    return rest.dropDuplicates(["doc_id", "__text"]).select(*COLUMNS)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, judged one by one: rows with a null id or one that repeats stand for their own text."""
    marked = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    leaks = decontam.leaks(marked.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return marked.join(leaks.select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(*COLUMNS)


def best_fit_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences' pieces: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(packing.pieces(docs, public_path()), docs.count())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return materialise(STAGES[-1][1](spark, docs, sf_dir))


#: Tokens and the classifier's fit are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
