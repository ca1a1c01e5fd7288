"""Quality scores by pairwise ranking (Bradley-Terry): a text of label 1 should be preferred to one of label 0.

P(i preferred to j) is the logistic function of weights * (signals of i - signals of j). The weights minimise the logistic loss
over preference pairs drawn from a labelled sample of at most SAMPLE rows, the documented bound of what the driver fits on. The
cut between good and bad is the quantile of the sample's scores at its share of label 0, and the score is placed so that
the cut falls on THRESHOLD. Rows with crc32(id as text) % 5 = 0 are held out: their labels are never read.

Signals are computed from the text alone by DataFrame functions. Nulls: a null text is scored as an empty one; labels without
an id or quality are left out. Without labels of both kinds every score is 0.5. Repeated rows are scored one by one. Columns of the
input that have the name of a signal or result are replaced. Patterns take time in proportion to the text, however long a word is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_chars, table

SAMPLE, PAIRS, THRESHOLD, RIDGE = 20_000, 40_000, 0.3, 1e-3
#: Tasks that compute the sample's signals; the sample is too small in bytes for Spark to spread it by itself.
FIT_PARTS = 48
SIGNALS = ("symbols", "exclaims", "capitals", "digits", "bars", "repeated_grams", "adjacent", "repeated_words", "repeated_lines", "word_length", "length")


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with SIGNALS, each from 0 to 1, in place of the text. The steps stay apart so that each is compiled."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in SIGNALS]
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    norm = F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))
    marks = {"symbols": "#*$%&<>", "exclaims": "!", "bars": "|", "digits": "0123456789", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    df = docs.select(*rest, norm.alias("__norm"), F.split(F.trim(F.regexp_replace(plain, r"[\x20\x09\x0B-\x0D]+", " ")), r" ?\n[ \n]*+").alias("__lines"), *(count_chars(plain, c).alias(f"__{n}") for n, c in marks.items()))
    spaces = F.length("__norm") - F.length(F.replace("__norm", F.lit(" "), F.lit("")))
    df = df.select(
        *rest, *(f"__{n}" for n in marks), F.when(F.col("__norm") == "", 0).otherwise(spaces + 1).alias("__n"), (F.length("__norm") - spaces).alias("__chars"),
        (1 - F.size(F.array_distinct("__lines")) / F.size("__lines")).alias("__lines"), F.split("__norm", " ").alias("__words"),
        F.regexp_extract_all("__norm", F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++"), F.lit(1)).alias("__grams"),
        F.size(F.regexp_extract_all("__norm", F.lit(r"(?<![^ ])([^ ]++) (?=\1(?![^ ]))"), F.lit(1))).alias("__adjacent"),
    )
    share = lambda num, den, half: F.coalesce(F.try_divide(num, den), F.lit(0.0)) / (F.coalesce(F.try_divide(num, den), F.lit(0.0)) + half)
    distinct = lambda c: F.size(c) - F.size(F.array_distinct(c))
    made = {n: share(F.col(f"__{n}"), F.col("__chars"), h) for n, h in (("symbols", 0.02), ("exclaims", 0.02), ("capitals", 0.2), ("digits", 0.2), ("bars", 0.02))}
    made |= {
        "repeated_grams": share(distinct("__grams"), F.size("__grams"), 0.2), "adjacent": share(F.col("__adjacent"), F.col("__n"), 0.1),
        "repeated_words": share(distinct("__words"), F.size("__words"), 0.5), "repeated_lines": F.col("__lines"),
        "word_length": share(F.col("__chars"), F.col("__n"), 5.0), "length": F.log1p("__n") / (F.log1p("__n") + 6.0),
    }
    return df.select(*rest, *(made[n].cast("double").alias(n) for n in SIGNALS))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimise the mean logistic loss over differences good - bad, by Newton's steps."""
    rng = np.random.default_rng(0)
    x = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / pairs + ridge * np.eye(len(w)), x.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> tuple[np.ndarray, float] | None:
    """(weights, cut) on a sample of labels by hash order, or None without labels of both kinds."""
    marked = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("__key")).agg(F.max("quality").alias("__y"))
    marked = marked.orderBy(F.xxhash64("__key"), "__key").limit(sample)
    met = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(F.broadcast(marked), F.col("__id") == F.col("__key"))
    met = met.repartition(FIT_PARTS, "__id").groupBy("__id", "__y").agg(F.min("text").alias("text"))  # an id counts once, with its smallest text: at most `sample` rows
    rows = signals(met, "text").select("__y", *SIGNALS).collect()
    y, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float).reshape(-1, len(SIGNALS))
    if not len(y) or y.min() == y.max():
        return None
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    w = fit_pairs(x[y == 1], x[y == 0])
    return w, float(np.quantile(x @ w, float(np.mean(y == 0)))) - math.log(threshold / (1 - threshold))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted in place of the text."""
    rest = [c for c in docs.columns if c != text and c not in (*SIGNALS, "score", "predicted")]
    made = signals(docs.select(*(f"`{c}`" for c in rest), f"`{text}`"), text)
    if model is None:
        value = F.lit(0.5)
    else:
        total = F.lit(-model[1])
        for name, w in zip(SIGNALS, model[0], strict=True):
            total = total + F.lit(float(w)) * F.col(name)
        value = 1 / (1 + F.exp(-total))
    return made.select(*(f"`{c}`" for c in rest), value.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op5_bradley_terry": op5}
ORACLE: dict[str, str] = {}
