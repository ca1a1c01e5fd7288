"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a text are joined to the k-grams of license templates, which gives pairs of a place in the
text and a place in a template. Pairs are counted for each offset between the two (a diagonal), diagonals at most SLACK
apart are merged (a word was added or left out between them), and the merged span is verified: its grams are compared as
text, and they must cover at least COVER of the template's words. Templates are pairs or a table (label, text). Their grams are
counted, and broadcast up to a bound, so that only matching places are shuffled.

Nulls: a null text is empty: no words, no labels, score 0. Rows that repeat a document and text get the same result each.
Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, table

K, SLACK, COVER = 3, 2, 0.8
BROADCAST_GRAMS = 100_000  # grams of templates up to which these are broadcast (about 60 bytes each); beyond, both sides are shuffled
#: Base phrases and their labels; label and words of each template.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("all-rights-reserved", "all rights reserved"),
)


def normal(text):
    """The words with one space between, A-Z in lower case. U+212A and U+0130 are put aside first: lower() would make ASCII of them."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\u212A\u0130]", "é"))
    return F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(label, text) of templates that are given as pairs."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in templates))))


def template_grams(templates: DataFrame, k: int = K) -> DataFrame:
    """(template, label, n_template, at, gram, h) of templates (label, text): whole license texts in a table of any store, or a few lines."""
    words = F.split(normal(F.col("text")), " ")
    held = templates.select(F.xxhash64("label", "text").alias("template"), "label", words.alias("w")).where(F.size("w") >= k).distinct()
    starts = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))
    return held.select("template", "label", F.size("w").alias("n_template"), F.posexplode(starts).alias("at", "gram")).withColumn("h", F.xxhash64("gram"))


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=TEMPLATES, k: int = K, slack: int = SLACK) -> DataFrame:
    """(key, text_hash, template, label, first, last, cover): merged spans, from word `first` to before word `last`."""
    next_words = " ".join(["[^ ]++"] * k)  # possessive, and from the start of a word only: linear however long a word is
    grams = F.regexp_extract_all(normal(F.col(text)), F.lit(f"(?<![^ ])(?=({next_words}))[^ ]++"), F.lit(1))
    rolled = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), F.posexplode(grams).alias("place", "found")).withColumn("h", F.xxhash64("found"))
    table = templates if isinstance(templates, DataFrame) else template_table(docs.sparkSession, templates)
    known = template_grams(table, k)
    few = known.count() <= BROADCAST_GRAMS
    met = rolled.join(F.broadcast(known) if few else known, "h").where("found = gram")
    by = [key, "text_hash", "template", "label", "n_template"]
    diagonal = met.groupBy(*by, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("place").alias("first"), (F.max("place") + k).alias("last"))
    near = W.partitionBy(*by).orderBy("diagonal")
    starts = diagonal.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) <= slack).cast("int"))
    merged = starts.withColumn("run", F.sum(1 - F.coalesce("new", F.lit(0))).over(near.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy(*by, "run").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    return merged.select(*by[:4], "first", "last", (covered / F.col("n_template")).alias("cover"))


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=TEMPLATES, cover: float = COVER, **params) -> DataFrame:
    """For each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the best coverage of a template)."""
    phrases = [p.split() for p, _ in BASE]
    alike = lambda w, i, j, x: F.coalesce(F.get(w, i + j) == x, F.lit(False))

    def places(w):
        which = F.lit(None).cast("int")
        here = lambda i: reduce(lambda a, n: F.when(reduce(and_, (alike(w, i, j, x) for j, x in enumerate(phrases[n]))), n).otherwise(a), range(len(phrases)), which)
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.struct(i.alias("i"), here(i).alias("p"))), lambda x: x["p"].isNotNull())

    none = F.array().cast("array<struct<i:int,p:int>>")
    norm = docs.select(F.col(key), F.xxhash64(text).alias("text_hash"), normal(F.col(text)).alias("__norm"))
    spaces = F.length("__norm") - F.length(F.replace("__norm", F.lit(" "), F.lit("")))
    may = F.concat(F.lit(" "), "__norm", F.lit(" ")).rlike(f" ({'|'.join(p for p, _ in BASE)}) ")
    base = norm.select(key, "text_hash", F.struct(F.when(F.col("__norm") == "", 0).otherwise(spaces + 1).cast("long").alias("n"), F.when(may, let(F.split("__norm", " "), places)).otherwise(none).alias("at")).alias("b"))
    named = F.array(*(F.lit(x) for _, x in BASE))
    base = base.select(
        key, "text_hash", F.col("b.n").alias("n_words"), F.size("b.at").cast("long").alias("n_base"),
        F.array_min("b.at")["i"].cast("long").alias("first_word"), F.array_max("b.at")["i"].cast("long").alias("last_word"),
        F.array_distinct(F.transform("b.at", lambda x: F.get(named, x["p"]))).alias("b_labels"),
    )
    found = spans(docs, key=key, text=text, templates=templates, **params).groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"))
    found = found.agg(F.collect_set(F.when(F.col("cover") >= cover, F.col("label"))).alias("__labels"), F.max("cover").alias("__cover"))
    both = base.join(found, F.col(key).eqNullSafe(F.col("__key")) & (F.col("text_hash") == F.col("__hash")), "left")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select(
        key, "n_words", "n_base", "first_word", "last_word", joined(F.col("b_labels")).alias("base_labels"),
        joined(F.array_union("b_labels", F.coalesce("__labels", F.array().cast("array<string>")))).alias("labels"), F.coalesce("__cover", F.lit(0.0)).alias("score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    templates = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', '{p}')" for p, label in BASE)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
p AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM d),
g AS (SELECT rid, i, a || ' ' || lead(a, 1) OVER x AS g2, a || ' ' || lead(a, 1) OVER x || ' ' || lead(a, 2) OVER x AS g3 FROM p WINDOW x AS (PARTITION BY rid ORDER BY i)),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels
  FROM g JOIN (VALUES {base}) v(label, phrase) ON phrase = g2 OR phrase = g3 GROUP BY rid),
t AS (SELECT id, label, len(tw) AS n, k AS tp, tw[k + 1] || ' ' || tw[k + 2] || ' ' || tw[k + 3] AS gram
  FROM (SELECT id, label, tw, unnest(range(len(tw) - {K - 1})) AS k FROM (VALUES {templates}) v(id, label, tw))),
m AS (SELECT rid, id, label, n, i - tp AS diag, tp FROM g JOIN t ON g3 = gram),
r AS (SELECT *, CASE WHEN diag - lag(diag) OVER x <= {SLACK} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT rid, id, diag FROM m) WINDOW x AS (PARTITION BY rid, id ORDER BY diag)),
c AS (SELECT rid, id, diag, sum(fresh) OVER (PARTITION BY rid, id ORDER BY diag) AS run FROM r),
s AS (SELECT rid, label, run, id, count(DISTINCT tp + o) / max(n) AS cover FROM m JOIN c USING (rid, id, diag), (VALUES (0), (1), (2)) v(o) GROUP BY ALL),
f AS (SELECT rid, coalesce(list(DISTINCT label) FILTER (cover >= {COVER}), []) AS labels, max(cover) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)"""


QUERIES = {"op10_license_scan": op10}
ORACLE = {"op10_license_scan": _oracle()}
