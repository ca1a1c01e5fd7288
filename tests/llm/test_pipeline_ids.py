"""Pipeline stages over rows with null and repeated ids."""

from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(start, n=40):
    return " ".join(f"w{i}" for i in range(start, start + n))


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def test_near_dedup_keeps_other_texts_of_an_id(spark, tmp_path):
    a, b, c, d = (words(1000 * i) for i in range(4))
    docs = table(spark, [(None, a), (None, b), (None, b), (None, None), (1, c), (1, d), (1, d), (2, c), (3, words(9000))])
    want = Counter([(None, a), (None, b), (None, None), (1, c), (1, d), (3, words(9000))])
    assert left(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))) == want


def test_decontamination_judges_rows(spark, tmp_path):
    item, clean, other = words(0), words(5000), words(7000)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [(None, f"{clean} {item}"), (None, clean), (None, None), (1, f"{item} {other}"), (1, other), (2, other)])
    assert left(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == Counter([(None, clean), (None, None), (1, other), (2, other)])
