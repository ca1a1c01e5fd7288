"""Prefix sums, digest trees, skylines and leak checks against plain loops, with most rows in one group."""

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from flowledger.functions.rolling import anchors, share_window
from flowledger.operators import evals, ordered, skyline


def test_prefix_sums_of_few_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit(None)).otherwise("b").alias("k"), (F.col("id") * 7919 % 5003).alias("at"), (F.col("id") % 11).alias("v"))
    got = ordered.prefix_sums(rows, "k", ["at"], {"total": F.col("v"), "n": F.lit(1).cast("long")}, parts=8)
    want, now = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r["at"]):
        t, n = now.get(r.k, (0, 0))
        now[r.k] = t + r.v, n + 1
        want.add((r.k, r["at"], *now[r.k]))
    assert {(r.k, r["at"], r.total, r.n) for r in got.collect()} == want
    assert ordered.prefix_sums(rows.limit(0), "k", ["at"], {"t": F.col("v")}).count() == 0
    assert rows.select(ordered.range_parts(rows, ["k", "at"], 8).alias("p")).distinct().count() == 8


def test_streamed_digests(spark):
    rows = spark.createDataFrame([("a", i, f"t{i}") for i in range(50)] + [(None, 1, "x"), ("b", 2, None), ("b", 3, "y")], "k string, at int, v string")
    got = {r.k: r.digest for r in ordered.stream_digest(rows.repartition(7), "k", ["at"], "v").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {"a": sha("\n".join(f"t{i}" for i in range(50))), None: sha("x"), "b": sha("\ny")}


def test_trees_are_updated_above_changed_places_only(spark):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k in ("a", "b") for i in range(0, 900, 3)], "k string, at long, v string")
    edited = rows.where("NOT (k = 'a' AND at IN (300, 303))").withColumn("v", F.when((F.col("k") == "b") & (F.col("at") == 897), "new").otherwise(F.col("v"))).unionByName(spark.createDataFrame([("a", 5000, "far")], "k string, at long, v string"))
    tree = ordered.merkle(rows, "k", "at", F.col("v"), 3, width=8)
    changed = spark.createDataFrame([("a", 300), ("a", 303), ("b", 897), ("a", 5000)], "k string, at long")
    want = sorted(tuple(r) for r in ordered.merkle(edited, "k", "at", F.col("v"), 3, width=8).collect())
    got = sorted(tuple(r) for r in ordered.merkle_update(tree, edited, changed, "k", "at", F.col("v"), 3, width=8).collect())
    assert got == want and set(want) & set(map(tuple, tree.collect()))


def test_skyline_equals_all_pairs_and_scales(spark):
    rng = random.Random(0)
    points = [(i, rng.randrange(12), rng.randrange(12), rng.randrange(12), rng.randrange(3)) for i in range(600)] + [(601, None, 12, 12, 1)]
    df = spark.createDataFrame(points, "id int, a int, b int, c int, len int")
    full = [p for p in points if None not in p]
    beats = lambda y, x: all(p >= q for p, q in zip(y[1:4], x[1:4], strict=True)) and (y[1:4] != x[1:4] or y[4] < x[4])
    want = {p[0] for p in full if not any(beats(q, p) for q in full)}
    assert {r.id for r in evals.pareto(df, "id", ["a", "b", "c"], "len").collect()} == want
    flat = np.random.default_rng(1).random((3000, 4))
    assert set(skyline.front_of(flat).tolist()) == {i for i in range(3000) if not ((flat >= flat[i]).all(1) & (flat > flat[i]).any(1)).any()}
    many = spark.range(2_000_000).select(*(F.rand(s).alias(c) for s, c in enumerate("xyz")))
    front = skyline.skyline(many, ["x", "y", "z"])
    assert "NestedLoop" not in front._jdf.queryExecution().toString() and 20 < front.count() < 1000
    assert skyline.skyline(df.limit(0), ["a", "b"]).count() == 0


def test_leaks_of_any_ids_and_repetitive_texts(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [(f"t{i}", word(rng.randint(0, 60))) for i in range(60)] + [("n", None), ("t0", word(30)), ("é", "ab𝄞" * 9)]
    samples = [(i * 1.5, word(rng.randint(0, 40))) for i in range(30)] + [(99.0, "b𝄞a" * 6), (98.0, None)]
    seed = texts[3][1]
    a, b = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(samples, "id double, text string")
    for run, known in ((9, None), (12, seed), (1, None), (7, "")):
        cut = lambda t, run=run: {t[i : i + run] for i in range(len(t or "") - run + 1)}
        want = {(x, y) for x, t in texts for y, s in samples if (cut(t) & cut(s)) - cut(known)}
        assert {tuple(r) for r in evals.leak_windows(a, b, run, seed=known).collect()} == want
    began = time.time()
    assert share_window("a" * 200_000, "a" * 160_000, 40) and not share_window("ab" * 100_000, "ba" * 9 + "c", 40)
    assert len(anchors("a" * 200_000, 40)) == 1 and time.time() - began < 20
    big = spark.createDataFrame([("x", "a" * 20_000)], "id string, text string")
    assert evals.leak_windows(big, spark.createDataFrame([(1, "a" * 16_000)], "id int, text string"), 40).count() == 1


def test_leak_windows_hold_few_texts_at_a_time(spark):
    import pyarrow as pa

    size, held = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    counted = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    try:
        for before, most in (("10000", evals.TEXTS), ("0", evals.TEXTS), ("7", 7)):
            spark.conf.set(size, before)
            texts = spark.range(0, 1500, 1, 1).selectExpr("id", "concat('a text that stands in all of them ', id) AS text")
            found = evals.leak_windows(texts, texts.where("id < 2"), 30)
            assert found.count() == 3000
            assert texts.mapInArrow(counted, "n long").agg({"n": "max"}).first()[0] <= most
    finally:
        spark.conf.set(size, held)
