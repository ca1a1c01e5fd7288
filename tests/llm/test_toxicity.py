"""Positive-unlabelled learning: the risk by its formula, held-out accuracy, and hard cases."""

import math
import zlib

import numpy as np

from flowledger.llm.common import table
from flowledger.llm.toxicity import THRESHOLD, fit, found_signals, learn, op11, risk, score, word_signals

DATA = "/root/testdata/sf0.1"


def of(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data])


def test_signals_are_shares_of_words_and_beginnings():
    text, word, times, signals = word_signals(*of(["Stupid stupid, STUPIDLY!", "", "ÉTÉtés étét"]))
    assert text.tolist() == [0, 0, 2, 2]
    assert times.sum() == 5
    whole = np.unique(signals)
    at, place, share = found_signals(*of(["stupid x stupidly x"]), whole[whole > 0])
    assert (at == 0).all() and set(share.tolist()) == {0.25, 0.5}  # each word once; their first 5 and 6 bytes twice
    assert len(place) == len(set(place.tolist()))


def test_risk_and_its_minimum():
    g, h, prior = np.array([2.0, -1.0]), np.array([-3.0, 0.5, 0.0]), 0.2
    loss = lambda z: math.log1p(math.exp(-z))
    a, b = risk(g, h, prior)
    assert abs(a - prior * (loss(2) + loss(-1)) / 2) < 1e-12
    assert abs(b - ((loss(3) + loss(-0.5) + loss(0)) / 3 - prior * (loss(-2) + loss(1)) / 2)) < 1e-12
    rng = np.random.default_rng(0)  # one signal: 9 of 10 toxic texts have it and 1 of 20 others; a fifth of the unlabelled ones are toxic
    toxic = np.concatenate([np.ones(2000, bool), rng.random(8000) < 0.2])
    has = rng.random(10_000) < np.where(toxic, 0.9, 0.05)
    rows = np.flatnonzero(has)
    w, c = learn(rows, np.zeros(len(rows), np.int64), np.ones(len(rows)), np.arange(10_000) < 2000, 1, 0.2, ridge=0.0)
    posterior = 0.2 * 0.9 / (0.2 * 0.9 + 0.8 * 0.05)
    assert abs(1 / (1 + math.exp(-(w[0] + c))) - posterior) < 0.05


def test_the_model_does_not_learn_unlabelled_toxic_texts_by_heart():
    n, width = 400, 400  # each text has a signal of its own: the second part of the risk can fall without end
    confirmed = np.arange(n) < 100
    w, c = learn(np.arange(n), np.arange(n), np.ones(n), confirmed, width, 0.3, ridge=0.0)
    g = w + c
    assert risk(g[confirmed], g[~confirmed], 0.3)[1] > -0.05


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect()}
    out = [r for r in op11(spark, DATA).collect()]
    assert len(out) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD) for r in out)
    test = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in test]) > 0.98
    assert np.mean([p for p, y in test if y]) > 0.9 and np.mean([p for p, y in test if not y]) < 0.01


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = [(k, f"fine words {k} " + ("awful " if k % 3 == 0 else "")) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marked = [(k, int(k % 3 == 0)) for k in range(120)]
    other = [(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in marked]
    a, b = (fit(df, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marked, other))
    assert all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(a, b, strict=True))


def test_hard_cases(spark):
    long = "fine " * 50_000
    docs = [(k, "awful" if k % 5 == 0 else "nice " * (k % 7)) for k in range(80)]
    docs += [(100, None), (101, ""), (None, "awful"), (102, long), (5, docs[5][1]), (5, "another text")]
    df = spark.createDataFrame([(k, t, "x", 0.5) for k, t in docs], "doc_id long, text string, label string, score double")
    labels = [(k, int(k % 5 == 0)) for k in range(80)] + [(5, 0), (None, 1), (7, None), (999, 1)]
    model = fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = score(df, model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    of_text = {r.doc_id: r.score for r in out}
    assert of_text[100] == of_text[101] and of_text[None] > 0.3 > of_text[102]
    assert {r.score for r in score(df, fit(df, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0.0}
    assert {r.score for r in score(df, fit(df, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))).collect()} == {0.0}
    assert score(df.limit(0), model).collect() == []
    assert fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
