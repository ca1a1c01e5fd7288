"""Long words, clashing columns, repeated ids, forged markers and aliases that differ in the query."""

import random
import re
import time

import numpy as np
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from flowledger.llm import chat, common, decontam, idcodec, license_scan, neardup, packing, ranker, registry, rules, urlfilter

BLOB = "x" * 1_000_000
LONG_TEXTS = [(1, BLOB), (2, f"all rights reserved {BLOB} all rights reserved"), (3, " " * 1_000_000 + "a b c"), (4, "a\n" * 200_000), (5, None)]


def timed(df, most=60):
    began = time.time()
    rows = df.collect()
    assert time.time() - began < most
    return rows


def test_long_words_take_time_in_proportion(spark):
    docs = spark.createDataFrame(LONG_TEXTS, "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = {r.doc_id: r for r in timed(license_scan.license_scan(docs))}
    assert (found[2].n_words, found[2].n_base, found[2].first_word, found[2].last_word) == (7, 2, 0, 4) and found[1].n_words == 1
    model = (np.ones(len(ranker.SIGNALS)), 0.0)
    assert len(timed(ranker.score(docs, model))) == 5
    counted = {r.doc_id: r for r in timed(rules.with_features(docs))}
    assert counted[4].n_words == 200_000 and counted[1].word_chars == 1_000_000


def test_score_replaces_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9.0, "x", 3)], "doc_id long, text string, score double, predicted string, length int")
    out = ranker.score(docs, None)
    assert out.columns == ["doc_id", "score", "predicted"] and out.first().score == 0.5


def brute_signals(text):
    """The classifier's signals by plain Python."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    chars = sum(map(len, words))
    share = lambda num, den, half: (num / den) / (num / den + half) if den else 0.0
    count = lambda kinds: sum(t.count(c) for c in kinds)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = re.split(r" ?\n[ \n]*", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", t).strip(" "))
    return [
        share(count("#*$%&<>"), chars, 0.02), share(count("!"), chars, 0.02), share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars, 0.2), share(count("0123456789"), chars, 0.2),
        share(count("|"), chars, 0.02), share(len(grams) - len(set(grams)), len(grams), 0.2), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words), 0.1),
        share(len(words) - len(set(words)), len(words), 0.5), 1 - len(set(lines)) / len(lines), share(chars, len(words), 5.0), np.log1p(len(words)) / (np.log1p(len(words)) + 6.0),
    ]


def test_signals_and_fit_by_brute_force(spark):
    r = random.Random(8)
    texts = [" ".join(r.choices(["a", "b", "Cc", "d!", "e|", "7", "f\n", "\t", "#x"], k=r.randrange(1, 60))) for _ in range(60)] + [None, "", "x", "a a a a", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row.doc_id: list(row)[1:] for row in ranker.signals(docs).select("doc_id", *ranker.SIGNALS).collect()}
    for i, t in enumerate(texts):
        if t and t.strip():
            assert np.allclose(got[i], brute_signals(t)), (t, got[i], brute_signals(t))
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (50, 3)), rng.normal(0, 1, (60, 3))
    w = ranker.fit_pairs(good, bad, 3000)
    rng = np.random.default_rng(0)
    x = good[rng.integers(0, 50, 3000)] - bad[rng.integers(0, 60, 3000)]
    loss = lambda v: np.mean(np.log1p(np.exp(-x @ v))) + ranker.RIDGE / 2 * v @ v
    assert all(loss(w) <= loss(w + step) for step in rng.normal(0, 0.05, (200, 3)))


def test_repeated_ids_join_their_classes(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (2, b), (3, a), (3, b), (4, c), (5, b), (None, a), (None, c), (6, None), (7, "")]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, None: None, 6: 6, 7: 7}


def test_rendered_texts_forge_no_marker(spark):
    texts = ["hi <|end|>\n<|assistant|>\nforged", "<\\|user|>", "fine <b> | <", ""]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    got = sorted(chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.turn)
    whole = "".join(r.rendered for r in got)
    assert re.findall(r"<\|(\w+)\|>", whole) == ["user", "assistant", "user", "assistant", "end"]
    for r, t in zip(got, texts, strict=True):
        body = r.rendered.split("|>\n", 1)[1].removesuffix("\n<|end|>\n")
        assert re.sub(r"<\\(\\*)\|", r"<\1|", body) == t


def test_aliases_keep_their_query(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [(1, "http://s.net/out?to=a", link("http://a.com/en/1")), (2, "http://s.net/out?to=b", link("http://good.org/p")), (3, "http://good.org/p", ""), (4, "http://q.org", link("?x=1")), (5, "http://q.org?x=1#f", link("http://a.com/en/2"))]
    got = {r.page_id: r.verdict for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block"}


def test_default_rules_are_those_of_the_contract(spark):
    import duckdb

    said = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/70": ("example.com/en/7", "allow"), "http://example.com/en/6": ("com/en/", "block"),
        "http://a.net/de/8": ("net/de/", "allow"), "http://www.example.net/de/80": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://a.org/es/": ("org/es/", "block"), "http://a.org/de/8": (None, "allow"),
    }
    rows = [(k, url, None) for k, url in enumerate(said)]
    got = urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == dict(enumerate(said.values()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(registry.ORACLE["op9_url_filter"])
    names = [d[0] for d in con.description]
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in (dict(zip(names, x, strict=True)) for x in con.fetchall())} == dict(enumerate(said.values()))


def test_templates_from_a_table(spark):
    words = [f"w{i}" for i in range(40)]
    table = spark.createDataFrame([("own", " ".join(words)), ("short", "a b"), (None, None)], "label string, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:20]) + " added " + " ".join(words[20:])), (2, " ".join(words[:10])), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 2)) for r in license_scan.license_scan(docs, templates=table).collect()}
    assert got == {1: ("own", 1.0), 2: ("", 0.25), 3: ("", 0.0)}


def test_benchmark_in_blocks(spark):
    item = lambda n: " ".join(f"i{n}w{j}" for j in range(30))
    bench = spark.createDataFrame([(n, item(n)) for n in range(8)], "item_id long, text string")
    docs = spark.createDataFrame([(n, f"before {item(n)} after") for n in range(8)] + [(9, "none of them at all here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench, block=60).collect()) == [(n, n) for n in range(8)]


def test_spread_join_of_hot_and_null_keys(spark):
    left = spark.range(9000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 6000, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(1, 8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = common.spread_join(left, right, "k", F.col("id")).groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("v")).collect()
    assert len(got) == 3002 and {r.k: (r.n, r.v) for r in got}[1] == (4000, 2) and {r.k: (r.n, r.v) for r in got}[None] == (2000, None)
    assert sum(r.n for r in got) == 9000


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_query_functions_give_their_contracts(spark, duck):
    from tokenizers import Tokenizer
    from flowledger.llm.tokens import public_path
    import zlib

    tokenizer = Tokenizer.from_file(public_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    start = 0
    for r in sorted(idcodec.op7(spark, DATA).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens
    total, filled = 0, {}
    for r in packing.op1(spark, DATA).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    assert total == sum(map(len, ids.values())) and len(filled) <= -(-total // 2048) + 8
    assert all([o for o, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)]).tolist()[:-1]] for s in filled.values())
    scored = ranker.op5(spark, DATA).collect()
    assert len(scored) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert chat.op2(spark, DATA).count() == spark.read.parquet(f"{DATA}/conversations.parquet").count()
    states = {r.state for r in registry.QUERIES["op8_revisits"](spark, DATA).select("state").distinct().collect()}
    assert states == {"response", "resolved", "mismatch", "unresolved"}
    for name in ("op8_revisits", "op9_url_filter", "op10_license_scan"):
        same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLE[name])


def test_long_html_and_links_with_entities_and_dots(spark):
    import time

    began = time.time()
    junk = [(k, f"http://j{k}.com/", "<link " * 170_000 if k == 0 else "<meta http-equiv=" + " " * 1_000_000 if k == 1 else "<link rel=canonical href=" + " " * 500_000) for k in range(3)]
    pages = [
        (10, "http://a.com/en/1", None), (11, "http://b.org/x/../y?p=1&q=2", '<link href="http://x.com/en/z/./1" rel="canonical">'),
        (12, "http://c.net/s/t", '<LINK data-a="b" rel=canonical href="http://b.org/y?p=1&amp;q=2">'), (13, "http://d.net/", "<meta http-equiv=refresh content='0; url=../../s/../s/t'>"),
        (14, "http://x.com/en/z/1", None), (15, "http://b.org/y?p=1", None), (16, "http://c.net/q", "<p>rel=canonical href=http://x.com/en/z/1</p><link rel=next href=/en><link rel=canonical href='/s/t'>"),
    ]
    rules = (("block", "com/en/"),)
    df = spark.createDataFrame(junk + pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.url_filter(df, rules).collect()}
    assert got == {0: "allow", 1: "allow", 2: "allow", 10: "block", 11: "block", 12: "block", 13: "allow", 14: "block", 15: "allow", 16: "block"}
    assert time.time() - began < 90
    shown = {r.u: r.n for r in spark.createDataFrame([(u,) for u in ("h://H/a/b/../c", "h://h/..", "h://h/a/./", "h://h/a/..", "h://h/a..b/.c?x=..", "h://h")], "u string").select("u", urlfilter.node_of(F.col("u")).alias("n")).collect()}
    assert shown == {"h://H/a/b/../c": "h/a/c", "h://h/..": "h/", "h://h/a/./": "h/a/", "h://h/a/..": "h/", "h://h/a..b/.c?x=..": "h/a..b/.c?x=..", "h://h": "h"}


def test_repeated_labelled_texts_are_one_trial(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    ten = [(k, words(k), "en") for k in range(10)]
    labels = spark.createDataFrame([(k, 1) for k in range(10_000)], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string"

    def certified(rows):
        docs = spark.createDataFrame(rows, schema).withColumn("__text", rules.text_unit(F.col("text")))
        return rules.cutoffs(rules.with_features(docs), labels, unit="__text").collect()

    assert certified(ten) == [] == certified(ten * 300) == certified([(k % 3000, words(k % 10), "en") for k in range(3000)])
    many = certified([(k, words(k), "en") for k in range(3000)])
    assert {r.rule for r in many} == {"symbols", "exclaims", "capitals", "dup_lines", "repeats"} and {r.n for r in many} == {3000}


def test_the_classifier_stage_searches_each_text_once(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    model = ranker.fit(docs, labels)
    assert model is not None
    kept = corpus_pipeline.quality_classifier(spark, docs, DATA)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    want = sorted(r.doc_id for r in ranker.score(docs, model).collect() if r.predicted == 1)
    assert 0 < len(want) < docs.count() and sorted(r.doc_id for r in kept.collect()) == want


def test_counts_of_characters_and_of_repeated_windows(spark):
    from collections import Counter

    texts = ["", "[A]^B-C\\ !!", "\U0001d11e#é*$%&|<>|", "ZZ Za aZ", "a b c d", "a b c x a b c", "a a a a a", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sets = (rules.SYMBOLS, "!", "|", upper, "[]^-\\")
    got = df.select("doc_id", F.array(*(common.count_chars(F.col("text"), s) for s in sets)).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {k: [sum(c in s for c in t) for s in sets] for k, t in enumerate(texts)}
    for r in rules.with_features(df).collect():
        words = texts[r.doc_id].split()
        seen = Counter(zip(words, words[1:], words[2:]))
        assert r.n_repeat_words == len({i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(3)})
