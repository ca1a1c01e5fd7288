"""Rules, classifier, near duplicates, decontamination and license scan against brute force on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from flowledger.llm import decontam, license_scan, neardup, ranker, rules
from flowledger.llm.registry import ORACLE, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words int, kept string, component_id string"


def words(n, seed, vocabulary=40):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    base = words(120, 1, 1000)
    texts = [None, "", " \n\t ", "one", "one two", "one two", "ONE two", "é ü x\x0by", "a b c a b c a b c", "x\nx\n\nx \ny", "%%% $$ ok | <b>", " ".join(words(60, 2)), " ".join(words(60, 2)), " ".join(base)]
    texts += [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in (3, 40, 80, 119)] + [" ".join(base[:60]), " ".join(base) + "\n" + " ".join(base), " ".join(words(4000, 3, 90000))]
    rows = [(i, t, ("en", "de", None)[i % 3], 7, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id text", "en", 7, "clash", "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLE[name])


def by_hand(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_features(spark, docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.with_features(docs.select("doc_id", "text", "lang")).collect())
    assert got == Counter((i, *by_hand(t)) for i, t, *_ in corpus())


def test_binomial_tail_is_exact(spark):
    cases = [(0, 1), (0, 50), (3, 50), (1, 4000), (20, 4000), (39, 4000), (5, 20000), (40, 4000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", rules.binomial_tail(F.col("k"), F.col("n"), 0.01)).collect():
        a = Fraction(1, 100)
        want = 1.0 if r.k >= r.n * 0.01 else float(sum(math.comb(r.n, i) * a**i * (1 - a) ** (r.n - i) for i in range(r.k + 1)))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_cutoffs_need_evidence(spark):
    """Enough clean labels certify a cutoff that rejects junk and no clean text; a small stratum gets none."""
    clean = [(i, f"{'alpha beta gamma delta ' * 3} {' '.join(words(60, i, 10**6))}", "en") for i in range(1500)]
    junk = [(10_000 + i, " ".join(w + "%%%" for w in words(60, i, 10**6)), lang) for i, lang in enumerate(["en", "xx"])]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in rules.quality_rules(docs, labels).collect()}
    assert not got[10_000] and got[10_001] and all(got[i] for i in range(1500))
    none = rules.quality_rules(docs, labels.where("false"))
    assert none.where("NOT kept").count() == 0


def shingle_set(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t, k))
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(x), root(y)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs):
    for k in (4, 5):
        got = neardup.near_duplicates(docs, k=k).collect()
        want = brute_components([(r[0], r[1]) for r in corpus()], k)
        assert len(got) == len(corpus())
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_near_copy_group_loses_no_link(spark):
    """A group far longer than a short list, whose members differ so much from each other that no hub links them all."""
    r = random.Random(5)
    base = words(150, 9, 10**6)
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(2, 9)):
            w[r.randrange(len(w))] = f"own{r.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:40], *words(60, 100 + i, 10**6)])) for i in range(60)]  # a shared passage only
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute_components(rows, 4)


def test_blocks_of_a_group_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SHORT", 2)
    test_large_near_copy_group_loses_no_link(spark)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.near_duplicates(none).count() == 0
    assert rules.quality_rules(none, labels).count() == 0
    assert license_scan.license_scan(none).count() == 0
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench).count() == 0
    assert ranker.score(none, ranker.fit(none, labels)).count() == 0
    assert {r.score for r in ranker.score(docs, ranker.fit(docs, labels)).collect()} == {0.5}


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contained(docs, items, k=5, percent=80):
    def grams(t):
        w = ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    return Counter((d, i, len(b), len(b & a)) for d, t in docs for a in [grams(t)] for i, u in items for b in [grams(u)] if b and 100 * len(a & b) >= percent * len(b))


def test_decontamination_equals_brute_force(spark):
    r = random.Random(3)
    items = [(i, " ".join(words(r.randrange(5, 300), 50 + i, 10**6))) for i in range(40)] + [(90, None), (91, "a b"), (92, "!!!"), (93, "a b")]
    docs = [(i, " ".join(words(r.choice([10, 300, 40_000]), 900 + i, 10**6))) for i in range(12)]
    for i, (_, t) in enumerate(items[:30]):
        head, tail = words(r.randrange(0, 5000), 2000 + i, 10**6), words(r.randrange(0, 5000), 3000 + i, 10**6)
        body = t.upper().replace(" ", ", ").split(" ") if i % 2 else t.split(" ")
        if i % 5 == 0 and len(body) > 60:
            body[len(body) // 2] = "changed"
        docs.append((100 + i, " ".join([*head, *body[: len(body) if i % 7 else len(body) // 2], *tail])))
    docs += [(200, None), (201, "A, b!"), (202, ""), (203, items[0][1]), (203, items[0][1])]
    d, b = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = contained(docs, items)
    for block in (decontam.BLOCK, 400):
        got = Counter((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in decontam.leaks(d, b, block=block).collect())
        assert got == want and len(want) > 20


def test_items_in_bits_all_over_a_document_are_found(spark):
    r = random.Random(8)
    items = [(i, " ".join(words(400, 7000 + i, 10**6))) for i in range(30)]
    docs = []
    for i, t in items:
        body, out = t.split(" "), []
        for n, a in enumerate(r.sample(range(0, 400, 25), 16)):  # bits of 25 words in any order, far from each other
            out += [*words(3000, 100_000 + 100 * i + n, 10**6), *body[a : a + 25]]
        docs.append((i, " ".join(out)))
    docs += [(100 + i, " ".join(t.split(" ")[:300])) for i, t in items]  # three quarters: not enough
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = contained(docs, items)
    assert len(want) == 30
    found = lambda **o: Counter((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in decontam.leaks(d, b, **o).collect())
    assert found(exact=True) == found(exact=True, block=3000) == want
    assert found() == want  # windows alone


def test_exact_search_finds_what_windows_do_not(spark, monkeypatch):
    """Without windows, the looked-up shingles alone give all that brute force does, also where items share most of theirs."""
    common = words(60, 1, 10**6)
    items = [(i, " ".join([*common, *words(20, 40 + i, 10**6)])) for i in range(8)] + [(50, "a b c"), (51, None), (52, " ".join(common))]
    docs = [(i, " ".join([*words(500, 90 + i, 10**6), *(t or "").split(" ")[: 80 if i % 2 else 62]])) for i, t in items] + [(90, None), (91, ""), (92, "A, b: c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontam.Index([(r.item_id, decontam.np.frombuffer(r.shingles, decontam.np.uint64)) for r in decontam.item_sets(b, 5).collect()], exact=True)
    monkeypatch.setattr(index, "candidates", lambda run: set())
    got = Counter()
    for doc_id, run in zip([i for i, _ in docs], decontam.shingles(decontam.pa.array([t for _, t in docs]), 5, decontam.NOT_ALNUM), strict=True):
        if len(run):
            got.update((doc_id, *hit) for hit in index.leaks(run, 80))
    want = contained(docs, items)
    assert got == want and len(want) > 10
    assert Counter((x.doc_id, x.item_id, x.n_item, x.n_shared) for x in decontam.leaks(d, b, exact=True).collect()) == want


def test_license_spans(spark):
    text = "x y Licensed under the Apache License, Version 2.0. z"
    twice = "Released under the new MIT License. " * 2 + "CC-BY, all rights reserved"
    rows = [(1, text, "clash"), (2, twice, "clash"), (3, None, "clash"), (4, "cc", "clash"), (4, "Kelvin: K cc by", "clash"), (2, twice, "clash")]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 6
    assert by[1, 11].labels == "apache-2.0" and by[1, 11].score == 1.0 and by[1, 11].n_base == 0
    r = by[2, 17]
    assert r.base_labels == "cc-by,reserved" and r.n_base == 2 and (r.first_word, r.last_word) == (12, 14)
    assert by[3, 0].labels == "" and by[3, 0].score == 0 and by[3, 0].first_word is None
    assert by[4, 4].base_labels == "cc-by" and by[4, 4].first_word == 2


def test_classifier_holds_out_and_ranks(spark):
    good = [(i, " ".join(words(80, i, 5000)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(80, i, 5000)), 0) for i in range(60)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t, 0.25) for i, t, _ in rows] + [(None, None, 0.0), (5000, "", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(ranker.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    model, other = ranker.fit(docs, labels), ranker.fit(docs, flipped)
    assert (model[0] == other[0]).all() and model[1] == other[1]  # held-out labels are never read
    got = {r.doc_id: r for r in ranker.score(docs.drop("score"), model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].predicted == q for i, q in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows) + 2
