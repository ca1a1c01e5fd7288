"""Periodic runs against a search over all periods."""

import hashlib
import random

import numpy as np
import pytest

from flowledger.llm.runs import Index, all_runs, collapse, planted, previous_factors


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            first = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k - first + q >= max(6, 4 * q):
                found.setdefault((first, k + q - 1), q)
            k += 1
    return sorted((a, b, q) for (a, b), q in found.items())


def words_like(rng):
    kinds = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(kinds) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 4)):
        p = rng.randint(1, 7)
        w += ([rng.randrange(kinds) for _ in range(p)] * 9)[: rng.randint(1, 9 * p)]
        if w and rng.random() < 0.5:
            i = rng.randrange(len(w))
            w += w[i : rng.randint(i, len(w))] * rng.randint(1, 2)
    return w


def test_all_runs_of_many_documents_at_once():
    rng, seen = random.Random(3), 0
    for _ in range(400):
        docs = [words_like(rng) for _ in range(rng.randint(1, 6))]
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        want = [(a + o, b + o, q) for d, o in zip(docs, at.tolist(), strict=False) for a, b, q in brute(d)]
        assert [tuple(r) for r in all_runs(np.array(sum(docs, []), np.int64), at).tolist()] == want
        seen += len(want)
    assert seen > 1000


def test_suffix_array_and_previous_factors():
    rng = random.Random(5)
    for _ in range(100):
        w = words_like(rng)
        if not w:
            continue
        index = Index(np.array(w, np.int64), np.array([0, len(w)]))
        assert index.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        common = lambda i, j: next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
        length, source = previous_factors(index)
        for j in range(len(w)):
            assert length[j] == max((common(i, j) for i in range(j)), default=0)
            assert length[j] == 0 or common(int(source[j]), j) == length[j]


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        all_runs(np.zeros(9, np.int64), np.array([0, 9]), times=2)


def expected(doc_id, text, rewrite):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    where = rewrite(doc_id, len(words)) if rewrite else None
    words = [words[k] for k in where] if where is not None else words
    runs = brute(words)
    drop = {k for a, b, q in runs for k in range(a + q, b + 1)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(((-(b - a + 1), a, q) for a, b, q in runs), default=None)
    n = None if best is None else -best[0]
    top = (None, None, None, None) if best is None else (best[1], n, best[2], 1000 * n // best[2])
    return (doc_id, len(words), len(runs), *top, sha("".join(f"{a},{b - a + 1},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_rows_and_hard_cases(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 50), (5, "x y " * 8), (5, "x y " * 8), (None, "b b b b b b"), (6, "la le la le la le la le." + "\x0b" + "la le " * 9), (7, long), (8, "é\x1fè " * 6), (9, "one two three")]
    rows += [(k, " ".join(f"t{(k * j) % 7}" for j in range(90))) for k in range(10, 60)]
    df = spark.createDataFrame([(k, t, t, 1) for k, t in rows], "doc_id long, text string, n_runs string, key int")
    got = as_rows(collapse(df, rewrite=planted))
    want = {repr(expected(k, t, planted)) for k, t in rows if k != 7}
    assert {repr(r) for r in got if r[0] != 7} == want and len(got) == len(rows)
    assert next(r for r in got if r[0] == 7)[1:7] == (60_000, 1, 0, 60_000, 977, 61_412) or planted(7, 60_000) is not None
    assert as_rows(collapse(df.limit(0))) == []
    assert any(planted(k, 90) is not None for k in range(10, 60))


def test_text_ids_and_no_rewriting(spark):
    df = spark.createDataFrame([("u", "a b a b a b a b"), ("v", "a b a b a b a")], "id string, body string")
    got = {r.id: (r.n_runs, r.period, r.length) for r in collapse(df, key="id", text="body").collect()}
    assert got == {"u": (1, 2, 8), "v": (0, None, None)}
