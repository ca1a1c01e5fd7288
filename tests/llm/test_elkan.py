"""Vector codes against the search over all entries, and what pruning saves."""

import hashlib
import math
from fractions import Fraction

import numpy as np

from flowledger.llm.elkan import UNKNOWN, Books, assign, compress, first_units, roots


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[s[1][p * w : (p + 1) * w] for s in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = v[p * w : (p + 1) * w]
                groups.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, min(e, 2**63 - 1), min(by_label[label], 2**63 - 1), sha) for i, c, e, label in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_the_search_over_all_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=32)], [None, 0, 1][i % 3]) for i in range(300)]
    rows += [(i, [float(x) / 256 for x in rng.integers(-2, 3, 32)], 4) for i in range(300, 420)]  # many ties
    rows += [rows[5], (900, None, 1), (901, [1.0] * 31 + [None], 1), (902, [float("nan")] * 32, 1), (903, [float("-inf")] * 32, 1)]
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<float>, label int, code string")
    exact = [(i, [None if x is None else float(np.float32(x)) for x in v] if v else v, y) for i, v, y in rows]
    assert rows_of(compress(df)) == brute(exact)


def test_huge_components_few_rows_odd_lengths_and_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) * 1e30 for x in rng.integers(-3, 4, 32)], None) for i in range(90)]
    schema = "vec_id long, embedding array<double>, label string"
    assert rows_of(compress(spark.createDataFrame(rows, schema))) == brute(rows)
    few = [(3, [0.5] * 16, "a"), (1, [0.25] * 16, None), (None, [0.5] * 16, "a")]
    odd = [(2, [0.5] * 32, "a"), (4, [0.5] * 15, "a"), (5, [], "a")]
    assert rows_of(compress(spark.createDataFrame(few + odd, schema))) == brute(few)
    assert rows_of(compress(spark.createDataFrame([], schema))) == []


def test_bounds_prune_and_stay_bounds():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(2000, 4)) * 256).astype(np.int64)
    entries = x[None, :64]
    books = Books(entries, first_units(entries))
    code, upper, lower = np.zeros(2000, np.uint8), np.full(2000, UNKNOWN, np.uint16), np.zeros((2000, 64), np.uint8)
    for step in range(3):
        squared = ((x[:, None] - books.entries[0][None]) ** 2).sum(-1)
        _, done = assign(x, code, upper, lower, books, 0)
        assert (code == squared.argmin(1)).all()
        unit, d = books.units[0], np.sqrt(squared)
        assert (lower * unit <= d + 1e-9).all() and (upper.astype(int) * unit >= d.min(1) - 1e-9).all()
        assert done < (2000 * 64 * 0.5 if step == 0 else 2000 * 64 * 0.2)
        moved = np.floor(books.entries + rng.normal(size=books.entries.shape) * 3).astype(np.int64)
        books = Books(moved, books.units, books.entries)


def test_whole_roots():
    d = np.array([0, 1, 3, 4, (2**31 - 1) ** 2 - 1, (2**31 - 1) ** 2, 2**61], np.int64)
    assert roots(d).tolist() == [math.isqrt(v) for v in d.tolist()] == roots(d.astype(object)).tolist()
