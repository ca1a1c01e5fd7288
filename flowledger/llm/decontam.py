"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set, each class between two powers of two. A long document is read as
windows of two neighbouring blocks of a class's upper size: a passage of an item's length lies in one such window, whose
similarity to the item is then 0.19 or more, however long the document is. Each of HASHES functions has a minimum over a
window (minima of small blocks serve the larger classes) and over an item; one equal minimum makes a candidate, so that a
passage with the asked containment is missed with a chance below 2e-6. A candidate is verified exactly: the share of the
item's shingles that are in the document's whole set must be `percent` or more.

An item may also lie in small bits all over a document: each shared shingle is in some window, which with the item has at
most 5 times the item's shingles, so that each function finds the item with a chance of 0.8 / 5 or more wherever the bits
are, and all of them miss it with a chance below 1.5e-5. `exact=True` adds a search that misses nothing: a document with
n_shared of an item's n shingles lacks n - n_shared of them, so it has one of any n - n_shared + 1. Those that the fewest
items have are looked up in all documents, and what has one is verified as the others are.

Items are searched in blocks of at most BLOCK shingles, each broadcast (8 bytes a shingle and hash), so that a larger
benchmark means more passes over the documents and never a larger broadcast.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z as a-z. Nulls: null or wordless
texts and items match nothing; ids may be null and are cast to long. Repeated rows give repeated results. Further columns are
ignored. An item's minima are made function by function, so a very long item takes its own size a few times over.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table
from .shingles import NOT_ALNUM, shingles

K, PERCENT, HASHES, BLOCK = 5, 80, 64, 500_000
SPAN = 1 << 15
_rng = np.random.default_rng(7)
TIMES = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


class Index:
    """Items by size class: which item has a minimum; and which has a shingle that few items have."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int = PERCENT, exact: bool = False) -> None:
        self.items = items
        self.rare = self._rare(percent) if exact else None
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.maybe = np.zeros(1 << 20, bool)
        by: dict[int, list[int]] = {}
        for i, (_, s) in enumerate(items):
            by.setdefault(max(0, int(len(s) - 1).bit_length()), []).append(i)
        for bits, members in sorted(by.items()):
            least = np.concatenate([np.array([(self.items[i][1] * t + p).min() for t, p in zip(TIMES, PLUS, strict=True)], np.uint64) for i in members])
            order = np.argsort(least, kind="stable")
            self.classes[bits] = (least[order], np.repeat(members, HASHES)[order])
            self.maybe[(least >> np.uint64(44)).astype(np.int64)] = True

    def _rare(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which leading bits occur, shingles in order, their items): of each item as many as no document with the asked share can lack."""
        pool, held_by = np.unique(np.concatenate([s for _, s in self.items]), return_counts=True)
        least = []
        for _, s in self.items:
            n = len(s) - -(-percent * len(s) // 100) + 1
            least.append(s[np.argsort(held_by[np.searchsorted(pool, s)], kind="stable")[:n]])
        known, of = np.concatenate(least), np.repeat(np.arange(len(least)), [len(x) for x in least])
        order, maybe = np.argsort(known, kind="stable"), np.zeros(1 << 20, bool)
        maybe[(known >> np.uint64(44)).astype(np.int64)] = True
        return maybe, known[order], of[order]

    def lacking_few(self, run: np.ndarray) -> set[int]:
        """Items of which the document has a shingle that few items have."""
        maybe, known, of = self.rare
        hit = np.unique(run[maybe[(run >> np.uint64(44)).astype(np.int64)]])
        at, to = np.searchsorted(known, hit), np.searchsorted(known, hit, "right")
        return {i for a, b in zip(at[at < to].tolist(), to[at < to].tolist(), strict=True) for i in of[a:b].tolist()}

    def candidates(self, run: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document's shingles, in order."""
        low = min(self.classes)
        size, found = 1 << low, set()
        span = max(SPAN, size) // size * size
        parts = []
        for a in range(0, len(run), span):
            part = run[a : a + span]
            x = part[None, :] * TIMES[:, None] + PLUS[:, None]
            if len(part) % size:
                x = np.concatenate([x, np.full((HASHES, size - len(part) % size), np.uint64(2**64 - 1))], axis=1)
            parts.append(x.reshape(HASHES, -1, size).min(2))
        blocks = np.concatenate(parts, axis=1) if len(parts) > 1 else parts[0]
        for bits in range(low, max(self.classes) + 1):
            if bits > low:
                if blocks.shape[1] % 2:
                    blocks = np.concatenate([blocks, np.full((HASHES, 1), np.uint64(2**64 - 1))], axis=1)
                blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            if bits in self.classes:
                windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
                hit = windows[self.maybe[(windows >> np.uint64(44)).astype(np.int64)]]
                if len(hit):
                    known, of = self.classes[bits]
                    at, to = np.searchsorted(known, hit), np.searchsorted(known, hit, "right")
                    for a, b in {(a, b) for a, b in zip(at.tolist(), to.tolist(), strict=True) if a < b}:
                        found.update(of[a:b].tolist())
        return found

    def leaks(self, run: np.ndarray, percent: int):
        """(item id, its shingles, shared) of verified items."""
        held = None
        for i in sorted(self.candidates(run) | (self.lacking_few(run) if self.rare else set())):
            held = np.unique(run) if held is None else held
            name, s = self.items[i]
            at = np.minimum(np.searchsorted(held, s), len(held) - 1)
            shared = int((held[at] == s).sum())
            if 100 * shared >= percent * len(s):
                yield name, len(s), shared


def item_sets(bench: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [np.unique(s) for s in shingles(batch.column(1), k, NOT_ALNUM)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "n", "shingles"])

    rows = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id long, n long, shingles binary").where("n > 0")


def leaks(docs: DataFrame, bench: DataFrame, *, k: int = K, percent: int = PERCENT, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all documents and items with the asked containment."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = materialise(item_sets(bench, k))
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block))
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = []
    for b in range(blocks if total else 0):  # one block at a time is on the driver and on the executors
        part = sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b).select("item_id", "shingles")
        held = spark.sparkContext.broadcast([(r.item_id, bytes(r.shingles)) for r in part.collect()])  # about `block` shingles
        if not held.value:
            continue
        found = rows.mapInArrow(_search(held, k, percent, exact), schema)
        if blocks > 1:
            found = materialise(found)
            held.destroy()
        parts.append(found)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _search(held, k: int, percent: int, exact: bool):
    def run(batches):
        index = Index([(i, np.frombuffer(s, np.uint64)) for i, s in held.value], percent, exact)
        for batch in batches:
            ids, found = batch.column(0), []
            for at, run in enumerate(shingles(batch.column(1), k, NOT_ALNUM)):
                if len(run):
                    found += [(at, *hit) for hit in index.leaks(run, percent)]
            at, item, n, shared = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            share = np.array(shared, float) / np.maximum(np.array(n, float), 1)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array(share, pa.float64())],
                names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
            )

    return run


def op3(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = lambda t, key: f"SELECT DISTINCT rid, {key}, list_aggregate(w[i + 1 : i + {K}], 'string_agg', ' ') AS g FROM (SELECT rid, {key}, w, unnest(range(greatest(len(w) - {K - 1}, least(len(w), 1)))) AS i FROM {t})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents), b AS (SELECT row_number() OVER () AS rid, item_id, {words} AS w FROM benchmark),
dg AS ({grams("d", "doc_id")}), bg AS ({grams("b", "item_id")}), n AS (SELECT rid, count(*) AS n_item FROM bg GROUP BY 1),
m AS (SELECT dg.rid AS drid, bg.rid AS brid, doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared::DOUBLE / n_item AS containment FROM m JOIN n ON n.rid = brid WHERE 100 * n_shared >= {PERCENT} * n_item"""


QUERIES = {"op3_decontamination": op3}
ORACLE = {"op3_decontamination": _oracle()}
