"""Near-duplicate groups by bottom-k sketches, with exact links.

1. One hash function gives each text its set of shingle hashes; its sketch is the SKETCH smallest. Texts with the same set
   form a class, which one document stands for from here on: copies cost one row each.
2. Inverted lists: the sketches' values, counted over all classes. Two sets of similarity >= 0.8 share about 0.8 of their
   sketches; at least OVERLAP of the smaller one is asked for (more than five standard deviations below). Then they share one
   of the (1 - OVERLAP) part of either sketch that is rarest over the corpus, and only that part is listed. So a line that a
   third of all texts share lists only those texts that consist of little else.
3. Lists of at most SHORT members give all their pairs. In a longer list each member is paired with the list's hub, the
   member with the most frequent values (the likely original). Union-sketch estimation drops pairs far below the threshold, and exact
   similarity of the full sets decides. Links make components.
4. Long lists that are not yet in one component are joined to groups, and a group is compared in blocks: every two members that
   are still in different components, exactly, by their full sets. Thus no link between different components is lost to step 3.

Links need 100 * |intersection| >= percent * |union|. Sets are of 64-bit hashes of the shingles.

Nulls: a null or wordless text has an empty set and is linked with nothing, itself its component. A null document id is a
document of its own kind with a null component. Rows that repeat a document id count as one document, so what any of them
is linked with is reachable from all. Empty tables give empty results; further columns are ignored; ids are cast to long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, small_batches, table
from .components import components
from .shingles import SPACE, mix, shingles

SKETCH, OVERLAP, SHORT, BLOCK = 48, 0.5, 16, 256
#: Documents up to which a list of ids is broadcast (8 bytes each).
BROADCAST_IDS = 500_000
SALT = np.uint64(0xD6E8FEB86659FD93)


def _sets(column: pa.Array, k: int, breaks) -> Iterator[np.ndarray]:
    for run in shingles(column, k, breaks):
        yield np.unique(run)


def sketches(docs: DataFrame, k: int, size: int = SKETCH, breaks=SPACE) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): set size, a 128-bit digest of the set, its smallest values."""

    def run(batches):
        for batch in batches:
            n, d1, d2, low = [], [], [], []
            for s in _sets(batch.column(1), k, breaks):
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64)))
                d2.append(int(mix(s ^ SALT).sum(dtype=np.uint64)))
                low.append(s[:size].view(np.int64))
            cols = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2))]
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(low) if low else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, k: int, breaks=SPACE) -> DataFrame:
    """(node, shingles): the sets of the documents whose id is in ids (node), as bytes."""

    def run(batches):
        for batch in batches:
            held = [s.tobytes() for s in _sets(batch.column(1), k, breaks)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["node", "shingles"])

    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(F.broadcast(ids) if few else ids, "node", "left_semi")
    return wanted.mapInArrow(run, "node long, shingles binary")


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _estimate(size: int):
    """Similarity by the sketch of the union: the share of its values that both sketches have."""
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, size)
    return F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, size: int, breaks=SPACE) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    near = known.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_estimate(size) >= percent / 100 - 5 * 0.4 / size**0.5))
    near = materialise(near.select("a", "b").distinct())
    held = materialise(full_sets(docs, near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k, breaks))
    whole = near.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(whole.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long").distinct())


def _block_links(percent: int):
    """Links between members of two blocks that are in different components; rows (task, side, node, comp, shingles), a task's rows together."""

    def links(rows):
        left, right = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1] or None
        ours, theirs = left, right if right is not None else left
        sets = [np.frombuffer(r[3], np.uint64) for r in theirs]
        sizes = np.array([len(s) for s in sets])
        vocab, ids = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        starts, comps = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), np.array([r[2] for r in theirs])
        out = set()
        for _, node, comp, held in ours:
            mine = np.frombuffer(held, np.uint64)
            other = comps != comp
            other &= (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))) & (sizes > 0)
            if not other.any():
                continue
            at = np.minimum(np.searchsorted(vocab, mine), len(vocab) - 1)
            flag = np.zeros(len(vocab), np.int32)
            flag[at[vocab[at] == mine]] = 1
            both = np.add.reduceat(flag[ids], starts)
            hit = other & (100 * both >= percent * (sizes + len(mine) - both))
            for c in np.unique(comps[hit]):
                out.add((node, theirs[int(np.flatnonzero(hit & (comps == c))[0])][1]))
        return out

    def run(batches):
        task, rows = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for t, *row in zip(*cols, strict=True):
                if t != task and rows:
                    if found := links(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                    rows = []
                task = t
                rows.append(row)
        if rows and (found := links(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def rest_of_lists(lists: DataFrame, comp: DataFrame, docs: DataFrame, k: int, percent: int, breaks=SPACE) -> DataFrame:
    """Links between members of long lists (v, node) that are in different components."""
    held = lists.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    mixed = held.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("v")
    held = materialise(held.join(mixed, "v").select("v", "node", "comp"))
    heads = held.groupBy("v").agg(F.min("node").alias("head"))
    group = components(held.join(heads, "v").select(F.col("node").alias("src"), F.col("head").alias("dst")))
    members = held.select("node", "comp").distinct().join(group.withColumnRenamed("component", "grp"), "node")
    blocks = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = members.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = materialise(members.join(full_sets(docs, members.select("node"), k, breaks), "node"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    sent = members.select("grp", "node", "comp", "shingles", F.explode(pairs).alias("p"))
    sent = sent.select(F.concat_ws(":", "grp", "p.i", "p.j").alias("task"), F.col("p.side").alias("side"), "node", "comp", "shingles")
    dealt = sent.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, sketch: int = SKETCH, breaks=SPACE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    made = materialise(sketches(docs, k, sketch, breaks))
    filled = made.where("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    reps = materialise(classes.select("node", "n", "d1", "d2", "sketch"))
    copies = materialise(filled.join(reps.select("n", "d1", "d2", "node"), ["n", "d1", "d2"]).select("doc_id", "node"))

    values = reps.select("node", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(often, "v")
    each = W.partitionBy("node")
    ranked = shared.withColumns({
        "rank": F.row_number().over(each.orderBy("df", "v")), "n_shared": F.count(F.lit(1)).over(each), "weight": F.sum("df").over(each) / F.col("size"),
    })
    # of the size - floor(size * OVERLAP) + 1 rarest values, size - n_shared are in no other sketch
    listed = ranked.where(F.col("rank") <= F.col("n_shared") - F.floor(F.col("size") * OVERLAP) + 1)
    listed = materialise(listed.select("v", "node", "weight"))
    sizes = listed.groupBy("v").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("weight", (-F.col("node")).alias("hub"))).alias("top"))
    sizes = sizes.where("members > 1").select("v", "members", (-F.col("top.hub")).alias("hub"))
    lists = listed.join(sizes, "v")
    star = lists.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    short = lists.where(F.col("members").between(3, SHORT)).groupBy("v").agg(F.array_sort(F.collect_list("node")).alias("all"))
    short = short.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.slice("all", F.col("at") + 2, SHORT)).alias("b"))
    links = verified(star.unionByName(short).distinct(), reps, docs, k, percent, sketch, breaks)
    # rows that share an id are one document, whatever their classes
    one = copies.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a <> top").select("doc_id", "a")
    same = copies.join(one, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    comp = materialise(components(links.unionByName(same), "a", "b"))
    long = lists.where(F.col("members") > SHORT).select("v", "node")
    more = materialise(rest_of_lists(long, comp, docs, k, percent, breaks))
    # classes whose documents share an id are one document; links between components join those
    ends = more.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    joined = components(ends.select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst")))
    linked = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    alone = joined.join(comp, "node", "left_anti")
    linked = linked.unionByName(alone.select("node", "component"))
    of = copies.join(linked, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = made.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i + 1 : i + 4], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS rk FROM s JOIN (SELECT g, count(*) AS df FROM s GROUP BY 1) USING (g)),
p AS (SELECT doc_id, g FROM r JOIN n USING (doc_id) WHERE rk <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
k AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
j AS (SELECT a, b, count(*) AS met FROM k JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

QUERIES = {"op6_near_duplicates": op6}
ORACLE = {"op6_near_duplicates": ORACLE_SQL}
