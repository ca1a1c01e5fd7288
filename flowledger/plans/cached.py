"""Queries of cached runs over the given tables: items with several rows or none, changed sources, files and loops, failed items, scans, collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon
from ..operators import dynamic, run
from ..operators.graph import Pipeline
from .engine import _store
from .tables import V2, changed, read

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return register


def _counted(done, step: str):
    """The step's rows with how many items it had and how many of them came from the store."""
    items, hits = done.map_items[step]
    return done.artifacts[step].withColumns({"items": F.lit(items).cast("long"), "hits": F.lit(hits).cast("long")})


def _lines(docs) -> Pipeline:
    p = Pipeline()
    p.node("docs", cache="off")(lambda _: docs)

    @p.map("lines", items_from="docs", item="doc_id")
    def split(got):
        full = got["docs"].where("doc_id % 7 <> 0")
        return full.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said")).select("doc_id", "line", F.length("said").alias("chars"))

    return p


@query(f"""SELECT doc_id, unnest(range(len(l)))::INT AS line, length(unnest(l))::INT AS chars, (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS hits
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {V2} WHERE doc_id % 7 <> 0)""")
def run_item_rows(spark, sf):
    """A map gives a row for each line of a text, and none for each seventh text; after an edit, items without rows are hits like the others."""
    store = _store(spark)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    run.execute(_lines(docs), store)
    return _counted(run.execute(_lines(changed(docs)), store), "lines")


@query(f"""SELECT 1 AS run, 'miss' AS source, lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang UNION ALL
SELECT 2, 'miss', lang, count(*), sum(length(text))::BIGINT FROM {V2} GROUP BY lang UNION ALL SELECT 3, 'hit', lang, count(*), sum(length(text))::BIGINT FROM documents GROUP BY lang""")
def run_changed_source(spark, sf):
    """A stored source is keyed by its rows: another version of the table is computed anew, and the first version is found again."""
    store, docs, out = _store(spark), read(spark, sf, "documents").select("doc_id", "lang", "text"), None

    for n, rows in enumerate((docs, changed(docs), docs), 1):
        p = Pipeline()
        p.node("docs")(lambda _, rows=rows: rows)
        p.node("totals", ["docs"])(lambda got: got["docs"].groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")))
        done = run.execute(p, store)
        one = done.artifacts["totals"].select(F.lit(n).alias("run"), F.lit("hit" if done.cache_hits["docs"] and done.cache_hits["totals"] else "miss").alias("source"), "lang", "n", "chars")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'over_' || v.mark AS step, v.hit, c_nationkey, count(*) AS n FROM customer, (VALUES ('low', 0.0, 'hit'), ('mid', 3000.0, 'miss'), ('high', 9000.0, 'hit')) v(mark, least, hit)
WHERE c_acctbal >= v.least GROUP BY 1, 2, 3""")
def run_changed_loop(spark, sf):
    """One step for each item of a list: an item that changes makes its step a miss and no other."""
    store, rows = _store(spark), read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")

    def build(mid):
        p = Pipeline()
        p.node("rows", cache="off")(lambda _: rows)
        items = [{"mark": "low", "least": 0.0}, {"mark": "mid", "least": mid}, {"mark": "high", "least": 9000.0}]
        p.foreach("over_{mark}", items, ["rows"])(lambda got, mark, least: got["rows"].where(F.col("c_acctbal") >= least).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))
        return p

    run.execute(build(5000.0), store)
    done = run.execute(build(3000.0), store)
    out = None
    for name in ("over_low", "over_mid", "over_high"):
        one = done.artifacts[name].select(F.lit(name).alias("step"), F.lit("hit" if done.cache_hits[name] else "miss").alias("hit"), "c_nationkey", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _written(spark, folder: str, pages, parts: int) -> None:
    """A file `site=<n>/pages.txt` for each site, with its pages in order of their ids."""
    lines = pages.select((F.col("page_id") % parts).alias("site"), "page_id", F.concat(F.col("page_id").cast("string"), F.lit(" "), F.coalesce("html", F.lit(""))).alias("value"))
    lines.repartition(parts, "site").sortWithinPartitions("site", "page_id").select("site", "value").write.mode("overwrite").partitionBy("site").text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(at(f"{folder}/site=*/part-*")):  # one for each of the sites, whose number is fixed
        fs.rename(found.getPath(), at(found.getPath().getParent(), "pages.txt"))


SITES = 32


def _site_paths(items):
    return F.array(F.format_string("site=%d/pages.txt", items["site"]), F.format_string("site=%d/pages.txt", items["site"].bitwiseXOR(F.lit(1).cast("long"))))


@query(f"""WITH lines AS (SELECT page_id % {SITES} AS site, page_id, page_id || ' ' || coalesce(html, '') || CASE WHEN page_id % {SITES} = 9 THEN '!' ELSE '' END AS line FROM pages),
files AS (SELECT site, string_agg(line, chr(10) ORDER BY page_id) || chr(10) AS content FROM lines GROUP BY site)
SELECT a.site, sha256(CASE WHEN a.site < b.site THEN a.content || b.content ELSE b.content || a.content END) AS digest, (strlen(a.content) + strlen(b.content))::BIGINT AS bytes, {SITES}::BIGINT AS items, {SITES - 2}::BIGINT AS hits
FROM files a JOIN files b ON b.site = xor(a.site, 1)""")
def run_item_files(spark, sf):
    """Pages written as files, a file for each site; an item reads its own file and its neighbour's. After one file has changed, the two items
    that read it are computed and the others are hits."""
    store, pages = _store(spark), read(spark, sf, "pages").select("page_id", "html")
    folder = f"{store.root}-in"
    sites = pages.select((F.col("page_id") % SITES).alias("site")).distinct()

    def build():
        p = Pipeline()
        p.node("sites", cache="off")(lambda _: sites)

        @p.map("read", items_from="sites", item="site", files=["site=*/pages.txt"], files_fn=_site_paths)
        def digests(got):
            numbered = F.array_sort(F.transform("files", lambda f: F.struct(F.regexp_extract(f["path"], r"site=(\d+)/", 1).cast("int").alias("n"), f["content"].alias("content"))))
            both = F.concat(numbered[0]["content"], numbered[1]["content"])
            return got["sites"].select("site", F.sha2(both, 256).alias("digest"), F.octet_length(both).cast("long").alias("bytes"))

        return p

    _written(spark, folder, pages, SITES)
    run.execute(build(), store, root=folder)
    _written(spark, folder, pages.withColumn("html", F.when(F.col("page_id") % SITES == 9, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))), SITES)
    return _counted(run.execute(build(), store, root=folder), "read")


def _long_enough(item):
    if len(item["text"]) < 200:
        raise ValueError(f"only {len(item['text'])} characters")
    return [{"chars": len(item["text"])}]


@query("""WITH c AS (SELECT (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents WHERE length(text) >= 200 AND doc_id % 10 <> 0) AS hits)
SELECT doc_id, CASE WHEN length(text) >= 200 THEN length(text) END::INT AS chars, CASE WHEN length(text) < 200 THEN 'ValueError: only ' || length(text) || ' characters' END AS error,
CASE WHEN length(text) < 200 THEN 2 END::INT AS attempts, items, hits FROM """ + V2 + " x, c")  # fmt: skip
def run_failed_items(spark, sf):
    """Items that fail are tried twice and kept apart; the others' results are stored and are hits in the next run, in which failed ones are tried again."""
    store, docs = _store(spark), read(spark, sf, "documents").select("doc_id", "text")

    def build(rows):
        p = Pipeline()
        p.node("docs", cache="off")(lambda _: rows)
        p.map("measure", items_from="docs", item="doc_id", errors="error", retries=1, keep_errors=True)(lambda got: dynamic.per_item(got["docs"], "doc_id", _long_enough, "chars int"))
        return p

    run.execute(build(docs), store)
    done = run.execute(build(changed(docs)), store)
    items, hits = done.map_items["measure"]
    none = F.lit(None).cast("string")
    good = done.artifacts["measure"].select("doc_id", "chars", none.alias("error"), F.lit(None).cast("int").alias("attempts"))
    bad = done.item_errors["measure"].select(F.col("id").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("chars"), "error", "attempts")
    return good.unionByName(bad).withColumns({"items": F.lit(items).cast("long"), "hits": F.lit(hits).cast("long")})


def _spent(carry, item):
    cost = len(item["text"])
    ok = carry + cost <= 2000
    return (carry + cost if ok else carry), {"ok": ok, "spent": carry}


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN text || '?' ELSE text END) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, rn, 0::BIGINT AS spent, cost <= 2000 AS ok, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS after FROM c WHERE rn = 1
UNION ALL SELECT c.conv_id, c.turn, c.rn, r.after, r.after + c.cost <= 2000, r.after + CASE WHEN r.after + c.cost <= 2000 THEN c.cost ELSE 0 END FROM r JOIN c ON c.conv_id = r.conv_id AND c.rn = r.rn + 1),
o AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
q AS (SELECT conv_id, turn, rn, 0::BIGINT AS spent, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS after FROM o WHERE rn = 1
UNION ALL SELECT o.conv_id, o.turn, o.rn, q.after, q.after + CASE WHEN q.after + o.cost <= 2000 THEN o.cost ELSE 0 END FROM q JOIN o ON o.conv_id = q.conv_id AND o.rn = q.rn + 1)
SELECT r.conv_id, r.turn, r.ok, r.spent, (SELECT count(*) FROM conversations) AS items, (SELECT count(*) FROM r r2 JOIN q USING (conv_id, turn) WHERE r2.spent = q.spent AND NOT (conv_id % 5 = 0 AND turn = 2)) AS hits FROM r""")
def run_scan_edit(spark, sf):
    """A stored fold after an edit of the second turn of some conversations: each goes on from the carry before the edit, and where the carry
    becomes the old one again, later turns are hits."""
    store, turns = _store(spark), read(spark, sf, "conversations").select("conv_id", "turn", "text")

    def build(rows):
        p = Pipeline()
        p.node("turns", cache="off")(lambda _: rows)
        p.scan("spent", items_from="turns", chain="conv_id", by=["turn"], start=0, out="ok boolean, spent long")(_spent)
        return p

    run.execute(build(turns), store)
    edited = turns.withColumn("text", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return _counted(run.execute(build(edited), store), "spent")


@query("""SELECT run_id, node, cache, items, hits, 0::BIGINT AS failed FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 10 <> 0) AS same FROM documents),
LATERAL (VALUES ('run-0001', 'docs', 'miss', NULL, NULL), ('run-0001', 'lines', 'miss', n, 0), ('run-0002', 'docs', 'miss', NULL, NULL), ('run-0002', 'lines', 'miss', n, same)) v(run_id, node, cache, items, hits)""")
def run_profiled(spark, sf):
    """What each step of two stored runs did, joined from their rows."""
    store, docs = _store(spark), read(spark, sf, "documents").select("doc_id", "text")
    for rows in (docs, changed(docs)):
        run.execute(_lines(rows), store)
    return run.profile(store).select("run_id", "node", "cache", "items", "hits", "failed")


@query(f"""SELECT doc_id, length(text)::INT AS chars, sha256(text) AS digest, (SELECT count(*) FROM documents) AS hits, (SELECT count(*) FROM documents WHERE doc_id % 10 = 0) AS keys FROM {V2}""")
def run_collected(spark, sf):
    """Collection after two runs: the first version's own results go, the second run's are all there, and a third run finds every item."""
    store, docs = _store(spark), read(spark, sf, "documents").select("doc_id", "text")

    def build(rows):
        p = Pipeline()
        p.node("docs", cache="off")(lambda _: rows)
        p.map("measure", items_from="docs", item="doc_id")(lambda got: got["docs"].select("doc_id", F.length("text").alias("chars"), canon.sha(F.col("text")).alias("digest")))
        return p

    for rows in (docs, changed(docs)):
        run.execute(build(rows), store)
    went = run.gc(store, keep=1, grace=0.0)
    done = run.execute(build(changed(docs)), store)
    return done.artifacts["measure"].withColumns({"hits": F.lit(done.map_items["measure"][1]).cast("long"), "keys": F.lit(went["keys"]).cast("long")})


@query("""SELECT v.step, v.state FROM (SELECT count(*) AS n FROM documents), LATERAL (VALUES ('docs', 'miss'), ('measure', CASE WHEN n > 0 THEN 'miss' END), ('other', 'hit')) v(step, state)""")
def plan_of_sources(spark, sf):
    """Sources are read for their digests, so a plan knows what an edit of one table makes a miss and what stays a hit."""
    store, docs, pages = _store(spark), read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "pages").select("page_id", "url")

    def build(rows):
        p = Pipeline()
        p.node("docs", cache="off")(lambda _: rows)
        p.node("pages", cache="off")(lambda _: pages)
        p.map("measure", items_from="docs", item="doc_id")(lambda got: got["docs"].select("doc_id", F.length("text").alias("chars")))
        p.map("other", items_from="pages", item="page_id")(lambda got: got["pages"].select("page_id", F.length("url").alias("chars")))
        return p

    run.execute(build(docs), store)
    states = run.plan(build(changed(docs)), store, read_sources=True)
    rows = docs.sparkSession.createDataFrame([(n, s) for n, s in states.items() if n != "pages"], "step string, state string")
    return rows
