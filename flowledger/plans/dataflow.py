"""Queries of fan-out, folds, graphs, caches and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon
from ..operators import cache, dynamic, graph, ordered, scans
from .tables import V2, changed, literal_rows, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _daily(inputs):
    return inputs["lineitem"].groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_shipdate::DATE AS day, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def node_chain(spark, sf):
    p = graph.Pipeline()
    p.node("lineitem")(lambda _: read(spark, sf, "lineitem"))
    p.node("daily", ["lineitem"], consumes={"lineitem": ["l_shipdate", "l_quantity"]})(_daily)
    return p.run(["daily"]).artifacts["daily"]


@query("SELECT o_orderkey, o_orderstatus || '-' || o_orderpriority AS label, (o_orderkey % 7)::BIGINT AS slot, substr(sha256(o_orderkey::VARCHAR), 1, 12) AS item_id FROM orders")
def map_items(spark, sf):
    fn = lambda df: df.select("o_orderkey", F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("label"), (F.col("o_orderkey") % 7).alias("slot"), F.substring(canon.sha(F.col("o_orderkey").cast("string")), 1, 12).alias("item_id"))
    return dynamic.map_items(read(spark, sf, "orders"), fn)


@query(f"SELECT n.doc_id, n.text = o.text AS hit, reverse(n.text) || length(n.text) AS artifact FROM {V2} n LEFT JOIN documents o ON o.doc_id = n.doc_id")
def map_incremental(spark, sf):
    """The same with an artifact of the whole text."""
    return _map_incremental(spark, sf, F.concat(F.reverse("text"), F.length("text").cast("string")))


def _map_incremental(spark, sf, compute):
    keyed = lambda df: df.select("doc_id", "text", canon.component_digest(("item", canon.sha(F.col("text"))), ("source", canon.sha(F.lit("fn-1")))).alias("key"))
    first = keyed(read(spark, sf, "documents")).select("key", compute.alias("artifact")).dropDuplicates(["key"])
    held = first.withColumn("artifact_sha256", canon.sha(F.col("artifact")))
    new = keyed(changed(read(spark, sf, "documents"))).withColumn("fresh", F.col("doc_id") % 10 == 0)
    return cache.incremental(new, held, compute, forced=F.col("fresh")).select("doc_id", "hit", "artifact")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids, count(*) AS count FROM lineitem GROUP BY l_orderkey")
def map_aggregate(spark, sf):
    lines = read(spark, sf, "lineitem").withColumn("id", F.concat_ws(":", "l_linenumber", "l_partkey"))
    done = dynamic.aggregate(lines, "l_orderkey", "id", ["l_linenumber", "l_partkey", "l_suppkey"])
    return done.select("l_orderkey", F.array_join("order", ",").alias("ids"), "count")


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_id, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def map_aggregate_fn(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id, user_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS total FROM events")
def scan_running_total(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    return dynamic.running_total(read(spark, sf, "events"), "user_id", ["ts", "event_id"], cents, "total").select("event_id", "user_id", "total")


def _ordered_sql(start: str, step: str, out: str, columns: str = "") -> str:
    """A fold in SQL: a recursive query over numbered rows."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
r AS (SELECT user_id, event_id, rn, {start} {columns} FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, {step} FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, {out} FROM r"""


@query(_ordered_sql("least(100, greatest(0, 50 + CASE WHEN event_type = 'error' THEN -40 ELSE k END)) AS balance", "least(100, greatest(0, r.balance + CASE WHEN e.event_type = 'error' THEN -40 ELSE e.k END))", "balance::BIGINT AS balance"))
def scan_fold(spark, sf):
    """A balance held between 0 and 100, which no window can express."""
    e = read(spark, sf, "events").withColumn("move", F.when(F.col("event_type") == "error", -40).otherwise(F.get_json_object("props", "$.k").cast("long")))

    def step(balance, row):
        now = min(100, max(0, balance + (row["move"] or 0)))
        return now, {"balance": now}

    return scans.fold(e.select("user_id", "ts", "event_id", "move"), "user_id", ["ts", "event_id"], 50, step, "balance long").select("user_id", "event_id", "balance")


@query(_ordered_sql("CASE WHEN event_type = 'error' THEN 4 ELSE 8 END AS cap, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS streak",
    "CASE WHEN e.event_type = 'error' THEN greatest(1, r.cap // 2) WHEN r.streak + 1 >= 3 THEN least(8, r.cap + 1) ELSE r.cap END, CASE WHEN e.event_type = 'error' OR r.streak + 1 >= 3 THEN 0 ELSE r.streak + 1 END", "cap::INT AS capacity"))
def adaptive_capacity(spark, sf):
    """Half the slots after a throttle, one more after three successes in a row; between 1 and 8, and 8 at first."""
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))

    def step(state, row):
        cap, streak = state
        full = streak + 1 >= 3
        cap = max(1, cap // 2) if row["bad"] else min(8, cap + 1) if full else cap
        return (cap, 0 if row["bad"] or full else streak + 1), {"capacity": cap}

    return scans.fold(e, "user_id", ["ts", "event_id"], (8, 0), step, "capacity int").select("user_id", "event_id", "capacity")


@query(_ordered_sql("CASE WHEN k <= 300 THEN k ELSE 0 END AS used, CASE WHEN k <= 300 THEN 1 ELSE 0 END AS n, k <= 300 AS keep", "r.used + CASE WHEN r.n < 5 AND r.used + e.k <= 300 THEN e.k ELSE 0 END, r.n + CASE WHEN r.n < 5 AND r.used + e.k <= 300 THEN 1 ELSE 0 END, r.n < 5 AND r.used + e.k <= 300", "keep AS kept"))
def trajectory_cap(spark, sf):
    """Events kept while their number and size stay below caps; a dropped event doesn't stop later, smaller ones."""
    e = read(spark, sf, "events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def step(state, row):
        used, n = state
        fits = row["k"] is not None and n < 5 and used + row["k"] <= 300
        return ((used + row["k"], n + 1) if fits else state), {"kept": fits}

    return scans.fold(e, "user_id", ["ts", "event_id"], (0, 0), step, "kept boolean").select("user_id", "event_id", "kept")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, greatest(1, length(text) // 4 * 2) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT conv_id, turn, rn, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS spent, cost <= 600 AS ok FROM c WHERE rn = 1
UNION ALL SELECT c.conv_id, c.turn, c.rn, r.spent + CASE WHEN r.spent + c.cost <= 600 THEN c.cost ELSE 0 END, r.spent + c.cost <= 600 FROM r JOIN c ON c.conv_id = r.conv_id AND c.rn = r.rn + 1)
SELECT conv_id, turn, ok AS admitted FROM r""")
def budget_admission(spark, sf):
    """A call is admitted if its estimate fits what is left; a denied one spends nothing."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.greatest(F.lit(1).cast("long"), F.floor(F.length("text") / 4).cast("long") * 2).alias("cost"))

    def step(spent, row):
        fits = spent + row["cost"] <= 600
        return (spent + row["cost"] if fits else spent), {"admitted": fits}

    return scans.fold(c, "conv_id", ["turn"], 0, step, "admitted boolean").select("conv_id", "turn", "admitted")


@query("SELECT conv_id, turn, bool_and(NOT (conv_id % 5 = 0 AND turn = 2)) OVER (PARTITION BY conv_id ORDER BY turn) AS hit FROM conversations")
def scan_prefix_reuse(spark, sf):
    """After an edit of turn 2 of some conversations the turns before it are hits, it and those after it are not."""
    c = read(spark, sf, "conversations")
    new = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return dynamic.prefix_reuse(c, "conv_id", ["turn"], canon.sha(F.col("text")) == canon.sha(new)).select("conv_id", "turn", "hit")


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def foreach_regions(spark, sf):
    p = graph.Pipeline()
    p.node("customers")(lambda _: read(spark, sf, "customer").select("c_nationkey"))
    names = [(r.r_regionkey, r.r_name) for r in read(spark, sf, "region").orderBy("r_regionkey").collect()]  # the five regions are the declared items

    @p.foreach("region_{key}", [{"key": k, "name": n} for k, n in names], ["customers"])
    def one(inputs, key, name):
        nations = read(spark, sf, "nation").where(F.col("n_regionkey") == key).select("n_nationkey")
        return inputs["customers"].join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).agg(F.count(F.lit(1)).alias("customers")).select(F.lit(name).alias("region"), "customers")

    done = p.run().artifacts
    out = done[f"region_{names[0][0]}"]
    for k, _ in names[1:]:
        out = out.unionByName(done[f"region_{k}"])
    return out.where("customers > 0")


@query("SELECT 'customers' AS mount, c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', s_nationkey, count(*), round(sum(s_acctbal), 2) FROM supplier GROUP BY 2")
def subgraph_two_mounts(spark, sf):
    t = graph.Template(["rows"], ["totals"])
    t.node("totals", ["rows"])(lambda i: i["rows"].groupBy("nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance")))
    p = graph.Pipeline()
    p.node("customer")(lambda _: read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    p.node("supplier")(lambda _: read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))
    a, b = p.mount(t, "customers", {"rows": "customer"})["totals"], p.mount(t, "suppliers", {"rows": "supplier"})["totals"]
    done = p.run([a, b]).artifacts
    return done[a].select(F.lit("customers").alias("mount"), "*").unionByName(done[b].select(F.lit("suppliers").alias("mount"), "*"))


@query("SELECT c_custkey, sha256('{' || chr(10) || '  \"c_custkey\": ' || c_custkey || ',' || chr(10) || '  \"c_mktsegment\": ' || to_json(c_mktsegment) || chr(10) || '}') AS key, true AS same FROM customer")
def consumes_invariance(spark, sf):
    """The key of the consumed view doesn't change with a column that isn't consumed."""
    view = lambda df: df.select("c_custkey", canon.sha(canon.canonical_struct(c_custkey=(F.col("c_custkey"), "bigint"), c_mktsegment=(F.col("c_mktsegment"), "string"))).alias("key"))
    a, b = view(read(spark, sf, "customer")), view(read(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal") + 1)).withColumnRenamed("key", "other")
    return a.join(b, "c_custkey").select("c_custkey", "key", (F.col("key") == F.col("other")).alias("same"))


GRAPH = [("ingest", "extract"), ("ingest", "profile"), ("extract", "validate"), ("labels", "validate"), ("validate", "stats"), ("profile", "report"), ("stats", "report")]
NODES = ["ingest", "labels", "extract", "profile", "validate", "stats", "report"]
EDGE_SQL = "e(src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GRAPH) + ")"
NODE_SQL = "n(name, pos) AS (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(NODES)) + ")"


def _graph(spark):
    return literal_rows(spark, "name pos", [(x, i) for i, x in enumerate(NODES)]), literal_rows(spark, "src dst", GRAPH)


WAVES = f"WITH RECURSIVE {EDGE_SQL}, {NODE_SQL}, r(name, depth) AS (SELECT name, 0 FROM n UNION ALL SELECT dst, depth + 1 FROM r JOIN e ON src = name)"


@query(f"{WAVES} SELECT name, max(depth)::INT AS wave FROM r GROUP BY name")
def graph_waves(spark, sf):
    return graph.waves(spark, *_graph(spark))


@query(f"{WAVES} SELECT name, (row_number() OVER (ORDER BY max(depth), any_value(pos)))::INT AS place FROM r JOIN n USING (name) GROUP BY name")
def topo_levels(spark, sf):
    nodes, edges = _graph(spark)
    return graph.waves(spark, nodes, edges).join(nodes, "name").select("name", F.row_number().over(W.orderBy("wave", "pos")).alias("place"))


DOWN = f"WITH RECURSIVE {EDGE_SQL}, {NODE_SQL}, r(root, name) AS (SELECT name, name FROM n UNION SELECT root, dst FROM r JOIN e ON src = name)"


@query(f"{DOWN} SELECT root, name FROM r WHERE root <> name")
def graph_downstream(spark, sf):
    nodes, edges = _graph(spark)
    return graph.closure(spark, edges, nodes.select("name"))


@query(f"{DOWN}, s AS (SELECT name, CASE name WHEN 'extract' THEN 'retry_pending' WHEN 'ingest' THEN 'success' WHEN 'labels' THEN 'success' ELSE 'waiting' END AS state FROM n), bad AS (SELECT DISTINCT r.name FROM r JOIN s ON s.name = root AND state = 'retry_pending' WHERE root <> r.name) SELECT s.name, CASE WHEN s.name IN (SELECT name FROM bad) THEN 'skipped' WHEN state = 'waiting' AND NOT EXISTS (SELECT 1 FROM e JOIN s p ON p.name = e.src WHERE e.dst = s.name AND p.state <> 'success') THEN 'ready' ELSE state END AS state FROM s")
def skip_propagation(spark, sf):
    """Everything below a pending step is skipped; a step whose dependencies all succeeded is ready."""
    nodes, edges = _graph(spark)
    state = F.when(F.col("name") == "extract", "retry_pending").when(F.col("name").isin("ingest", "labels"), "success").otherwise("waiting")
    return graph.skips(spark, nodes.select("name", state.alias("state")), edges)


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_error, count(*) - 1 AS others FROM events WHERE event_type = 'error' GROUP BY user_id")
def first_failure(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_error"), (F.count(F.lit(1)) - 1).alias("others"))


STATUS = "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'ambiguous' WHEN event_type = 'error' THEN 'retry_scheduled' WHEN event_id % 3 = 0 THEN 'checkpoint_pending' ELSE 'completed' END"


@query(f"SELECT user_id, CASE WHEN bool_or(s = 'ambiguous') THEN 'ambiguous' WHEN bool_or(s = 'retry_scheduled') THEN 'pending_retry' WHEN bool_or(s = 'checkpoint_pending') THEN 'checkpoint_pending' ELSE 'completed' END AS status FROM (SELECT user_id, {STATUS} AS s FROM events) GROUP BY user_id")
def run_status(spark, sf):
    return read(spark, sf, "events").withColumn("s", F.expr(STATUS)).groupBy("user_id").agg(graph.run_status(F.col("s")).alias("status"))


@query("WITH f(sel) AS (VALUES ('extract@3'), ('extract@5'), ('extract@x'), ('stats')) SELECT doc_id, doc_id::VARCHAR IN (SELECT split_part(sel, '@', 2) FROM f WHERE contains(sel, '@')) AS forced, (SELECT count(*) FROM f WHERE contains(sel, '@') AND split_part(sel, '@', 2) NOT IN (SELECT doc_id::VARCHAR FROM documents)) AS n_unknown FROM documents")
def force_selection(spark, sf):
    """`step@item` selectors that name an item force it; those that name none are counted as unknown."""
    items = read(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item"))
    sel = literal_rows(spark, "sel", [("extract@3",), ("extract@5",), ("extract@x",), ("stats",)]).where(F.col("sel").contains("@")).select(F.split_part("sel", F.lit("@"), F.lit(2)).alias("item"))
    unknown = sel.join(items, "item", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))
    forced = items.join(F.broadcast(sel.withColumn("f", F.lit(True))), "item", "left")
    return forced.crossJoin(F.broadcast(unknown)).select("doc_id", F.coalesce("f", F.lit(False)).alias("forced"), "n_unknown")


@query(f"{DOWN}, late AS (SELECT DISTINCT name FROM r WHERE root IN ('extract') AND root <> name) SELECT name, CASE WHEN name IN (SELECT name FROM late) THEN 'unknown' WHEN name = 'extract' THEN 'miss' ELSE 'hit' END AS state FROM n")
def plan_forecast(spark, sf):
    nodes, edges = _graph(spark)
    return cache.forecast(nodes.select("name", (F.col("name") != "extract").alias("cached")), edges)


def _components(df):
    parts = F.array(F.struct(F.lit("item").alias("label"), canon.sha(F.col("text")).alias("digest")), F.struct(F.lit("lang").alias("label"), canon.sha(F.col("lang")).alias("digest")))
    return df.select("doc_id", F.explode(parts).alias("c")).select("doc_id", "c.label", "c.digest")


@query(f"SELECT n.doc_id, 'item' AS label, sha256(o.text) AS old, sha256(n.text) AS new FROM {V2} n JOIN documents o USING (doc_id) WHERE n.text <> o.text UNION ALL SELECT doc_id, 'carry', '<缺失>', sha256(source) FROM documents WHERE doc_id % 50 = 0")
def explain_components(spark, sf):
    d = read(spark, sf, "documents")
    extra = d.where("doc_id % 50 = 0").select("doc_id", F.lit("carry").alias("label"), canon.sha(F.col("source")).alias("digest"))
    return cache.explain(_components(d), _components(changed(d)).unionByName(extra), ["doc_id"])


@query("""SELECT doc_id, sha256('{' || chr(10) || '  "item": "' || sha256(text) || '",' || chr(10) || '  "params": "' || sha256(lang) || '",' || chr(10) || '  "source": "' || sha256('fn-1') || '"' || chr(10) || '}') AS key FROM documents""")
def cache_key(spark, sf):
    return read(spark, sf, "documents").select("doc_id", canon.component_digest(("source", canon.sha(F.lit("fn-1"))), ("item", canon.sha(F.col("text"))), ("params", canon.sha(F.col("lang")))).alias("key"))


@query("WITH l(pool, lim) AS (VALUES ('BUILDING', 60000), ('MACHINERY', 0)) SELECT c_mktsegment AS pool, sum(c_custkey % 50)::BIGINT AS units, coalesce(any_value(lim), 8)::INT AS lim, CASE WHEN any_value(lim) = 0 THEN 'disabled' WHEN sum(c_custkey % 50) > coalesce(any_value(lim), 8) THEN 'waits' ELSE 'admitted' END AS state FROM customer LEFT JOIN l ON pool = c_mktsegment GROUP BY 1")
def resource_admission(spark, sf):
    """Requested units against the limit of a pool; one without a limit has as many as there are workers (8)."""
    asked = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("pool")).agg(F.sum(F.col("c_custkey") % 50).alias("units"))
    limits = F.coalesce(F.element_at(F.create_map(F.lit("BUILDING"), F.lit(60000), F.lit("MACHINERY"), F.lit(0)), F.col("pool")), F.lit(8))
    return asked.withColumn("lim", limits).withColumn("state", F.when(F.col("lim") == 0, "disabled").when(F.col("units") > F.col("lim"), "waits").otherwise("admitted"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text))::INT AS bytes FROM documents")
def file_snapshot(spark, sf):
    return read(spark, sf, "documents").select("doc_id", canon.sha(F.col("text")).alias("digest"), F.octet_length("text").alias("bytes"))


@query(f"SELECT doc_id, sha256(o.text) AS bound, sha256(n.text) AS found FROM documents o JOIN {V2} n USING (doc_id) WHERE o.text <> n.text")
def ledger_drift(spark, sf):
    """Files whose digest isn't the one that the run is bound to."""
    d = read(spark, sf, "documents")
    both = d.select("doc_id", canon.sha(F.col("text")).alias("bound")).join(changed(d).select("doc_id", canon.sha(F.col("text")).alias("found")), "doc_id")
    return both.where("bound <> found")


@query("SELECT page_id, 'page-' || page_id || '.html' AS path, sha256(html) AS digest FROM pages")
def item_files(spark, sf):
    """The same for every page."""
    return _item_files(spark, sf, F.lit(True))


def _item_files(spark, sf, which):
    files = read(spark, sf, "pages").select(F.format_string("page-%d.html", "page_id").alias("path"), canon.sha(F.col("html")).alias("digest"))
    items = read(spark, sf, "pages").where(which).select("page_id", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    return items.join(files, "path").select("page_id", "path", "digest")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'corrupt' ELSE 'valid' END AS state FROM documents")
def cache_integrity(spark, sf):
    d = read(spark, sf, "documents").withColumn("key", F.col("doc_id").cast("string"))
    held = d.where("doc_id % 7 <> 0").select("key", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("artifact"), canon.sha(F.col("text")).alias("artifact_sha256"))
    return cache.lookup(d.select("doc_id", "key"), held).select("doc_id", "state")


@query("SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'missing' WHEN conv_id % 4 = 0 AND turn = 1 THEN 'corrupt' ELSE 'valid' END AS state FROM conversations")
def call_cache_integrity(spark, sf):
    c = read(spark, sf, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    held = c.where("turn <> 3").select("key", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 1), F.lit("?")).otherwise(F.col("text")).alias("artifact"), canon.sha(F.col("text")).alias("artifact_sha256"))
    return cache.lookup(c.select("conv_id", "turn", "key"), held).select("conv_id", "turn", "state")


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS refs FROM documents GROUP BY 1")
def blob_dedup(spark, sf):
    return read(spark, sf, "documents").groupBy(canon.sha(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("refs"))


@query("SELECT split_part(split_part(url, '://', 2), '/', 1) AS path, count(*) AS n FROM pages WHERE contains(url, '://') GROUP BY 1 HAVING count(*) > 1")
def output_conflicts(spark, sf):
    """Pages are written to a file by their host; those with one host conflict."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, sf, "pages").where(F.col("url").contains("://")).groupBy(host.alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT l_orderkey AS path, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS owners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def output_ownership(spark, sf):
    owners = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("o"))
    return owners.where(F.size("o") > 1).select("path", F.array_join("o", ",").alias("owners"))


@query("SELECT user_id, event_id, lpad(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR, 4, '0') AS version FROM events")
def history_versions(spark, sf):
    return read(spark, sf, "events").select("user_id", "event_id", F.lpad(F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("string"), 4, "0").alias("version"))


@query(f"SELECT o.doc_id, CASE WHEN n.doc_id IS NULL THEN 'only_a' ELSE 'changed' END AS change FROM documents o LEFT JOIN (SELECT * FROM {V2} WHERE doc_id % 13 <> 0) n USING (doc_id) WHERE n.doc_id IS NULL OR n.text <> o.text")
def run_diff(spark, sf):
    digest = lambda df: df.select("doc_id", canon.sha(F.col("text")).alias("d"))
    d = read(spark, sf, "documents")
    return cache.diff(digest(d), digest(changed(d).where("doc_id % 13 <> 0")), "doc_id", "d")


@query(f"SELECT o.doc_id, l.label, CASE WHEN o.doc_id % 17 = 0 THEN 'unavailable' WHEN l.label = 'item' AND o.text <> n.text THEN 'changed' ELSE 'unchanged' END AS change FROM documents o JOIN {V2} n USING (doc_id), (VALUES ('item'), ('lang')) l(label)")
def component_diff(spark, sf):
    d = read(spark, sf, "documents")
    gone = F.when(F.col("doc_id") % 17 != 0, F.col("digest"))
    both = _components(d).withColumn("a", gone).drop("digest").join(_components(changed(d)).withColumnRenamed("digest", "b"), ["doc_id", "label"], "full_outer")
    return both.select("doc_id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), "unavailable").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("change"))


RUN = "'run-' || lpad((doc_id % 12)::VARCHAR, 4, '0')"


@query("SELECT doc_id, sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 12 IN (9, 10, 11))")
def gc_cache(spark, sf):
    """Entries that the three newest runs don't use."""
    d = read(spark, sf, "documents").select("doc_id", canon.sha(F.col("text")).alias("key"), F.concat(F.lit("run-"), F.lpad((F.col("doc_id") % 12).cast("string"), 4, "0")).alias("run_id"))
    return cache.unreferenced(d.select("doc_id", "key"), d.select("run_id", "key"), d.select("run_id").distinct(), 3, "key").select("doc_id", "key")


@query("SELECT DISTINCT sha256(html) AS digest FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def gc_blobs(spark, sf):
    b = read(spark, sf, "pages").select("page_id", canon.sha(F.col("html")).alias("digest"))
    return b.select("digest").distinct().join(b.where("page_id % 3 = 0"), "digest", "left_anti")


@query("WITH r(run_id) AS (VALUES ('run-0002'), ('run-0010'), ('adhoc'), ('run-10x'), ('run-0001')) SELECT run_id, (row_number() OVER (ORDER BY regexp_matches(run_id, '^run-\\d+$'), CASE WHEN regexp_matches(run_id, '^run-\\d+$') THEN substr(run_id, 5)::INT END, run_id))::INT AS place FROM r")
def run_order(spark, sf):
    r = literal_rows(spark, "run_id", [("run-0002",), ("run-0010",), ("adhoc",), ("run-10x",), ("run-0001",)])
    number = F.regexp_extract("run_id", r"^run-(\d+)$", 1)
    return r.select("run_id", F.row_number().over(W.orderBy(number != "", F.when(number != "", number).cast("int"), "run_id")).alias("place"))


@query("SELECT 'run-' || lpad((max(doc_id) + 1)::VARCHAR, 4, '0') AS next_id FROM documents")
def next_run_id(spark, sf):
    return read(spark, sf, "documents").agg(F.max("doc_id").alias("m")).select(F.concat(F.lit("run-"), F.when(F.length((F.col("m") + 1).cast("string")) >= 4, (F.col("m") + 1).cast("string")).otherwise(F.lpad((F.col("m") + 1).cast("string"), 4, "0"))).alias("next_id"))


@query("WITH h AS (SELECT sha256(c_name) AS key FROM customer), p AS (SELECT DISTINCT substr(key, 1, 2) AS prefix FROM h UNION SELECT 'zz'), n AS (SELECT substr(key, 1, 2) AS prefix, count(*) AS n FROM h GROUP BY 1) SELECT prefix, CASE coalesce(n, 0) WHEN 0 THEN 'not found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS state FROM p LEFT JOIN n USING (prefix)")
def call_prefix_lookup(spark, sf):
    """The same for the prefixes of all customers."""
    return _call_prefix_lookup(spark, sf, F.lit(True))


def _call_prefix_lookup(spark, sf, which):
    c = read(spark, sf, "customer").select("c_custkey", canon.sha(F.col("c_name")).alias("key"))
    asked = c.where(which).select(F.substring("key", 1, 2).alias("prefix")).union(spark.range(1).select(F.lit("zz"))).distinct()
    found = asked.join(c.select(F.substring("key", 1, 2).alias("prefix"), "key"), "prefix", "left").groupBy("prefix").agg(F.count("key").alias("n"))
    return found.select("prefix", F.when(F.col("n") == 0, "not found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("state"))


@query("SELECT count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) = count(DISTINCT text) AS unique_texts FROM documents")
def unique_examples(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", canon.sha(F.col("text")).alias("d"))
    return d.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("unique_ids"), (F.count(F.lit(1)) == F.count_distinct("d")).alias("unique_texts"))


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'modified' ELSE 'unchanged' END AS change FROM (SELECT * FROM documents WHERE doc_id % 19 <> 0) o FULL JOIN (SELECT * FROM {V2} WHERE doc_id % 13 <> 0) n USING (doc_id)")
def manifest_changes(spark, sf):
    digest = lambda df: df.select("doc_id", canon.sha(F.col("text")).alias("d"))
    d = read(spark, sf, "documents")
    return cache.manifest_changes(digest(d.where("doc_id % 19 <> 0")), digest(changed(d).where("doc_id % 13 <> 0")), "doc_id", "d")


@query("SELECT min(doc_id) AS first_id, sha256(text) AS digest, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return read(spark, sf, "documents").groupBy(canon.sha(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT lang, sha256(string_agg(sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY lang")
def ordered_digest(spark, sf):
    """The digests of a language's texts in order, streamed through one digest."""
    files = read(spark, sf, "documents").select("lang", "doc_id", canon.sha(F.col("text")).alias("d"))
    return ordered.stream_digest(files, "lang", ["doc_id"], "d")


_TREE = """WITH l AS (SELECT lang, doc_id // 64 AS node, sha256(string_agg(sha256({text}), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2),
m AS (SELECT lang, node // 64 AS node, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM l GROUP BY 1, 2),
r AS (SELECT lang, node // 64 AS node, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM m GROUP BY 1, 2)
SELECT lang, 0 AS level, node, digest FROM l UNION ALL SELECT lang, 1, node, digest FROM m UNION ALL SELECT lang, 2, node, digest FROM r"""


@query(_TREE.replace("{text}", "text"))
def merkle_tree(spark, sf):
    """A tree of digests of each language's texts, by ranges of ids."""
    return ordered.merkle(read(spark, sf, "documents"), "lang", "doc_id", F.col("text"), 2)


@query(_TREE.replace("{text}", "CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END"))
def merkle_edited(spark, sf):
    """The same tree after an edit: only nodes above edited texts are computed anew."""
    docs = read(spark, sf, "documents").select("lang", "doc_id", "text")
    held = ordered.merkle(docs, "lang", "doc_id", F.col("text"), 2)
    return ordered.merkle_update(held, changed(docs), docs.where("doc_id % 10 = 0").select("lang", "doc_id"), "lang", "doc_id", F.col("text"), 2)
