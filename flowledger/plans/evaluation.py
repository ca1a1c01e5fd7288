"""Queries of model calls, durable attempts, evaluation and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import canon, paths, redact, text
from ..operators import attempts, calls, evals, evolve, ordered
from ..sources import responders
from .scalars import whole_sql
from .tables import literal_rows, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


K = "(props->>'$.k')::BIGINT"


def prop():
    return F.get_json_object("props", "$.k").cast("long")


@query(f"SELECT event_id, {K} AS k FROM events")
def locator_path(spark, sf):
    """A dotted path into an artifact; a missing segment is an error."""
    k = prop()
    return read(spark, sf, "events").select("event_id", F.when(k.isNull(), F.raise_error(F.lit("missing path k")).cast("long")).otherwise(k).alias("k"))


@query("SELECT user_id, list(event_id ORDER BY ts, event_id)[1] AS first_ref, list(event_id ORDER BY ts, event_id)[-1] AS last_ref FROM events GROUP BY user_id")
def value_refs(spark, sf):
    at = F.struct("ts", "event_id")
    return read(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_ref"), F.max_by("event_id", at).alias("last_ref"))


@query("SELECT l.doc_id, 'doc-' || l.doc_id AS path, length(text)::INT AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def file_ref_join(spark, sf):
    refs = read(spark, sf, "labels").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    files = read(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return refs.join(files, "path").select("doc_id", "path", F.length(F.decode("content", "UTF-8")).alias("chars"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'brief' WHEN 'de' THEN 'kurz' WHEN 'fr' THEN 'bref' WHEN 'es' THEN 'breve' END AS variant FROM documents")
def axis_select(spark, sf):
    """A finite selector; a language without a variant is an error."""
    named = F.element_at(F.create_map(*(F.lit(x) for x in ("en", "brief", "de", "kurz", "fr", "bref", "es", "breve"))), F.col("lang"))
    return read(spark, sf, "documents").select("doc_id", F.when(named.isNull(), F.raise_error(F.concat(F.lit("unknown variant "), "lang"))).otherwise(named).alias("variant"))


ID = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'page-' || page_id WHEN 2 THEN '..' WHEN 3 THEN 'a@' || page_id ELSE '' END"


@query(f"SELECT page_id, id <> '' AND id NOT IN ('.', '..') AND NOT regexp_matches(id, '[@/\\\\]') AS ok FROM (SELECT page_id, {ID} AS id FROM pages)")
def id_validation(spark, sf):
    i = F.col("id")
    return read(spark, sf, "pages").withColumn("id", F.expr(ID)).select("page_id", ((i != "") & ~i.isin(".", "..") & ~i.rlike(r"[@/\\]")).alias("ok"))


@query("SELECT event_id, event_type IN ('error', 'timeout') AS allowed FROM events")
def retryable(spark, sf):
    policy = attempts.RetryPolicy(retry_on=("error", "timeout"))
    e = read(spark, sf, "events").select("event_id", policy.next_status(F.lit(True), F.col("event_type"), F.lit(False), F.lit(1)).alias("next"))
    return e.select("event_id", (F.col("next") == "retry_scheduled").alias("allowed"))


@query(f"SELECT event_id, {K} AS k, {K} % 2 = 0 AS stripped FROM events")
def strip_extra(spark, sf):
    """Fields that the schema doesn't have are dropped."""
    raw = F.when(prop() % 2 == 0, F.concat(F.lit('{"extra": 1, "k": '), prop().cast("string"), F.lit("}"))).otherwise(F.col("props"))
    e = read(spark, sf, "events").withColumn("raw", raw)
    return e.select("event_id", F.from_json("raw", "k long")["k"].alias("k"), (F.size(F.json_object_keys("raw")) > 1).alias("stripped"))


CAND = "SELECT c_custkey, (round(c_acctbal) / 1000)::INT AS a, (c_custkey % 97)::INT AS b, (c_nationkey * 3 % 11)::INT AS c, length(c_mktsegment) AS len FROM customer"


def _candidates(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", (F.round("c_acctbal") / 1000).cast("int").alias("a"), (F.col("c_custkey") % 97).cast("int").alias("b"), (F.col("c_nationkey") * 3 % 11).alias("c"), F.length("c_mktsegment").alias("len"))


@query(f"WITH x AS ({CAND.replace('(round(c_acctbal) / 1000)::INT', 'trunc(round(c_acctbal) / 1000)::INT')}) SELECT c_custkey, a, b, c FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c OR y.len < x.len))")
def pareto_front(spark, sf):
    return evals.pareto(_candidates(spark, sf), "c_custkey", ["a", "b", "c"], "len")


@query("WITH w AS (SELECT item_id, substr(text, i::INT, 40) AS w FROM (SELECT item_id, text, unnest(range(1, length(text) - 38)) AS i FROM benchmark)) SELECT DISTINCT doc_id AS id, item_id AS sample_id FROM documents JOIN w ON contains(text, w)")
def leak_ngrams(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return evals.leak_windows(docs, read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 40)


TRIALS = "SELECT v.variant, l.doc_id, s.seed, ((l.quality * v.w + l.toxic * (1 - v.w) + (l.doc_id * s.seed) % 3 / 4.0) / 2)::DOUBLE AS score FROM labels l, (VALUES ('incumbent', 1), ('short', 0)) v(variant, w), (VALUES (1), (2), (3)) s(seed)"


def _trials(spark, sf):
    variants = literal_rows(spark, "variant w", [("incumbent", 1), ("short", 0)])
    g = evals.grid(variants, read(spark, sf, "labels"), [1, 2, 3])
    score = (F.col("quality") * F.col("w") + F.col("toxic") * (1 - F.col("w")) + (F.col("doc_id") * F.col("seed")) % 3 / 4.0) / 2
    return g.select("variant", "doc_id", "seed", score.cast("double").alias("score"))


@query(TRIALS)
def bench_grid(spark, sf):
    return _trials(spark, sf)


@query(f"SELECT variant, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS stdev, round(avg((score >= 0.5)::INT), 9) AS pass_rate FROM ({TRIALS}) GROUP BY variant")
def bench_summary(spark, sf):
    return evals.summary(_trials(spark, sf), 0.5).select("variant", *(F.round(c, 9).alias(c) for c in ("mean", "stdev", "pass_rate")))


@query(f"SELECT variant, doc_id, string_agg((score * 8)::INT::VARCHAR, ',' ORDER BY seed) AS scores FROM ({TRIALS}) GROUP BY ALL")
def bench_by_example(spark, sf):
    g = _trials(spark, sf).groupBy("variant", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seed", (F.col("score") * 8).cast("int").cast("string").alias("s")))).alias("a"))
    return g.select("variant", "doc_id", F.array_join("a.s", ",").alias("scores"))


@query("""SELECT v AS variant, l.doc_id, s AS seed, sha256('{' || chr(10) || '  "example": "' || l.doc_id || '",' || chr(10) || '  "seed": ' || s || ',' || chr(10) || '  "variant": "' || v || '"' || chr(10) || '}') AS trial_id FROM labels l, (VALUES ('incumbent'), ('short')) a(v), (VALUES (1), (2), (3)) b(s)""")
def bench_trial_ids(spark, sf):
    t = _trials(spark, sf)
    record = canon.canonical_struct(variant=(F.col("variant"), "string"), example=(F.col("doc_id"), "string"), seed=(F.col("seed"), "int"))
    return t.select("variant", "doc_id", "seed", canon.sha(record).alias("trial_id"))


STAGE = "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'metric' WHEN event_type = 'error' THEN 'subject' END"


@query(f"SELECT user_id, count(*) AS trials, count(*) FILTER (s IS DISTINCT FROM 'subject') AS subject_successes, count(*) FILTER (s IS NULL) AS metric_successes, round(count(*) FILTER (s = 'subject') / count(*), 9) AS subject_failure_rate, round(count(*) FILTER (s = 'metric') / count(*), 9) AS metric_failure_rate, round(count(s) / count(*), 9) AS any_failure_rate FROM (SELECT user_id, {STAGE} AS s FROM events) GROUP BY user_id")
def bench_outcomes(spark, sf):
    """A failed metric still counts as a success of its subject."""
    e = read(spark, sf, "events").withColumn("s", F.expr(STAGE))
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.count_if(c) / n, 9)
    return e.groupBy("user_id").agg(n.alias("trials"), F.count_if(~F.col("s").eqNullSafe(F.lit("subject"))).alias("subject_successes"), F.count_if(F.col("s").isNull()).alias("metric_successes"), rate(F.col("s") == "subject").alias("subject_failure_rate"), rate(F.col("s") == "metric").alias("metric_failure_rate"), rate(F.col("s").isNotNull()).alias("any_failure_rate"))


@query("SELECT lang, round(coalesce(avg(quality), 0), 9) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def evolve_mean(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang").join(read(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 9).alias("mean"))


@query(f"SELECT arg_min(c_custkey, (-a, len, c_custkey)) AS winner FROM ({CAND.replace('(round(c_acctbal) / 1000)::INT', 'trunc(round(c_acctbal) / 1000)::INT')})")
def evolve_winner(spark, sf):
    return _candidates(spark, sf).agg(F.min_by("c_custkey", F.struct(-F.col("a"), "len", "c_custkey")).alias("winner"))


@query("WITH f AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'untagged' END AS tag, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels WHERE quality <> 1) SELECT tag, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 2) AS samples, greatest(max(n) - 2, 0) AS more FROM f GROUP BY tag")
def merge_feedback(spark, sf):
    """Failing examples by tag: the first two, and how many more."""
    f = read(spark, sf, "labels").where("quality <> 1").select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array(F.lit("untagged")))).alias("tag"))
    # the first two of each of 64 parts, and then of those: no task ranks a whole tag
    part = F.row_number().over(W.partitionBy("tag", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy("doc_id"))
    top = f.withColumn("__n", part).where("__n <= 2").drop("__n").withColumn("rn", F.row_number().over(W.partitionBy("tag").orderBy("doc_id"))).where("rn <= 2")
    g = f.select("tag", "doc_id", F.lit(None).cast("int").alias("rn")).unionByName(top.withColumn("doc_id", F.col("doc_id"))).groupBy("tag").agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= 2, F.struct("rn", "doc_id")))).alias("s"), F.greatest(F.count_if(F.col("rn").isNull()) - 2, F.lit(0).cast("long")).alias("more"))
    return g.select("tag", F.array_join(F.transform("s.doc_id", lambda x: x.cast("string")), ",").alias("samples"), "more")


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) // 4 END)::BIGINT AS total_tokens, count(*) AS calls FROM conversations GROUP BY conv_id")
def usage_rollup(spark, sf):
    used = F.when(F.col("role") == "assistant", F.floor(F.length("text") / 4).cast("long"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(used).alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


@query("SELECT user_id, count(*) FILTER (event_id % 3 <> 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses FROM events GROUP BY user_id")
def item_cache_counts(spark, sf):
    hit = F.col("event_id") % 3 != 0
    return read(spark, sf, "events").groupBy("user_id").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'mixed' END AS cache, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS outputs, round(sum(value), 6) AS seconds FROM events GROUP BY user_id")
def trace_rollup(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("o"), F.round(F.sum("value"), 6).alias("seconds"))
    return e.select("user_id", F.when(F.size("o") == 1, F.get("o", F.lit(0))).otherwise("mixed").alias("cache"), F.array_join("o", ",").alias("outputs"), "seconds")


@query(f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS stop_reason, sum({K})::BIGINT AS usage FROM events GROUP BY user_id")
def trajectory_summary(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stop_reason"), F.sum(prop()).alias("usage"))


@query("SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS bytes, ((sum(octet_length(encode(text))) + 3) // 4)::BIGINT AS tokens, sum(octet_length(encode(text))) > 4000 AS too_large, count(*) > 6 AS too_many FROM conversations GROUP BY conv_id")
def preflight_report(spark, sf):
    b = F.sum(F.octet_length("text"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(b.alias("bytes"), F.floor((b + 3) / 4).cast("long").alias("tokens"), (b > 4000).alias("too_large"), (F.count(F.lit(1)) > 6).alias("too_many"))


@query("SELECT user_id, event_id, row_number() OVER w AS sequence, lag(sha256(props || event_id)) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def receipt_chain(spark, sf):
    """Receipts numbered from 1, each with the digest of the state before it."""
    states = read(spark, sf, "events").select("user_id", "event_id", "ts", F.concat("props", F.col("event_id").cast("string")).alias("state"))
    return attempts.receipts(states, "user_id", ["ts", "event_id"], "state").select("user_id", "event_id", F.col("sequence").cast("long").alias("sequence"), "previous")


@query("WITH m AS (SELECT variant, doc_id, avg(score) AS s FROM (" + TRIALS + ") GROUP BY ALL), b AS (SELECT doc_id, max(s) AS best FROM m GROUP BY 1) SELECT variant, count(*) FILTER (s = best) AS weight FROM m JOIN b USING (doc_id) GROUP BY variant")
def parent_weights(spark, sf):
    m = _trials(spark, sf).groupBy("variant", "doc_id").agg(F.avg("score").alias("s"))
    top = m.withColumn("best", F.max("s").over(W.partitionBy("doc_id")))
    return top.groupBy("variant").agg(F.count_if(F.col("s") == F.col("best")).alias("weight"))


@query("SELECT r::INT AS round, o::INT AS place, (r * 4 + o) % (SELECT count(*) FROM benchmark) AS example FROM range(5) a(r), range(4) b(o)")
def minibatch(spark, sf):
    n = read(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    picks = spark.range(5).select(F.col("id").cast("int").alias("round"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    return picks.crossJoin(F.broadcast(n)).select("round", "place", ((F.col("round") * 4 + F.col("place")) % F.col("n")).alias("example"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM conversations")
def batch_assign(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.floor((F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1) / 3).alias("batch"))


@query("SELECT conv_id, turn, 'echo:' || length(text) AS response, conv_id % 2 = 0 AS cached FROM conversations")
def call_batch(spark, sf):
    c = read(spark, sf, "conversations").withColumn("key", calls.request_key(F.col("role"), F.col("text"), F.col("conv_id").cast("string")))
    answer = F.concat(F.lit("echo:"), F.length("text").cast("string"))
    held = c.where("conv_id % 2 = 0").select("key", answer.alias("response")).dropDuplicates(["key"])
    return calls.call_batch(c, held, lambda df: df.select("key", answer.alias("response"))).select("conv_id", "turn", "response", "cached")


@query("SELECT conv_id, count(*) FILTER (turn % 2 = 1) AS misses FROM conversations GROUP BY conv_id")
def dry_misses(spark, sf):
    c = read(spark, sf, "conversations").withColumn("key", calls.request_key(F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    held = c.where("turn % 2 = 0").select("key", F.lit("x").alias("response"))
    return calls.call_batch(c, held, lambda df: df, dry=True).groupBy("conv_id").agg(F.count_if(~F.col("cached")).alias("misses"))


def _repair_rounds(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    reply = lambda df, r: df.withColumn("response", F.when(F.col("doc_id") % 4 <= r, F.concat(F.lit('{"lang": "'), "lang", F.lit('"}'))).otherwise("oops"))
    return calls.repair(docs, reply, F.col("response").startswith("{"), 2)


@query("SELECT doc_id, least(doc_id % 4, 2)::INT AS rounds, doc_id % 4 <= 2 AS ok FROM documents")
def repair_rounds(spark, sf):
    return _repair_rounds(spark, sf).select("doc_id", "rounds", "ok")


@query("SELECT doc_id, lang AS value FROM documents WHERE doc_id % 4 <= 2")
def call_validated(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "response", F.lit("\n```"))
    return _repair_rounds(spark, sf).where("ok").select("doc_id", F.from_json(text.strip_json_fence(fenced), "lang string")["lang"].alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'empty' WHEN event_id % 5 = 1 THEN 'truncated' ELSE 'kept' END AS gate FROM events")
def response_gate(spark, sf):
    """Empty and cut-off responses are failures and never cached."""
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "").otherwise("text").alias("text"), F.when(F.col("event_id") % 5 == 1, "length").otherwise("stop").alias("finish"))
    return e.select("event_id", calls.gate(F.col("text"), F.col("finish")).alias("gate"))


@query("SELECT doc_id, doc_id % 6 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents")
def resolution_valid(spark, sf):
    """Schema, digest form and digest of persisted resolution records."""
    d = read(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 6 == 0, 2).otherwise(1).alias("schema"), F.when(F.col("doc_id") % 7 == 0, F.upper(canon.sha(F.col("text")))).otherwise(canon.sha(F.col("text"))).alias("digest"))
    return d.select("doc_id", ((F.col("schema") == 1) & F.col("digest").rlike("^[0-9a-f]{64}$") & (F.col("digest") == canon.sha(F.col("text")))).alias("ok"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'not collected' WHEN page_id % 6 = 1 THEN 'not an output' ELSE 'ok' END AS state FROM pages WHERE page_id % 3 <> 2")
def publish_contract(spark, sf):
    """What is published must be a declared output, and outputs must be among the collected files."""
    p = read(spark, sf, "pages").select("page_id")
    published, outputs, collected = p.where("page_id % 3 <> 2"), p.where("page_id % 6 <> 1").withColumn("o", F.lit(True)), p.where("page_id % 4 <> 0").withColumn("c", F.lit(True))
    both = published.join(outputs, "page_id", "left").join(collected, "page_id", "left")
    return both.select("page_id", F.when(F.col("c").isNull(), "not collected").when(F.col("o").isNull(), "not an output").otherwise("ok").alias("state"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 4096 THEN 'inline' ELSE 'blob' END AS kind FROM documents WHERE lang IN ('en', 'es')")
def attachment_select(spark, sf):
    """Attachments by a name pattern; small ones go inline."""
    d = read(spark, sf, "documents").withColumn("name", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.where(F.col("name").rlike(r"^e[^/]*/[^/]*\.txt$")).select("doc_id", F.when(F.octet_length("text") <= 4096, "inline").otherwise("blob").alias("kind"))


@query("WITH d AS (SELECT lang, doc_id, octet_length(encode(text)) AS b FROM documents) SELECT lang, doc_id, sum(b) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS total, sum(b) OVER (PARTITION BY lang ORDER BY doc_id) <= 100000 AND b <= 20000 AND row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 64 AS within FROM d")
def collect_limits(spark, sf):
    d = read(spark, sf, "documents").select("lang", "doc_id", F.octet_length("text").cast("long").alias("b"))
    d = ordered.prefix_sums(d, "lang", ["doc_id"], {"total": F.col("b"), "n": F.lit(1).cast("long")})
    return d.select("lang", "doc_id", "total", ((F.col("total") <= 100000) & (F.col("b") <= 20000) & (F.col("n") <= 64)).alias("within"))


@query("SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN 'lines' WHEN role = 'assistant' THEN 'assistant' ELSE 'other' END AS route FROM conversations")
def scripted_route(spark, sf):
    """The first route whose marker fits answers."""
    c = read(spark, sf, "conversations")
    asked = c.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.concat(F.when(F.col("text").contains("\n"), "has lines\n").otherwise(""), F.concat(F.lit("role "), "role"), F.lit("\nany\n"), "text").alias("text"))
    made = responders.scripted(asked, [("has lines", "lines"), ("role assistant", "assistant"), ("any", "other")])
    at = F.split("key", ":")
    return made.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), F.col("response").alias("route"))


@query("SELECT conv_id, turn, CASE WHEN turn = 2 THEN 'mismatch' ELSE 'replayed' END AS state FROM conversations")
def cassette_replay(spark, sf):
    """Recorded calls answer in order; a request that differs from the recorded one is a mismatch."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    tape = c.select("seq", F.when(F.col("turn") == 2, "?").otherwise(canon.sha(F.col("text"))).alias("request_sha"), F.lit("replayed").alias("response"))
    same = responders.matches(c, tape)
    return same.select("seq.conv_id", "seq.turn", F.when(F.col("same"), F.col("response")).otherwise("mismatch").alias("state"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'pending' WHEN turn % 3 = 1 THEN 'approved' ELSE 'changed' END AS state FROM conversations")
def checkpoint_match(spark, sf):
    """An approval is bound to the payload's digest; a changed payload is pending again."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", canon.sha(F.col("text")).alias("payload"))
    ok = c.where("turn % 3 <> 0").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.lit("old")).otherwise(F.col("payload")).alias("approved"))
    both = c.join(ok, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.when(F.col("approved").isNull(), "pending").when(F.col("approved") == F.col("payload"), "approved").otherwise("changed").alias("state"))


ATT = f"SELECT event_id, user_id, (event_id % 3 + 1)::INT AS attempt, event_type = 'error' AS failed, event_id % 10 = 0 AS effect, {K} AS due FROM events"


def _attempts(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 10 == 0).alias("effect"), prop().alias("due"))


@query(f"SELECT event_id, CASE WHEN NOT failed THEN 'success_candidate' WHEN effect THEN 'ambiguous' WHEN attempt < 3 THEN 'retry_scheduled' ELSE 'failed' END AS status FROM ({ATT})")
def attempt_transition(spark, sf):
    """A running attempt's next status; a failure after a side effect began is ambiguous."""
    s = attempts.RetryPolicy(max_attempts=3).next_status(F.col("failed"), F.lit("timeout"), F.col("effect"), F.col("attempt"))
    return _attempts(spark, sf).select("event_id", s.alias("status"))


@query(f"SELECT event_id, CASE WHEN NOT failed THEN 'completed' WHEN effect THEN 'raise' WHEN attempt = 3 THEN 'failed' WHEN due <= 50 THEN 'run' ELSE 'pending' END AS action FROM ({ATT})")
def attempt_action(spark, sf):
    """What to do with a target when a run is taken up at time 50."""
    a = F.when(~F.col("failed"), "completed").when(F.col("effect"), "raise").when(F.col("attempt") == 3, "failed").when(F.col("due") <= 50, "run").otherwise("pending")
    return _attempts(spark, sf).select("event_id", a.alias("action"))


@query(f"SELECT event_id, attempt + 1 AS next_attempt, least(15.0, 10.0 * 2.0 ** (attempt - 1))::DOUBLE AS cap FROM ({ATT}) WHERE failed AND NOT effect AND attempt < 3")
def retry_decision(spark, sf):
    return _attempts(spark, sf).where("failed AND NOT effect AND attempt < 3").select("event_id", (F.col("attempt") + 1).alias("next_attempt"), F.least(F.lit(15.0), 10.0 * F.pow(F.lit(2.0), F.col("attempt") - 1)).alias("cap"))


@query(f"SELECT event_id, user_id FROM ({ATT}) WHERE failed AND effect")
def ambiguous_attempts(spark, sf):
    return _attempts(spark, sf).where("failed AND effect").select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf):
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT n_name, NOT (n_regionkey = 1 OR n_nationkey % 7 = 3) AS inherited FROM nation")
def recovery_inherited(spark, sf):
    """Results outside the recovered step and what lies below it are inherited."""
    n = read(spark, sf, "nation")
    # each region feeds its nations; region 1 is recovered, and nations by themselves
    r = read(spark, sf, "region")
    nodes = r.select(F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    edges = n.select(F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("src"), F.col("n_name").alias("dst"))
    recovered = n.where("n_nationkey % 7 = 3").select(F.col("n_name").alias("name")).unionByName(nodes.where("name = 'region 1'"))
    kept = attempts.inherited(nodes, edges, recovered).select(F.col("name").alias("n_name"), F.lit(True).alias("k"))
    return n.join(kept, "n_name", "left").select("n_name", F.coalesce("k", F.lit(False)).alias("inherited"))


@query(f"WITH s AS (SELECT user_id, bool_or(failed AND effect) AS amb, bool_or(failed AND NOT effect AND attempt < 3) AS sched, bool_or(failed) AS f FROM ({ATT}) GROUP BY user_id) SELECT user_id, t.to_status, CASE to_status WHEN 'completed' THEN NOT f WHEN 'pending_retry' THEN sched ELSE amb END AS allowed FROM s, (VALUES ('completed'), ('pending_retry'), ('ambiguous')) t(to_status)")
def manifest_status_valid(spark, sf):
    s = _attempts(spark, sf).groupBy("user_id").agg(F.bool_or(F.expr("failed AND effect")).alias("amb"), F.bool_or(F.expr("failed AND NOT effect AND attempt < 3")).alias("sched"), F.bool_or("failed").alias("f"))
    t = F.array(*(F.struct(F.lit(n).alias("to_status"), c.alias("allowed")) for n, c in (("completed", ~F.col("f")), ("pending_retry", F.col("sched")), ("ambiguous", F.col("amb")))))
    return s.select("user_id", F.inline(t))


@query("SELECT conv_id, turn, turn % 2 = 0 AND conv_id % 3 <> 0 AS hit FROM conversations")
def evidence_lookup(spark, sf):
    """A cached entry is a hit only under the same evidence policy."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "hash").otherwise("full").alias("policy"))
    held = c.where("turn % 2 = 0").select("conv_id", "turn", F.lit("full").alias("policy"), F.lit(True).alias("h"))
    return c.join(held, ["conv_id", "turn", "policy"], "left").select("conv_id", "turn", F.coalesce("h", F.lit(False)).alias("hit"))


@query("SELECT count(*) FILTER (doc_id % 14 = 0) AS missing_sidecars, count(*) FILTER (doc_id % 14 <> 0 AND doc_id % 15 = 0) AS wrong_digests FROM documents")
def run_integrity(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", canon.sha(F.col("text")).alias("digest"))
    side = d.where("doc_id % 14 <> 0").select("doc_id", F.when(F.col("doc_id") % 15 == 0, "bad").otherwise(F.col("digest")).alias("said"))
    return d.join(side, "doc_id", "left").agg(F.count_if(F.col("said").isNull()).alias("missing_sidecars"), F.count_if(F.col("said") != F.col("digest")).alias("wrong_digests"))


@query("SELECT doc_id, CASE WHEN length(text) < 100 THEN 0.0 ELSE quality END::DOUBLE AS score, CASE WHEN length(text) < 100 THEN 'task_error' END AS tag FROM documents JOIN labels USING (doc_id)")
def evaluate_errors(spark, sf):
    """A task that fails scores 0 under a tag."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")

    def task(example):
        if len(example["text"]) < 100:
            raise ValueError("too short")
        return example["quality"]

    judged = evals.evaluate(d.select("doc_id", "text", "quality"), task, lambda example, output: (output, "", ()), "doc_id")
    return judged.select("doc_id", "score", F.get("tags", F.lit(0)).alias("tag"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END::DOUBLE AS score, CASE WHEN toxic = 1 THEN 'gate' WHEN quality = 0 THEN 'gate,low' ELSE 'gate' END AS tags FROM labels")
def gated_metric(spark, sf):
    low = F.when(F.col("quality") == 0, F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    j = evals.gated((1 - F.col("toxic")).cast("double"), F.col("quality").cast("double"), F.array(F.lit("gate")), low)
    return read(spark, sf, "labels").select("doc_id", j.alias("j")).select("doc_id", "j.score", F.array_join("j.tags", ",").alias("tags"))


@query(whole_sql("SELECT doc_id, '## Answer' || chr(10) || chr(10) || '```' || chr(10) || substr(text, 1, 50) || chr(10) || '```' || chr(10) || 'Score 0 to 1.' AS prompt FROM documents"))
def judge_prompts(spark, sf):
    return _judge_prompts(spark, sf, F.col("text"))


def _judge_prompts(spark, sf, t):
    return read(spark, sf, "documents").select("doc_id", F.concat(text.inject(t, title="Answer"), F.lit("Score 0 to 1.")).alias("prompt"))


@query(f"SELECT variant, count(*) FILTER (score < 0 OR score > 1) AS outside FROM ({TRIALS}) GROUP BY variant")
def judgment_range(spark, sf):
    return _trials(spark, sf).groupBy("variant").agg(F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("outside"))


ROLE = "'" + "'), ('".join(["region>nation", "nation>customer", "nation>supplier", "customer>orders", "orders>lineitem", "part>lineitem", "supplier>lineitem"]) + "'"


@query(f"SELECT split_part(x, '>', 1) AS src, split_part(x, '>', 2) AS dst, CASE WHEN x = 'orders>lineitem' THEN 'items' ELSE 'dep' END AS role FROM (VALUES ({ROLE})) v(x)")
def profile_edges(spark, sf):
    from ..operators.graph import Pipeline

    p = Pipeline()
    none = lambda _: None
    for name, deps in (("region", []), ("nation", ["region"]), ("customer", ["nation"]), ("supplier", ["nation"]), ("part", []), ("orders", ["customer"])):
        p.node(name, deps)(none)
    p.map("lineitem", items_from="orders", deps=["part", "supplier"])(none)
    return p.edges(spark)


@query(f"SELECT '  n_' || substr(sha256(split_part(x, '>', 1)), 1, 12) || ' --> n_' || substr(sha256(split_part(x, '>', 2)), 1, 12) AS line FROM (VALUES ({ROLE})) v(x)")
def mermaid_lines(spark, sf):
    return profile_edges(spark, sf).select(F.concat(F.lit("  "), text.mermaid_id(F.col("src")), F.lit(" --> "), text.mermaid_id(F.col("dst"))).alias("line"))


@query(f"SELECT user_id, max(attempt) AS last_attempt, count(*) FILTER (failed) AS failures, count(*) FILTER (failed AND effect) AS ambiguous FROM ({ATT}) GROUP BY user_id")
def durable_state(spark, sf):
    return _attempts(spark, sf).groupBy("user_id").agg(F.max("attempt").alias("last_attempt"), F.count_if("failed").alias("failures"), F.count_if(F.expr("failed AND effect")).alias("ambiguous"))


@query("SELECT role AS node, count(*) AS calls, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS runs FROM conversations GROUP BY role")
def run_profile(spark, sf):
    return read(spark, sf, "conversations").groupBy(F.col("role").alias("node")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("chars"), F.count_distinct("conv_id").alias("runs"))


@query(f"WITH m AS (SELECT variant, avg(score) AS s FROM ({TRIALS}) GROUP BY 1), p AS (SELECT s AS parent FROM m WHERE variant = 'incumbent') SELECT variant, s >= parent AS mean_ok, NOT EXISTS (SELECT 1 FROM (SELECT doc_id, avg(score) FILTER (variant = 'incumbent') AS a, avg(score) FILTER (variant = m.variant) AS b FROM ({TRIALS}) GROUP BY 1) WHERE b < a) AS no_regression FROM m, p")
def evolve_round(spark, sf):
    """The gates of a candidate: no example gets worse, and the mean is not below the parent's."""
    place = F.when(F.col("variant") == "incumbent", 0).otherwise(1)
    t = _trials(spark, sf).groupBy(place.alias("place"), F.col("doc_id").alias("example_id")).agg(F.avg("score").alias("score"))
    children = literal_rows(spark, "place parent variant", [(0, 0, "incumbent"), (1, 0, "short")])
    return evolve.gates(children.select("place", "parent"), t, t).join(children, "place").select("variant", "mean_ok", "no_regression")


NESTED = """(SELECT event_id, k, event_type, '{"payload": {"list": [' || k || ', ' || (k + 1) || ', {"at": ' || event_id || '}], "kind": ' || to_json(event_type) || ', "text": ' || to_json(event_type || k) || '}, "seen": [true, null]}' AS said FROM (SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k FROM events))"""


def _nested_props(spark, sf):
    """Events whose props have been put into a larger object, as text."""
    k = prop()
    said = F.concat(F.lit('{"payload": {"list": ['), k.cast("string"), F.lit(", "), (k + 1).cast("string"), F.lit(', {"at": '), F.col("event_id").cast("string"), F.lit('}], "kind": '), canon.json_string(F.col("event_type")), F.lit(', "text": '), canon.json_string(F.concat("event_type", k.cast("string"))), F.lit('}, "seen": [true, null]}'))
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", said.alias("said"))


@query(f"SELECT event_id, k AS first, k + 1 AS second, event_id AS last_at, event_type AS kind, NULL::BIGINT AS absent, (props->>'$.k')::BIGINT AS k FROM {NESTED} JOIN events USING (event_id, event_type)")
def path_values(spark, sf):
    """Values at paths into whole props: list places from either end, strict and lenient."""
    e = _nested_props(spark, sf).withColumn("v", F.parse_json("said")).join(read(spark, sf, "events").select("event_id", "props"), "event_id")
    at = lambda path, kind, **o: paths.column_at(e, path, kind, **o)
    return e.select("event_id", at("v.payload.list[0]", "long").alias("first"), at("said.payload.list[1]", "long").alias("second"), at("v.payload.list[-1].at", "long").alias("last_at"), at("v.payload.kind", "string").alias("kind"), at("v.payload.none[3]", "long", strict=False).alias("absent"), at("props.k", "long").alias("k"))


@query(f"SELECT event_id, p.pos::INT AS pos, CASE p.pos WHEN 0 THEN k::VARCHAR WHEN 1 THEN (k + 1)::VARCHAR ELSE '{{\"at\":' || event_id || '}}' END AS item FROM {NESTED}, (VALUES (0), (1), (2)) p(pos)")
def path_items(spark, sf):
    """The items of a list at a path, a row for each."""
    return paths.items_at(_nested_props(spark, sf), "said.payload.list", keep=["event_id"]).select("event_id", "pos", F.to_json("item").alias("item"))


_KEPT = """'{' || chr(10) || '  "payload": {' || chr(10) || '    "kind": ' || to_json(event_type) || ',' || chr(10) || '    "list": [' || chr(10) || '      ' || k || ',' || chr(10) || '      ' || (k + 1) || ',' || chr(10) || '      {' || chr(10) || '        "at": ' || event_id || chr(10) || '      }' || chr(10) || '    ],' || chr(10)
|| '    "text": {' || chr(10) || '      "bytes": ' || strlen(to_json(event_type || k)) || ',' || chr(10) || '      "redacted": true,' || chr(10) || '      "sha256": "' || sha256(to_json(event_type || k)::VARCHAR) || '"' || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "seen": [' || chr(10) || '    true,' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}'"""


@query(f"SELECT event_id, {_KEPT} AS kept FROM {NESTED}")
def redacted_props(spark, sf):
    """Contents at any depth become digests; the rest stays, in canonical form."""
    return redact.redact_json(_nested_props(spark, sf), "said", "kept").select("event_id", "kept")


@query("""WITH l AS (SELECT page_id, unnest(string_split(h, chr(10))) AS line, generate_subscripts(string_split(h, chr(10)), 1) AS i FROM (SELECT page_id, regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', '') AS h FROM pages) WHERE h <> '')
SELECT page_id, string_agg('{' || chr(10) || '  "bytes": ' || strlen(line) || ',' || chr(10) || '  "redacted": true,' || chr(10) || '  "sha256": "' || sha256(line) || '"' || chr(10) || '}', chr(10) ORDER BY i) || chr(10) AS kept FROM l GROUP BY page_id""")
def redacted_page_lines(spark, sf):
    """Whole pages as lines of which none is JSON: each becomes its digest and size."""
    done = redact.redact_json(read(spark, sf, "pages").select("page_id", "html"), "html", "kept", lines=True)
    return done.where("kept <> ''").select("page_id", "kept")
