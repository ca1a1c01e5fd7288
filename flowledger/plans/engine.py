"""Queries of cached runs, repair, benches, agents and keys, each through the library's operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canon, text
from ..functions.schema import schema_section as section_of
from ..operators import agents, calls, dynamic, evals, run
from ..operators.graph import Pipeline
from ..sources.ledger import Ledger
from ..sources.store import Store
from .tables import V2, changed, literal_rows, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def _store(spark) -> Store:
    """A new store in the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="flowledger-") if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master else None)
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return Store(spark, f"{shared}/store-{uuid.uuid4().hex}")


def _measure(inputs):
    return inputs["docs"].select("doc_id", F.length("text").alias("chars"), canon.sha(F.col("text")).alias("digest"))


def _totals(inputs):
    return inputs["measure"].groupBy().agg(F.count(F.lit(1)).alias("items"), F.sum("chars").alias("chars"))


def _documents(docs) -> Pipeline:
    p = Pipeline()
    p.node("docs", cache="off")(lambda _: docs)
    p.map("measure", items_from="docs", item="doc_id", consumes={"docs": ["doc_id", "text"]})(_measure)
    p.node("totals", ["measure"])(_totals)
    return p


def _edited(spark, sf):
    """A run over the first version of the documents, then one over the second, in which item 7 is forced."""
    store = _store(spark)
    run.execute(_documents(read(spark, sf, "documents").select("doc_id", "text")), store)
    return run.execute(_documents(changed(read(spark, sf, "documents")).select("doc_id", "text")), store, force=["measure@7"])


@query(f"SELECT doc_id, length(text)::INT AS chars, sha256(text) AS digest, (SELECT count(*) FROM documents) AS items, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0 AND doc_id <> 7) AS hits FROM {V2}")
def run_edited_items(spark, sf):
    """Items of a map after an edit: results, and how many came from the store."""
    done = _edited(spark, sf)
    items, hits = done.map_items["measure"]
    return done.artifacts["measure"].withColumns({"items": F.lit(items).cast("long"), "hits": F.lit(hits).cast("long")})


@query("SELECT * FROM (VALUES ('docs', 'miss'), ('measure', 'unknown'), ('totals', 'unknown')) v(name, state)")
def plan_of_uncached(spark, sf):
    """Nothing that follows a step without a stored result is known, and nothing is computed."""
    store, p = _store(spark), _documents(read(spark, sf, "documents").select("doc_id", "text"))
    states = run.plan(p, store)
    return literal_rows(spark, "name state", list(states.items()))


@query("SELECT node, cache, cache_policy, outputs FROM (VALUES ('docs', 'miss', 'off', 'doc_id,text'), ('measure', 'hit', 'auto', 'chars,digest,doc_id'), ('totals', 'hit', 'auto', 'chars,items')) v(node, cache, cache_policy, outputs)")
def run_sidecars(spark, sf):
    """The sidecar rows of a run that finds everything in the store but a source that is never stored."""
    store = _store(spark)
    docs = read(spark, sf, "documents").select("doc_id", "text")
    run.execute(_documents(docs), store)
    again = run.execute(_documents(docs), store)
    return store.read("sidecars", run.SIDECARS, [again.run_id]).select("node", "cache", "cache_policy", F.array_join("outputs", ",").alias("outputs"))


@query("SELECT lang, count(*) AS items, count(*) FILTER (doc_id % 10 <> 0) AS hits, count(*) = count(*) FILTER (doc_id % 10 <> 0) AS all_hit FROM documents GROUP BY lang")
def map_all_hit(spark, sf):
    return dynamic.all_hit(read(spark, sf, "documents").withColumn("hit", F.col("doc_id") % 10 != 0), by="lang")


@query("""WITH t AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS carry FROM conversations),
k AS (SELECT conv_id, turn, sha256(text) || chr(31) || sha256(coalesce(lag(carry) OVER (PARTITION BY conv_id ORDER BY turn), 0)::VARCHAR) AS parts FROM t) SELECT conv_id, turn, sha256(parts) AS key FROM k""")
def scan_carry_keys(spark, sf):
    """The key of each step of a scan: its item, and what is carried into it."""
    c = read(spark, sf, "conversations").withColumn("n", F.length("text"))
    summed = dynamic.running_total(c, "conv_id", ["turn"], F.col("n"), "carry")
    return dynamic.carry_keys(summed, "conv_id", ["turn"], F.col("text"), F.col("carry").cast("string"), "0").select("conv_id", "turn", "key")


@query("""SELECT 'extract@' || doc_id AS node, doc_id % 4 AS seq, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE sha256(text || doc_id) END AS call_key, CASE WHEN doc_id % 4 = 3 THEN lang END AS response,
CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'call without key' WHEN 2 THEN 'payload missing for ' || sha256(text || doc_id) END AS warning FROM documents WHERE doc_id % 4 <> 0
UNION ALL SELECT 'extract@' || doc_id, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 4 = 0""")
def trace_calls(spark, sf):
    """Calls of the items of one step, with their payloads; those without a key or payload carry a warning."""
    d = read(spark, sf, "documents")
    name, key = F.concat(F.lit("extract@"), F.col("doc_id").cast("string")), canon.sha(F.concat("text", F.col("doc_id").cast("string")))
    nodes = d.select(name.alias("node")).unionByName(d.select(F.concat(F.lit("extractor@"), F.col("doc_id").cast("string")).alias("node")))
    made = d.where("doc_id % 4 <> 0").select(name.alias("node"), (F.col("doc_id") % 4).alias("seq"), F.when(F.col("doc_id") % 4 != 1, key).alias("call_key"))
    traced = run.trace(nodes, made, d.where("doc_id % 4 = 3").select(key.alias("key"), F.col("lang").alias("response")), node="extract")
    return traced.select("node", "seq", "call_key", "response", "warning")


def _asked(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "lang", F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Language of "), F.col("doc_id").cast("string")).alias("content"))).alias("messages"))


def _reply(df, r):
    """Valid from round `id % 4` on; what comes before says the same wrong thing in the first two rounds."""
    wrong = F.lit("no json" if r < 2 else "[]")
    return df.select("key", F.when(F.col("key") % 4 <= r, F.concat(F.lit('{"n": '), F.size("messages").cast("string"), F.lit("}"))).otherwise(wrong).alias("response"))


def _validate(raw):
    return F.struct(F.get_json_object(raw, "$.n").cast("int").alias("value"), F.when(~raw.startswith("{"), F.concat(F.lit("not an object: "), raw)).alias("error"))


@query("""SELECT doc_id, doc_id % 4 <= 2 AS ok, least(doc_id % 4, 2)::INT AS rounds, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 2 END::INT AS n_messages,
least(doc_id % 4, 3)::INT AS n_errors, CASE WHEN doc_id % 4 >= 2 THEN 1 ELSE 0 END::INT AS n_stuck FROM documents""")
def repair_protocol(spark, sf):
    """Invalid responses are corrected with the error and the response; equal ones in a row are stuck, and three are the end."""
    done = calls.repair_loop(_asked(spark, sf), "doc_id", "messages", _reply, _validate, exhausted="keep")
    return done.select("doc_id", "ok", "rounds", F.col("value").alias("n_messages"), F.size("attempts").alias("n_errors"), F.size(F.filter("attempts", lambda a: a["stuck"])).alias("n_stuck"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE 1 + 2 * (doc_id % 4) END::INT AS n_messages FROM documents")
def repair_continued(spark, sf):
    """Continuing keeps the whole exchange: two more messages for each correction."""
    done = calls.repair_loop(_asked(spark, sf), "doc_id", "messages", _reply, _validate, mode="continue", exhausted="keep")
    return done.select("doc_id", F.col("value").alias("n_messages"))


@query("""SELECT doc_id, '上次输出未通过校验。下面是错误：' || repeat(chr(10), 2) || 'bad ' || lang || repeat(chr(10), 2) || '这是第 2 轮修复。' || CASE WHEN doc_id % 2 = 0 THEN repeat(chr(10), 2) || '检测到输出与上次完全相同；请逐项修正错误，不得原样重交。' ELSE '' END
|| repeat(chr(10), 2) || 'Only JSON.' || repeat(chr(10), 2) || '你上一轮的输出如下：' || chr(10) || text AS said FROM documents""")
def correction_text(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", calls.correction(F.concat(F.lit("bad "), "lang"), F.col("text"), 2, F.col("doc_id") % 2 == 0, reminder="Only JSON.").alias("said"))


def _words(example):
    if example["lang"] == "de" and example["seed"] == 1:
        raise RuntimeError("no German today")
    return len(example["text"].split(" "))


def _long_enough(limit):
    return lambda example, output: (1.0 if output >= limit else 0.5, "", ())


def _benched(spark, sf):
    examples = read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"))
    variants = [
        evals.Variant("short", {"limit": 50}, evals.function_subject(_words, _long_enough(50)), incumbent=True),
        evals.Variant("long", {"limit": 200}, evals.function_subject(_words, _long_enough(200)), hypothesis="longer texts are better"),
    ]
    return evals.bench(variants, examples, seeds=[0, 1], key="doc_id", threshold=0.9)


@query("""WITH x AS (SELECT text, min(lang) AS lang FROM documents GROUP BY text), t AS (SELECT place, variant, CASE WHEN lang = 'de' AND seed = 1 THEN 0.0 WHEN len(string_split(text, ' ')) >= lim THEN 1.0 ELSE 0.5 END AS score, lang = 'de' AND seed = 1 AS bad
FROM x, (VALUES (0, 'short', 50), (1, 'long', 200)) v(place, variant, lim), (VALUES (0), (1)) s(seed))
SELECT place, variant, count(*) AS trials, avg(score) AS mean, stddev_pop(score) AS stdev, min(score)::DOUBLE AS least, max(score)::DOUBLE AS most, count(*) FILTER (bad) AS errors, avg((score >= 0.9)::INT) AS pass_rate FROM t GROUP BY place, variant""")
def bench_report(spark, sf):
    """Both variants over all distinct texts and two seeds; a failing task is a score of 0 and counted."""
    return _benched(spark, sf)[1]


@query("WITH c AS (SELECT c_mktsegment AS text, c_nationkey AS place, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS train_mean, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS val_mean FROM customer GROUP BY 1, 2) SELECT text, place, train_mean, val_mean, train_mean - val_mean AS generalization_gap FROM c WHERE val_mean IS NOT NULL ORDER BY -val_mean, length(text), place LIMIT 1")
def evolve_winner_gap(spark, sf):
    c = read(spark, sf, "customer")
    side = lambda k: F.avg(F.when(F.col("c_custkey") % 2 == k, F.col("c_acctbal")))
    candidates = c.groupBy(F.col("c_mktsegment").alias("text"), F.col("c_nationkey").alias("place")).agg(side(0).alias("train_mean"), side(1).alias("val_mean"))
    return evals.winner(candidates.where("val_mean IS NOT NULL"))


@query("""WITH seed AS (SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), w AS (SELECT item_id, substr(text, i::INT, 40) AS w FROM (SELECT item_id, text, unnest(range(1, length(text) - 38)) AS i FROM benchmark))
SELECT DISTINCT doc_id AS id, item_id AS sample_id FROM documents JOIN w ON contains(text, w) WHERE NOT EXISTS (SELECT 1 FROM seed WHERE contains(seed.text, w))""")
def leak_beyond_seed(spark, sf):
    """Runs that the seed template has too are no leaks."""
    bench = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    seed = bench.orderBy("id").first().text
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return evals.leak_windows(docs, bench, 40, seed=seed)


AGENT = agents.Capsule("none", "scripted", "Count characters.")


@query("SELECT doc_id, CASE WHEN length(text) >= 100 THEN length(text)::VARCHAR END AS output, CASE WHEN length(text) < 100 THEN 'ValueError: too short' END AS error FROM documents")
def agent_items(spark, sf):
    """A fake agent does each item on its own; its failures are results."""

    def answer(row):
        if len(row["text"]) < 100:
            raise ValueError("too short")
        return str(len(row["text"]))

    return agents.agent_map(read(spark, sf, "documents").select("doc_id", "text"), AGENT, agents.ScriptedAgent(answer), "doc_id").select("doc_id", "output", "error")


@query("SELECT conv_id, turn, role || ' ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS output FROM conversations")
def agent_chains(spark, sf):
    """A fake agent goes through each conversation in order, with its session carried from turn to turn."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    return agents.agent_scan(c, AGENT, agents.ScriptedAgent(lambda row: f"{row['role']} {row['n']}"), "conv_id", ["turn"]).select("conv_id", "turn", "output")


@query("SELECT target, attempt, status FROM (VALUES ('a', 1, 'completed'), ('b', 1, 'retry_scheduled'), ('c', 1, 'retry_scheduled'), ('d', 1, 'completed')) v(target, attempt, status)")
def ledger_recovery(spark, sf):
    """After a crash a saved candidate counts, a plain attempt is scheduled anew, and one with side effects waits for a decision."""
    ledger = Ledger(_store(spark), "run-0001")
    for target in "abcd":
        ledger.start(target, side_effect=target == "c")
    ledger._put("a", 1, "success_candidate", artifact="saved")
    ledger.succeed("d", "done")
    ledger.recover()
    ledger.resolve("c", attempt=1, action="retry", reason="seen by hand")
    return ledger.states().select("target", "attempt", "status")


SHAPE = T.StructType([
    T.StructField("customer", T.StringType(), False, {"comment": "who wrote"}), T.StructField("tags", T.ArrayType(T.StringType()), False),
    T.StructField("severity", T.StringType(), False, {"choices": ["low", "high"]}), T.StructField("score", T.DoubleType(), True, {"or_null": True}), T.StructField("counts", T.MapType(T.StringType(), T.LongType()), True),
])


@query("""SELECT array_to_string(['## 输出格式', '', '字段：', '- `customer`：`str`；必填；who wrote', '- `tags`：`list[str]`；必填；无描述', '- `severity`：`''low'' | ''high''`；必填；无描述', '- `score`：`float | None`；可选；无描述', '- `counts`：`dict[str, int]`；可选；无描述', '', '示例：', '```json', '{',
'  "customer": "<string>",', '  "tags": [', '    "<string>"', '  ],', '  "severity": "low",', '  "score": 0.0,', '  "counts": {}', '}', '```', '', '只输出一个 JSON 对象；不要输出解释、前后缀或代码围栏。', ''], chr(10)) AS section""")
def schema_section(spark, sf):
    return spark.range(1).select(F.lit(section_of(SHAPE)).alias("section"))


@query("""SELECT conv_id, '[' || chr(10) || string_agg('  ' || to_json(text), ',' || chr(10) ORDER BY turn) || chr(10) || ']' AS items FROM conversations GROUP BY conv_id""")
def render_items_json(spark, sf):
    listed = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return listed.select("conv_id", text.render_items(F.col("a.text"), T.ArrayType(T.StringType())).alias("items"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>') AS cell FROM documents")
def escaped_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.escape_html(F.col("text")).alias("html"), text.escape_cell(F.col("text")).alias("cell"))


@query("SELECT conv_id, turn, 'echo:' || length(text) AS response, CASE WHEN conv_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache, sha256(text) AS prompt_sha FROM conversations")
def observed_calls(spark, sf):
    """What a batch of calls did, a row for each."""
    c = read(spark, sf, "conversations").withColumn("key", calls.call_key(F.array(F.struct("role", F.concat_ws(":", "conv_id", "turn").alias("at"))), model="m", seed=1))
    answer = F.concat(F.lit("echo:"), F.length("text").cast("string"))
    done = calls.call_batch(c, c.where("conv_id % 2 = 0").select("key", answer.alias("response")), lambda df: df.select("key", answer.alias("response")))
    return done.join(calls.observed(done, model="m").select("key", "cache", "prompt_sha"), "key").select("conv_id", "turn", "response", "cache", "prompt_sha")
