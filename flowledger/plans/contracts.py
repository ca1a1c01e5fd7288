"""Queries of what may happen to a run and what is wrong with a stored one: the given tables are dealt into states, results,
sidecars and records by rules of their ids, and the SQL says which faults these rules make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canon, failures
from ..operators import admission, audit, declared, prompts
from .tables import read

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return register


AUDIT = """WITH d AS (SELECT lang AS run_id, doc_id::VARCHAR AS target, doc_id AS i FROM documents),
f AS (SELECT *, i % 13 <> 0 AS s, i % 13 <> 0 AND i % 11 <> 0 AS done, i % 5 <> 0 AS c, i % 17 = 0 AS cbad, i % 6 <> 0 AS m, i % 9 <> 0 AS a, i % 8 = 0 AS changed, i % 4 <> 1 AS known FROM d),
g AS (SELECT *, m AND NOT s AND NOT known AS away FROM f)
SELECT * FROM (SELECT run_id, target, unnest([CASE WHEN done AND NOT c THEN 'completed without candidate' END, CASE WHEN done AND NOT m THEN 'completed without sidecar' END,
CASE WHEN c AND NOT s AND NOT away THEN 'candidate without state' END, CASE WHEN c AND NOT away AND cbad THEN 'candidate digest' END, CASE WHEN m AND NOT s AND known AND i % 2 <> 0 THEN 'sidecar without state' END,
CASE WHEN m AND s AND NOT done THEN 'sidecar of no success' END, CASE WHEN m AND NOT away AND NOT a THEN 'sidecar without result' END, CASE WHEN m AND s AND c AND cbad THEN 'sidecar differs from candidate' END,
CASE WHEN m AND NOT away AND a AND changed THEN 'result digest' END, CASE WHEN a AND NOT m THEN 'result without sidecar' END]) AS violation FROM g) WHERE violation IS NOT NULL"""


@query(AUDIT)
def run_audit(spark, sf):
    """A run for each language, a target for each document."""
    d = read(spark, sf, "documents").select(F.col("lang").alias("run_id"), F.col("doc_id").cast("string").alias("target"), F.col("doc_id").alias("i"), "text")
    digest = canon.sha(F.col("text"))
    states = d.where("i % 13 <> 0").select("run_id", "target", F.when(F.col("i") % 11 == 0, "failed").otherwise("completed").alias("status"))
    candidates = d.where("i % 5 <> 0").select("run_id", "target", F.when(F.col("i") % 17 == 0, "bad").otherwise(digest).alias("digest"), F.col("text").alias("content"))
    sidecars = d.where("i % 6 <> 0").select("run_id", "target", digest.alias("digest"), F.when(F.col("i") % 2 == 0, "hit").otherwise("miss").alias("cache"))
    results = d.where("i % 9 <> 0").select("run_id", "target", F.when(F.col("i") % 8 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return audit.violations(states, candidates, sidecars, results, d.where("i % 4 <> 1").select("run_id", "target"))


STATUS = "CASE event_id % 8 WHEN 0 THEN 'running' WHEN 1 THEN 'success_candidate' WHEN 2 THEN 'retry_scheduled' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'failed' WHEN 5 THEN 'checkpoint_pending' WHEN 6 THEN 'odd' ELSE 'completed' END"
K = "(props->>'$.k')::BIGINT"
TRIED = "(event_id % 3 + 1)::INT"


def _states(spark, sf):
    """States of the events that were tried, each in an older and a newer generation."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf, "events").where("event_id % 10 <> 9").withColumn("generation", F.explode(F.array(F.lit(1), F.lit(2))))
    old = F.col("generation") == 1
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("target"), "generation", F.when(old, "running").otherwise(F.expr(STATUS)).alias("status"), (F.col("event_id") % 3 + F.when(old, 0).otherwise(1)).cast("int").alias("attempt"),
        F.when(F.col("event_id") % 7 == 0, "v0").otherwise("v1").alias("declaration"), (F.col("event_id") % 16 == 0).alias("side_effect"), k.alias("due"), F.col("props").alias("candidate"),
        canon.sha(F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props"))).alias("candidate_sha"),
    )


@query(f"""SELECT user_id AS run_id, event_id AS target, CASE WHEN event_id % 10 = 9 THEN 'run' WHEN event_id % 7 = 0 THEN 'changed' WHEN event_id % 16 = 0 THEN 'ambiguous' WHEN event_id % 8 IN (0, 5) THEN 'run'
WHEN event_id % 8 = 1 THEN CASE WHEN event_id % 3 = 0 THEN 'damaged' ELSE 'candidate' END WHEN event_id % 8 = 2 THEN CASE WHEN {K} <= 50 THEN 'run' ELSE 'pending' END WHEN event_id % 8 = 6 THEN 'invalid' ELSE {STATUS} END AS action,
(CASE WHEN event_id % 10 = 9 THEN 1 WHEN event_id % 7 <> 0 AND event_id % 8 = 2 AND {K} <= 50 THEN {TRIED} + 1 ELSE {TRIED} END)::INT AS attempt FROM events""")
def target_actions(spark, sf):
    """What a run that is taken up at time 50 does with each of its targets."""
    asked = read(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("target"), F.lit("v1").alias("declaration"))
    return admission.actions(asked, _states(spark, sf), F.lit(50))


WANTED = ("running", "pending_retry", "ambiguous", "checkpoint_pending", "completed", "failed", "paused")


@query(f"""WITH s AS (SELECT user_id AS run_id, {STATUS} AS st FROM events WHERE event_id % 10 <> 9 AND user_id % 4 <> 0), h AS (SELECT run_id, bool_or(st = 'running') AS r, bool_or(st = 'retry_scheduled') AS p, bool_or(st = 'ambiguous') AS a, bool_or(st = 'checkpoint_pending') AS c,
bool_or(st = 'failed') AS f, bool_or(st = 'completed') AS d, bool_or(st NOT IN ('completed', 'odd')) AS o FROM s GROUP BY 1), u AS (SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 5 = 0 THEN 'completed' ELSE 'running' END AS current FROM events),
q AS (SELECT u.*, w.wanted, coalesce(r, false) AS r, coalesce(p, false) AS p, coalesce(a, false) AS a, coalesce(c, false) AS c, coalesce(f, false) AS f, coalesce(d, false) AS d, coalesce(o, false) AS o
FROM u LEFT JOIN h USING (run_id), (VALUES {", ".join(f"('{w}')" for w in WANTED)}) w(wanted))
SELECT run_id, current, wanted, CASE WHEN wanted = 'paused' THEN 'unknown status' WHEN current = 'completed' AND wanted = 'running' THEN NULL WHEN wanted = 'completed' AND o THEN 'open attempts' WHEN wanted = 'completed' THEN NULL
WHEN current = 'completed' THEN 'already completed' WHEN wanted = 'failed' AND NOT f AND (r OR (d AND NOT o)) THEN 'no failure' WHEN wanted = 'pending_retry' AND NOT p THEN 'no attempt is retry_scheduled'
WHEN wanted = 'ambiguous' AND NOT a THEN 'no attempt is ambiguous' WHEN wanted = 'checkpoint_pending' AND NOT c THEN 'no attempt is checkpoint_pending' END AS refused FROM q""")
def run_updates(spark, sf):
    """Each user's run is asked to take every status; a quarter of the runs have no attempts."""
    runs = read(spark, sf, "events").select(F.col("user_id").alias("run_id")).distinct()
    asked = runs.select("run_id", F.when(F.col("run_id") % 5 == 0, "completed").otherwise("running").alias("current"), F.explode(F.array(*(F.lit(w) for w in WANTED))).alias("wanted"))
    return admission.updates(asked, _states(spark, sf).where("run_id % 4 <> 0"))


OWNER = "CASE WHEN l_linenumber = 1 THEN 'ship' WHEN l_linenumber = 7 THEN 'bill' ELSE 'ship@' || l_suppkey END"


@query(f"""WITH o AS (SELECT DISTINCT l_orderkey % 10 AS run_id, l_orderkey AS path, {OWNER} AS owner FROM lineitem)
SELECT run_id, path, (greatest(count(*) FILTER (contains(owner, '@')), count(*) FILTER (owner = 'ship')) + count(*) FILTER (owner = 'bill'))::BIGINT AS owners, min(owner) AS first_owner FROM o GROUP BY 1, 2
HAVING greatest(count(*) FILTER (contains(owner, '@')), count(*) FILTER (owner = 'ship')) + count(*) FILTER (owner = 'bill') > 1""")
def contested_outputs(spark, sf):
    """Orders as paths, which a mapping step, its items and another step write."""
    rows = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 10).alias("run_id"), F.col("l_orderkey").alias("path"), F.expr(OWNER.replace("'ship@' || l_suppkey", "concat('ship@', l_suppkey)")).alias("owner"))
    return admission.contested(rows)


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 42 WHEN event_id % 6 = 0 THEN 1500 WHEN event_id % 6 = 1 THEN 2500 WHEN event_id % 6 = 2 THEN 3000 WHEN event_id % 6 = 5 THEN 0 END::BIGINT AS wait_ms,
CASE WHEN event_id % 4 = 0 THEN 'rate_limit' WHEN event_id % 4 = 1 THEN 'timeout' WHEN event_id % 4 = 2 THEN 'model_mismatch' ELSE 'unknown' END AS kind FROM events""")
def failure_facts(spark, sf):
    """How long failed calls are asked to wait, by the error or by headers, and what they were."""
    heads = {0: {"Retry-After-MS": "1500.7", "retry-after": "9"}, 1: {"retry-after": "2.5"}, 2: {"retry-after-ms": "soon", "Retry-After": "3"}, 3: {"RETRY-AFTER": "Wed"}, 5: {"retry-after-ms": "-5"}}
    made = F.create_map().cast("map<string,string>")
    for n, head in heads.items():
        made = F.when(F.col("event_id") % 6 == n, F.create_map(*(F.lit(x) for pair in head.items() for x in pair))).otherwise(made)
    asked = F.when(F.col("event_id") % 7 == 0, 42).when(F.col("event_id") % 5 == 0, -1)
    of = F.col("event_id") % 4
    told = failures.kind(F.when(of == 0, 429), F.when(of == 2, "Model_Substitution").when(of == 1, "bad_request").when(of == 3, "odd"), F.when(of == 1, "timeout"))
    return read(spark, sf, "events").select("event_id", failures.retry_after_ms(asked, made).alias("wait_ms"), told.alias("kind"))


FAULT = """CASE doc_id % 13 WHEN 1 THEN 'missing: axes' WHEN 2 THEN 'schema' WHEN 3 THEN 'digest' WHEN 4 THEN 'schema' WHEN 5 THEN 'lineage of another round' WHEN 6 THEN 'incomplete lineage' WHEN 7 THEN 'contents: attachments'
WHEN 8 THEN 'extra: note' WHEN 9 THEN 'lineage of another record' WHEN 10 THEN 'types: layers' WHEN 11 THEN 'contents: messages' END"""


@query(f"SELECT doc_id, {FAULT} AS problem FROM documents")
def resolution_records(spark, sf):
    """Whole documents as the message of a stored resolution; eleven of thirteen are damaged in one way each."""
    d, digest, i = read(spark, sf, "documents"), canon.sha(F.col("text")), F.col("doc_id") % 13
    named = lambda **c: F.struct(*(v.alias(n) for n, v in c.items()))
    made = named(
        prompt_resolution_schema=F.lit(1), spec=F.lit("summary"), structure_digest=canon.sha(F.lit("summary")), base=named(name=F.lit("base"), digest=digest), layers=F.array(named(name=F.lit("tone"), digest=digest)),
        axes=F.array(named(name=F.lit("lang"), variant=F.col("lang"))), materials=F.array(named(name=F.lit("text"), digest=digest)), rendered=named(sha256=digest, bytes=F.octet_length("text").cast("long")),
        messages=F.array(named(role=F.when(i == 11, "tool").otherwise("user"), parts=F.array("text"))),
        attachments=F.array(named(path=F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), content_hash=digest, mime_type=F.lit("text/plain"), size_bytes=F.when(i == 7, -1).otherwise(F.octet_length("text")).cast("long"))),
        response_spec=named(schema_sha256=canon.sha(F.lit("{}")), format=F.lit("text")),
    )
    stored = prompts.sealed(d.select("doc_id", made.alias("r")), "r", "said", phase=F.lit("primary"), repair_round=F.when(i == 5, 1).otherwise(0))
    damage = {
        1: F.regexp_replace("said", r',"axes":\[[^\]]*\]', ""), 2: F.replace("said", F.lit('{"prompt_resolution_schema":1'), F.lit('{"prompt_resolution_schema":2')), 3: F.replace("said", F.lit('"spec":"summary"'), F.lit('"spec":"other"')),
        4: F.concat(F.lit("["), "said", F.lit("]")), 6: F.regexp_replace("said", r',"phase":"primary"', ""), 8: F.concat(F.lit('{"note":1,'), F.substr("said", F.lit(2))),
        9: F.regexp_replace("said", r'"base_resolution_digest":"[0-9a-f]{8}', '"base_resolution_digest":"00000000'), 10: F.regexp_replace("said", r'"layers":\[[^\]]*\]', '"layers":{}'),
    }
    said = F.col("said")
    for n, c in damage.items():
        said = F.when(i == n, c).otherwise(said)
    return prompts.problems(stored.select("doc_id", said.alias("said")), "said").select("doc_id", "problem")


@query("""WITH m AS (SELECT conv_id AS request_id, (sum(octet_length(encode(text))) + 3) // 4 AS t FROM conversations GROUP BY 1), a AS (SELECT doc_id // 4 AS request_id, count(*) AS n, sum(octet_length(encode(text))) AS b FROM documents GROUP BY 1),
j AS (SELECT request_id, coalesce(t, 0) AS t, coalesce(n, 0) AS n, coalesce(b, 0) AS b FROM m FULL JOIN a USING (request_id)), r AS (SELECT request_id, unnest(['token_count', 'attachment_count', 'byte_size']) AS "check", unnest([150, 3, 4000]) AS "limit", unnest([t, n, b]) AS actual FROM j)
SELECT request_id, "check", "limit"::BIGINT AS "limit", actual::BIGINT AS actual FROM r WHERE actual > "limit\"""")
def requests_over_limits(spark, sf):
    """Conversations as requests, four documents attached to each."""
    messages = read(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), "text")
    files = read(spark, sf, "documents").select(F.expr("doc_id div 4").alias("request_id"), F.octet_length("text").alias("size_bytes"))
    return prompts.over_limits(messages, files, prompts.Limits(150, 3, 4000))


SUMMARY = declared.Prompt(
    "summary", "summary/base", {"task": "summary/task", "tone": declared.Choice("tone", "item.lang", {"en": "tone/brief", "de": "tone/kurz", "fr": "tone/brief"})},
    {"doc": declared.Material("item.text", title="Text"), "size": declared.Material("item.facts")},
)
TEXTS = {"summary/base": "{{task}}\nTone: {{tone}}\n\n{{doc}}\nFacts:\n{{size}}{{task}}", "summary/task": "Summarise.", "tone/brief": "Be brief.", "tone/kurz": "Kurz."}
_SHA = {n: f"sha256('{t}')".replace("\n", "' || chr(10) || '") for n, t in TEXTS.items()}


def _listed(*objects: dict) -> str:
    """SQL of the canonical JSON of a list of objects whose values are SQL, one level in."""
    each = [" || ',' || chr(10) || ".join(f"""'      "{k}": ' || {v}""" for k, v in sorted(o.items())) for o in objects]
    return "'[' || chr(10) || " + " || ',' || chr(10) || ".join(f"'    {{' || chr(10) || {e} || chr(10) || '    }}'" for e in each) + " || chr(10) || '  ]'"


def _object(depth: int, **fields: str) -> str:
    pad = "  " * depth
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(f"""'{pad}  "{k}": ' || {v}""" for k, v in sorted(fields.items())) + f" || chr(10) || '{pad}}}'"


_DIGESTED = _object(
    0, prompt_resolution_schema="'1'", spec="""'"summary"'""", structure_digest=f"""'"{SUMMARY.structure_digest}"'""", base=_object(1, name="""'"summary/base"'""", digest=f"to_json({_SHA['summary/base']})"),
    layers=_listed({"name": """'"summary/task"'""", "digest": f"to_json({_SHA['summary/task']})"}, {"name": "to_json(CASE lang WHEN 'de' THEN 'tone/kurz' ELSE 'tone/brief' END)", "digest": "to_json(sha256(tone))"}),
    axes=_listed({"name": """'"tone"'""", "variant": "to_json(lang)"}), materials=_listed({"name": """'"doc"'""", "digest": "to_json(sha256(doc))"}, {"name": """'"size"'""", "digest": "to_json(sha256(size))"}),
    rendered=_object(1, sha256="to_json(sha256(prompt))", bytes="octet_length(encode(prompt))"), attachments="'[]'", response_spec=_object(1, schema_sha256="to_json(sha256('{}'))", format="""'"text"'"""),
    messages="""'[' || chr(10) || '    {' || chr(10) || '      "parts": [' || chr(10) || '        ' || to_json(prompt) || chr(10) || '      ],' || chr(10) || '      "role": "user"' || chr(10) || '    }' || chr(10) || '  ]'""",
)


@query(f"""WITH m AS (SELECT doc_id, lang, CASE lang WHEN 'de' THEN 'Kurz.' WHEN 'en' THEN 'Be brief.' WHEN 'fr' THEN 'Be brief.' END AS tone, '## Text' || chr(10) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) AS doc,
'```json' || chr(10) || '{{' || chr(10) || '  "chars": ' || n_chars || ',' || chr(10) || '  "of": ' || to_json(source) || chr(10) || '}}' || chr(10) || '```' || chr(10) AS size FROM documents),
r AS (SELECT *, 'Summarise.' || chr(10) || 'Tone: ' || tone || chr(10) || chr(10) || doc || chr(10) || 'Facts:' || chr(10) || size || 'Summarise.' AS prompt FROM m)
SELECT doc_id, sha256(prompt) AS prompt_sha, CASE WHEN prompt IS NOT NULL THEN sha256({_DIGESTED}) END AS resolution_digest, CASE WHEN tone IS NULL THEN 'choice tone: unknown variant ' || lang END AS problem FROM r""")
def declared_prompts(spark, sf):
    """Whole documents as material of a declared prompt; its tone has no variant for one of the languages."""
    item = F.struct("lang", "text", F.struct(F.col("n_chars").alias("chars"), F.col("source").alias("of")).alias("facts"))
    declared.check([SUMMARY], ["item"], "map")
    made = declared.resolve(read(spark, sf, "documents").select("doc_id", item.alias("item")), SUMMARY, declared.Catalog(TEXTS))
    return made.select("doc_id", canon.sha(F.col("prompt")).alias("prompt_sha"), declared.resolution_digest().alias("resolution_digest"), F.col("prompt_problem").alias("problem"))


REPLY = declared.Prompt("reply", "base", {"who": declared.Choice("who", "role", {"user": "user", "assistant": "assistant", "system": "system"})}, {"said": declared.Material("text")})


@query("""SELECT conv_id, turn, sha256(prompt) AS prompt_sha, turn % 3 <> 0 AS has_lineage FROM (SELECT conv_id, turn, upper(left(role, 1)) || substr(role, 2) || ':' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || CASE WHEN turn % 3 = 0 THEN '!' ELSE '' END AS prompt FROM conversations)""")
def prompt_lineage(spark, sf):
    """Turns as prompts, of which every third is changed after it was made: its record is no longer its own."""
    texts = {"base": "{{who}}:\n{{said}}", "user": "User", "assistant": "Assistant", "system": "System"}
    made = declared.resolve(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), REPLY, declared.Catalog(texts))
    changed = made.withColumn("prompt", F.when(F.col("turn") % 3 == 0, F.concat("prompt", F.lit("!"))).otherwise(F.trim(F.concat("prompt", F.lit("")), F.lit("~"))))
    return declared.with_lineage(changed).select("conv_id", "turn", canon.sha(F.col("prompt")).alias("prompt_sha"), F.col("prompt_record").isNotNull().alias("has_lineage"))


READ = declared.Prompt("read", "base", {}, {"page": declared.Material("props.path", title="Page", file=True)})


@query("""WITH n AS (SELECT count(*) AS n FROM pages), e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id % (n + 5) END AS page FROM events, n), f AS (SELECT e.*, p.html, 'pages/' || page || '.html' AS path FROM e LEFT JOIN pages p ON p.page_id = page)
SELECT event_id, CASE WHEN page IS NULL THEN 'material page: no path' WHEN html IS NULL THEN 'material page: no file ' || path WHEN page % 11 = 0 THEN 'material page: not UTF-8: ' || path END AS problem,
CASE WHEN page % 11 <> 0 THEN sha256('## Page' || chr(10) || chr(10) || '```' || chr(10) || html || chr(10) || '```' || chr(10)) END AS prompt_sha, CASE WHEN page % 11 <> 0 THEN sha256(html) END AS content_hash,
CASE WHEN page % 11 <> 0 AND html IS NOT NULL THEN octet_length(encode(html)) END AS size_bytes, CASE WHEN page % 11 <> 0 AND html IS NOT NULL THEN 'text/html' END AS mime_type FROM f""")
def prompt_files(spark, sf):
    """Events name pages by paths in their props; whole pages are the files, some aren't UTF-8, and some paths name none."""
    pages = read(spark, sf, "pages")
    bad = F.col("page_id") % 11 == 0
    held = pages.select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.when(bad, F.concat(F.unhex(F.lit("FF")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary")).alias("content"))
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    path = F.concat(F.lit("pages/"), (F.col("event_id") % (F.col("n") + 5)).cast("string"), F.lit(".html"))
    asked = read(spark, sf, "events").select("event_id").crossJoin(F.broadcast(n))  # one row
    asked = asked.select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(path.alias("path")))).alias("props"))
    made = declared.resolve(asked, READ, declared.Catalog({"base": "{{page}}"}), files=held)
    file = F.get(F.col("prompt_record")["attachments"], F.lit(0))
    return made.select("event_id", F.col("prompt_problem").alias("problem"), canon.sha(F.col("prompt")).alias("prompt_sha"), file["content_hash"].alias("content_hash"), file["size_bytes"].alias("size_bytes"), file["mime_type"].alias("mime_type"))
