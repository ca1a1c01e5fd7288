"""Queries of the scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import canon, failures, text
from ..functions.urls import SECRET_ENDS, SECRET_KEYS, scrub_url, scrub_urls_in
from .tables import literal_rows, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def whole_sql(sql: str) -> str:
    """A query's SQL on the whole texts: the column in place of its prefix, and a fence that outgrows the text where it was three backticks."""
    mark = "repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0))::INT)"
    return re.sub(r"substr\(text, 1, \d+\)", "text", sql).replace("'```'", mark)


NL = "chr(10)"
CANON_DOC = f"""'{{' || {NL} || '  "doc_id": ' || doc_id || ',' || {NL} || '  "lang": ' || to_json(lang) || ',' || {NL} || '  "text": ' || to_json(text) || {NL} || '}}'"""


def canon_doc():
    return canon.canonical_struct(doc_id=(F.col("doc_id"), "bigint"), lang=(F.col("lang"), "string"), text=(F.col("text"), "string"))


@query(f"SELECT doc_id, {CANON_DOC} AS canonical FROM documents")
def canonical_json(spark, sf):
    return read(spark, sf, "documents").select("doc_id", canon_doc().alias("canonical"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", canon.sha(F.col("text")).alias("digest"))


@query(whole_sql("""WITH d AS (SELECT doc_id, substr(text, 1, 200) || chr(10) || repeat('`', (doc_id % 7)::INT) || ' end' AS body FROM documents),
f AS (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(body, '`+'), lambda x: length(x))), 0))::INT) AS mark FROM d)
SELECT doc_id, '## Material' || chr(10) || chr(10) || mark || chr(10) || body || chr(10) || mark || chr(10) AS block FROM f"""))
def inject_docs(spark, sf):
    return _inject_docs(spark, sf, F.col("text"))


def _inject_docs(spark, sf, t):
    body = F.concat(t, F.lit("\n"), F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.lit(" end"))
    return read(spark, sf, "documents").select("doc_id", text.inject(body, title="Material").alias("block"))


SLOTTED = "'Dear {{name}}, {{lang}} of {{name}}: {{x_' || (doc_id % 3) || '}} {{Bad}} {{ok_1}}'"


def slotted():
    return F.concat(F.lit("Dear {{name}}, {{lang}} of {{name}}: {{x_"), (F.col("doc_id") % 3).cast("string"), F.lit("}} {{Bad}} {{ok_1}}"))


@query(f"SELECT doc_id, 'name,lang,x_' || (doc_id % 3) || ',ok_1' AS names, CASE WHEN doc_id % 3 = 0 THEN 'x_1' ELSE 'x_0' || CASE WHEN doc_id % 3 = 2 THEN ',x_1' ELSE '' END END AS extra, CASE WHEN doc_id % 3 = 2 THEN 'ok_1,x_2' ELSE 'ok_1' END AS missing_all FROM documents")
def slot_names(spark, sf):
    match = text.slots_match(slotted(), F.array(*map(F.lit, ("name", "lang", "x_0", "x_1"))))
    df = read(spark, sf, "documents").select("doc_id", F.array_join(text.slot_names(slotted()), ",").alias("names"), match.alias("m"))
    return df.select("doc_id", "names", F.array_join("m.extra", ",").alias("extra"), F.array_join("m.missing", ",").alias("missing_all"))


@query("SELECT doc_id, 'To {{lang}} from ' || lang || ' and ' || source || ' about {{lang}}.' AS rendered FROM documents")
def render_template(spark, sf):
    slots = F.create_map(F.lit("who"), F.lit("{{lang}}"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    template = F.lit("To {{who}} from {{lang}} and {{source}} about {{who}}.")
    return read(spark, sf, "documents").select("doc_id", text.render_template(template, slots).alias("rendered"))


@query(whole_sql("""SELECT doc_id, CASE WHEN v = '' THEN '' ELSE '## Part' || chr(10) || chr(10) || v || CASE WHEN ends_with(v, chr(10)) THEN '' ELSE chr(10) END END AS part
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 100) ELSE substr(text, 1, 50) || chr(10) END AS v FROM documents)"""))
def section_docs(spark, sf):
    return _section_docs(spark, sf, F.col("text"), F.col("text"))


def _section_docs(spark, sf, one, two):
    v = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, one).otherwise(F.concat(two, F.lit("\n")))
    return read(spark, sf, "documents").select("doc_id", text.section("Part", v).alias("part"))


def _clip_sql(pattern: str) -> str:
    return f"""WITH d AS (SELECT doc_id, text, length(text) AS n, substr(text, 1, 500) AS p FROM documents),
k AS (SELECT *, CASE WHEN regexp_extract(p, '{pattern}', 1) = '' THEN p ELSE regexp_extract(p, '{pattern}', 1) END AS kept FROM d)
SELECT doc_id, n > 500 AS clipped, n::INT AS original_chars, (CASE WHEN n <= 500 THEN n ELSE length(kept) END)::INT AS kept_chars, CASE WHEN n <= 500 THEN text
  ELSE kept || CASE WHEN kept = '' OR ends_with(kept, chr(10)) THEN '' ELSE chr(10) END || '(已截断：原文 ' || n || ' 字，保留 ' || length(kept) || ' 字)' END AS text FROM k"""


def _clip(spark, sf, boundary):
    return read(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 500, boundary).alias("c")).select("doc_id", "c.clipped", "c.original_chars", "c.kept_chars", "c.text")


@query(_clip_sql("(?s)^(.*\\n)"))
def clip_line(spark, sf):
    return _clip(spark, sf, "line")


@query(_clip_sql("(?s)^(.*[。！？.!?])"))
def clip_sentence(spark, sf):
    return _clip(spark, sf, "sentence")


@query(whole_sql("SELECT conv_id, string_agg('- ' || replace(substr(text, 1, 80), chr(10), chr(10) || '  '), chr(10) ORDER BY turn) AS bullets FROM conversations GROUP BY conv_id"))
def render_bullets(spark, sf):
    return _render_bullets(spark, sf, F.col("text"))


def _render_bullets(spark, sf, t):
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))).alias("all"))
    return turns.select("conv_id", text.render_bullets(F.col("all.t")).alias("bullets"))


RAW = "CASE doc_id % 4 WHEN 0 THEN '```json' || chr(10) || '{\"a\": ' || doc_id || '}' || chr(10) || '```' WHEN 1 THEN ' ```' || chr(10) || lang || chr(10) || '``` ' || chr(10) WHEN 2 THEN 'so ```' || chr(10) || lang || chr(10) || '```' ELSE lang END"


def raw_reply():
    k = F.col("doc_id") % 4
    return (
        F.when(k == 0, F.concat(F.lit('```json\n{"a": '), F.col("doc_id").cast("string"), F.lit("}\n```")))
        .when(k == 1, F.concat(F.lit(" ```\n"), "lang", F.lit("\n``` \n"))).when(k == 2, F.concat(F.lit("so ```\n"), "lang", F.lit("\n```"))).otherwise(F.col("lang"))
    )


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{{\"a\": ' || doc_id || '}}' WHEN 1 THEN lang ELSE {RAW} END AS plain FROM documents")
def strip_json_fence(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.strip_json_fence(raw_reply()).alias("plain"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'x' || chr(10) || '```' || chr(10) || lang WHEN 1 THEN source END AS inner_text FROM documents")
def extract_fenced(spark, sf):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("a\n```md\nx\n```\n"), "lang", F.lit("\n```\nafter"))).when(k == 1, F.concat(F.lit("```\n\n "), "source", F.lit("\n\n```"))).otherwise(F.lit("```\nopen"))
    return read(spark, sf, "documents").select("doc_id", text.extract_fenced(raw).alias("inner_text"))


@query("SELECT conv_id, turn, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS preflight, (greatest(1, length(text) // 4 * 2) + 256)::BIGINT AS budget FROM conversations")
def token_estimates(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.preflight_tokens(F.col("text")).alias("preflight"), text.budget_tokens(F.length("text"), 256).alias("budget"))


@query("SELECT doc_id, 'key ***; *** then ***; ' || lang AS scrubbed FROM documents")
def scrub_bearer(spark, sf):
    raw = F.concat(F.lit("key s3cret-"), (F.col("doc_id") % 2).cast("string"), F.lit("; Bearer abc."), F.col("doc_id").cast("string"), F.lit("== then basic "), F.col("source"), F.lit("; "), "lang")
    return read(spark, sf, "documents").select("doc_id", text.scrub_bearer(text.scrub_values(raw, ["s3cret-0", "s3cret-1"])).alias("scrubbed"))


SECRET_URL = "split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=t' || page_id || '&my-api-key=k&empty=&a+b=%C3%A9*~%20x'"
SECRET_KEY = f"list_contains({list(SECRET_KEYS)}, k) OR regexp_matches(k, '({'|'.join(SECRET_ENDS)})$')"
_FORM = "replace(replace(replace(url_encode({0}), '%20', '+'), '*', '%2A'), '%7E', '~')"
SCRUBBED = f"""WITH u AS (SELECT page_id, {SECRET_URL} AS url FROM pages),
p AS (SELECT page_id, split_part(url, '?', 1) AS head, unnest(list_filter(string_split(substr(url, instr(url, '?') + 1), '&'), lambda x: x <> '')) AS part, generate_subscripts(list_filter(string_split(substr(url, instr(url, '?') + 1), '&'), lambda x: x <> ''), 1) AS i FROM u),
d AS (SELECT page_id, head, i, url_decode(replace(split_part(part, '=', 1), '+', ' ')) AS key, url_decode(replace(CASE WHEN contains(part, '=') THEN substr(part, instr(part, '=') + 1) ELSE '' END, '+', ' ')) AS value FROM p),
s AS (SELECT *, translate(lower(key), '-', '_') AS k FROM d)
SELECT page_id, head || '?' || string_agg({_FORM.format("key")} || '=' || {_FORM.format(f"CASE WHEN {SECRET_KEY} THEN '***' ELSE value END")}, '&' ORDER BY i) AS scrubbed FROM s GROUP BY page_id, head"""


def _secret_url():
    mark = F.when(F.col("url").contains("?"), "&").otherwise("?")
    return F.concat(F.split_part("url", F.lit("#"), F.lit(1)), mark, F.lit("token=t"), F.col("page_id").cast("string"), F.lit("&my-api-key=k&empty=&a+b=%C3%A9*~%20x"))


@query(SCRUBBED)
def scrub_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", scrub_url(_secret_url()).alias("scrubbed"))


@query(f"SELECT page_id, 'see ' || scrubbed || ' and <' || scrubbed || '> end' AS scrubbed FROM ({SCRUBBED})")
def scrub_urls_in_text(spark, sf):
    """URLs inside a text, the rest of which stays."""
    whole = F.concat(F.lit("see "), _secret_url(), F.lit(" and <"), _secret_url(), F.lit("> end"))
    return read(spark, sf, "pages").select("page_id", scrub_urls_in(whole).alias("scrubbed"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '{' || chr(10) || '  "bytes": ' || octet_length(encode(to_json(text))) || ',' || chr(10) || '  "redacted": true,' || chr(10) || '  "sha256": "' || sha256(to_json(text)) || '"' || chr(10) || '}'
ELSE sha256(text) END AS kept FROM conversations""")
def evidence_modes(spark, sf):
    """Full, redacted (digest and size of the canonical content) and hash-only evidence, by turn."""
    content = canon.json_string(F.col("text"))
    redacted = canon.canonical_struct(redacted=(F.lit(True), "boolean"), sha256=(canon.sha(content), "string"), bytes=(F.octet_length(content), "bigint"))
    kept = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, redacted).otherwise(canon.sha(F.col("text")))
    return read(spark, sf, "conversations").select("conv_id", "turn", kept.alias("kept"))


PROMPTS = [("base", "any", "Summarise."), ("tone", "en", "Be brief."), ("tone", "de", "Kurz."), ("tone", "fr", "Bref."), ("tone", "es", "Breve.")]
PROMPT_SQL = "(VALUES ('base', 'any', 'Summarise.'), ('tone', 'en', 'Be brief.'), ('tone', 'de', 'Kurz.'), ('tone', 'fr', 'Bref.'), ('tone', 'es', 'Breve.'))"


@query(whole_sql(f"""WITH p(layer, variant, body) AS {PROMPT_SQL}, r AS (SELECT doc_id, lang, 'Summarise.' || chr(10) || body || chr(10) || '## Text' || chr(10) || chr(10) || '```' || chr(10) || substr(text, 1, 60) || chr(10) || '```' || chr(10) AS prompt
FROM documents JOIN p ON layer = 'tone' AND variant = lang)
SELECT doc_id, lang AS variant, prompt, sha256(prompt) AS prompt_sha, length(prompt)::INT AS chars FROM r"""))
def prompt_resolution(spark, sf):
    return _prompt_resolution(spark, sf, F.col("text"))


def _prompt_resolution(spark, sf, t):
    tone = literal_rows(spark, "layer variant body", PROMPTS).where("layer = 'tone'").select("variant", "body")
    docs = read(spark, sf, "documents").join(F.broadcast(tone), F.col("lang") == F.col("variant"))
    prompt = F.concat(F.lit("Summarise.\n"), "body", F.lit("\n"), text.inject(t, title="Text"))
    return docs.select("doc_id", "variant", prompt.alias("prompt")).withColumns({"prompt_sha": canon.sha(F.col("prompt")), "chars": F.length("prompt")})


@query("""SELECT doc_id, sha256('{' || chr(10) || '  "axis": ' || to_json(lang) || ',' || chr(10) || '  "materials": [' || chr(10) || '    "' || sha256(text) || '"' || chr(10) || '  ],' || chr(10) || '  "schema": 1' || chr(10) || '}') AS digest FROM documents""")
def resolution_digest(spark, sf):
    """Digest of a resolution record without the paths of its attachments."""
    record = canon.canonical_struct(schema=(F.lit(1), "int"), axis=(F.col("lang"), "string"), materials=(F.array(canon.sha(F.col("text"))), "array<string>"))
    return read(spark, sf, "documents").select("doc_id", canon.sha(record).alias("digest"))


@query("""WITH a AS (SELECT event_id, unnest([1, 2, 3]) AS attempt FROM events), f AS (SELECT *, least(15.0, 10.0 * 2.0 ** (attempt - 1)) AS cap,
('0x' || substr(sha256('run-0001' || chr(92) || '0' || event_id || chr(92) || '0' || attempt || chr(92) || '0' || sha256('policy')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS part FROM a)
SELECT event_id, attempt::BIGINT AS attempt, round(greatest(cap * part, CASE WHEN event_id % 5 = 0 THEN 12.0 ELSE 0 END), 9) AS delay FROM f""")
def retry_schedule(spark, sf):
    tries = read(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("attempt"))
    cap = F.least(F.lit(15.0), 10.0 * F.pow(F.lit(2.0), F.col("attempt") - 1))
    part = text.jitter_fraction(F.lit("run-0001"), F.col("event_id").cast("string"), F.col("attempt"), canon.sha(F.lit("policy")))
    asked = F.when(F.col("event_id") % 5 == 0, F.lit(12.0)).otherwise(F.lit(0.0))
    return tries.select("event_id", "attempt", F.round(F.greatest(cap * part, asked), 9).alias("delay"))


STATUS_SQL = "CASE event_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 401 WHEN 3 THEN 403 WHEN 4 THEN 418 END"
CODE_SQL = "CASE event_id % 9 WHEN 5 THEN 'Rate_Limited' WHEN 6 THEN 'timeout' WHEN 7 THEN 'odd' END"
def status_of():
    return F.expr(STATUS_SQL)


@query(f"""SELECT event_id, CASE WHEN s = 429 THEN 'rate_limit' WHEN s BETWEEN 500 AND 599 THEN 'server_error' WHEN s = 401 THEN 'authentication' WHEN s = 403 THEN 'authorization' WHEN s BETWEEN 400 AND 499 THEN 'invalid_request'
WHEN lower(c) IN ('rate_limit', 'rate_limited', 'too_many_requests') THEN 'rate_limit' WHEN lower(c) = 'timeout' THEN 'timeout' ELSE 'unknown' END AS kind FROM (SELECT event_id, {STATUS_SQL} AS s, {CODE_SQL} AS c FROM events)""")
def failure_kinds(spark, sf):
    return read(spark, sf, "events").select("event_id", failures.kind(status_of(), F.expr(CODE_SQL)).alias("kind"))


@query("""SELECT event_id, sha256('{' || chr(10) || '  "kind": ' || to_json(event_type) || ',' || chr(10) || '  "message_digest": "' || sha256(props) || '"' || chr(10) || '}') AS failure FROM events""")
def failure_digest(spark, sf):
    record = canon.canonical_struct(kind=(F.col("event_type"), "string"), message_digest=(canon.sha(F.col("props")), "string"))
    return read(spark, sf, "events").select("event_id", canon.sha(record).alias("failure"))


@query("SELECT doc_id, CASE WHEN quality > toxic THEN 1.0 WHEN quality = toxic THEN 0.8 ELSE 0.3 END::DOUBLE AS score FROM labels")
def pairwise_scores(spark, sf):
    verdict = F.when(F.col("quality") > F.col("toxic"), "better").when(F.col("quality") == F.col("toxic"), "comparable").otherwise("worse")
    scores = F.create_map(F.lit("better"), F.lit(1.0), F.lit("comparable"), F.lit(0.8), F.lit("worse"), F.lit(0.3))
    return read(spark, sf, "labels").select("doc_id", F.element_at(scores, verdict).alias("score"))


@query(whole_sql("""SELECT doc_id, replace(replace(replace(t, '&', '&amp;'), '"', '&quot;'), chr(10), '<br/>') AS label, CASE WHEN length(t) <= 40 THEN t ELSE substr(t, 1, 37) || '...' END AS short_label FROM (SELECT doc_id, lang || ' & "' || source || '"' || chr(10) || substr(text, 1, 60) AS t FROM documents)"""))
def mermaid_labels(spark, sf):
    return _mermaid_labels(spark, sf, F.col("text"))


def _mermaid_labels(spark, sf, body):
    t = F.concat("lang", F.lit(' & "'), "source", F.lit('"\n'), body)
    return read(spark, sf, "documents").select("doc_id", text.mermaid_label(t).alias("label"), text.shortened(t, 40).alias("short_label"))


@query("SELECT c_custkey, 'n_' || substr(sha256(c_name), 1, 12) AS node_id FROM customer")
def mermaid_ids(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", text.mermaid_id(F.col("c_name")).alias("node_id"))


@query(whole_sql("""WITH m AS (SELECT conv_id, list({'role': role, 'text': substr(text, 1, 40)} ORDER BY turn) AS msgs, any_value(role) FILTER (turn = 0) AS first_role FROM conversations GROUP BY conv_id)
SELECT conv_id, first_role IS NOT DISTINCT FROM 'system' AS conflict, CASE WHEN first_role IS NOT DISTINCT FROM 'system' THEN NULL ELSE 'system:Answer.' || chr(10) || array_to_string(list_transform(msgs, lambda x: x.role || ':' || x.text), chr(10)) END AS wire, '{"type":"json_object"}' AS response_format FROM m"""))
def normalize_messages(spark, sf):
    return _normalize_messages(spark, sf, F.col("text"))


def _normalize_messages(spark, sf, t):
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", t.alias("text")))).alias("m"), F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))
    conflict = F.col("first_role").eqNullSafe(F.lit("system"))
    full = F.array_insert(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), 1, F.lit("system:Answer."))
    return turns.select("conv_id", conflict.alias("conflict"), F.when(~conflict, F.array_join(full, "\n")).alias("wire"), F.to_json(F.struct(F.lit("json_object").alias("type"))).alias("response_format"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'model-large' WHEN 'MACHINERY' THEN 'model-small' ELSE c_mktsegment END AS model FROM customer")
def alias_resolve(spark, sf):
    names = F.create_map(F.lit("BUILDING"), F.lit("model-large"), F.lit("MACHINERY"), F.lit("model-small"))
    return read(spark, sf, "customer").select("c_custkey", F.coalesce(F.element_at(names, F.col("c_mktsegment")), "c_mktsegment").alias("model"))


@query(f"SELECT doc_id, CASE WHEN length(c) <= 500 THEN c ELSE substr(c, 1, 500) || '（已截断）' END AS summary FROM (SELECT doc_id, {CANON_DOC} AS c FROM documents)")
def example_summary(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.example_summary(canon_doc()).alias("summary"))


@query("""SELECT user_id, sum(k)::BIGINT AS input_tokens, sum(CASE WHEN event_type = 'error' THEN 0 ELSE k * 2 END)::BIGINT AS output_tokens, sum(k + CASE WHEN event_type = 'error' THEN 0 ELSE k * 2 END)::BIGINT AS total_tokens
FROM (SELECT user_id, event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY user_id""")
def usage_normalize(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    one = read(spark, sf, "events").select("user_id", k.alias("i"), F.when(F.col("event_type") == "error", 0).otherwise(k * 2).alias("o"))
    return one.groupBy("user_id").agg(F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.col("i") + F.col("o")).alias("total_tokens"))


@query(whole_sql("SELECT doc_id, 'data:text/plain;base64,' || to_base64(encode(substr(text, 1, 300))) AS data_url, sha256(substr(text, 1, 300)) AS digest FROM documents"))
def attachment_data_url(spark, sf):
    return _attachment_data_url(spark, sf, F.col("text"))


def _attachment_data_url(spark, sf, t):
    content = t.cast("binary")
    return read(spark, sf, "documents").select("doc_id", F.concat(F.lit("data:text/plain;base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))).alias("data_url"), F.sha2(content, 256).alias("digest"))
