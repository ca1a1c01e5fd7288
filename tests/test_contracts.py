"""Admission, audit, stored resolutions and failure facts on small cases that are told outright."""

import json

import pytest
from pyspark.sql import functions as F

from flowledger.functions import failures
from flowledger.functions.canon import sha
from flowledger.operators import admission, audit, prompts

STATE = "run_id string, target string, generation int, status string, attempt int, declaration string, side_effect boolean, due long, candidate string, candidate_sha string"


def states(spark, *rows):
    return spark.createDataFrame([("r", t, g, s, n, d, e, due, c, h) for t, g, s, n, d, e, due, c, h in rows], STATE)


def test_actions(spark):
    good = spark.range(1).select(sha(F.lit("x"))).first()[0]
    held = states(
        spark, ("a", 1, "completed", 1, "v", None, None, None, None), ("a", 2, "retry_scheduled", 2, "v", None, 10, None, None), ("b", 1, "retry_scheduled", 1, "v", None, 11, None, None), ("c", 1, "running", 3, "v", None, None, None, None),
        ("d", 1, "running", 1, "v", True, None, None, None), ("e", 1, "success_candidate", 1, "v", None, None, "x", good), ("f", 1, "success_candidate", 1, "v", None, None, "y", good), ("g", 1, "success_candidate", 1, "v", None, None, None, good),
        ("h", 1, "completed", 1, "old", None, None, None, None), ("i", 1, None, 1, "v", None, None, None, None), ("j", 1, "retry_scheduled", 1, "v", None, None, None, None), ("other", 1, "failed", 1, "v", None, None, None, None),
    )
    asked = spark.createDataFrame([("r", t, "v") for t in "abcdefghijk"] + [("r", None, "v")], "run_id string, target string, declaration string")
    got = {r.target: (r.action, r.attempt) for r in admission.actions(asked, held, F.lit(10)).collect()}
    assert got == {
        "a": ("run", 3), "b": ("pending", 1), "c": ("run", 3), "d": ("ambiguous", 1), "e": ("candidate", 1), "f": ("damaged", 1), "g": ("damaged", 1), "h": ("changed", 1),
        "i": ("invalid", 1), "j": ("pending", 1), "k": ("run", 1), None: ("run", 1),
    }
    assert admission.actions(asked, held.where("false"), F.lit(10)).where("action <> 'run' OR attempt <> 1").count() == 0


@pytest.mark.parametrize(
    "attempts, refused",
    [
        ([], {"pending_retry", "ambiguous", "checkpoint_pending"}),
        (["completed", "completed"], {"pending_retry", "ambiguous", "checkpoint_pending", "failed"}),
        (["completed", "running"], {"pending_retry", "ambiguous", "checkpoint_pending", "completed", "failed"}),
        (["failed", "running"], {"pending_retry", "ambiguous", "checkpoint_pending", "completed"}),
        (["retry_scheduled"], {"ambiguous", "checkpoint_pending", "completed"}),
        (["ambiguous", "checkpoint_pending"], {"pending_retry", "completed"}),
    ],
)
def test_updates(spark, attempts, refused):
    held = states(spark, *((str(i), 1, s, 1, "v", None, None, None, None) for i, s in enumerate(attempts)))
    asked = spark.createDataFrame([("r", "running", w) for w in admission.RUN_STATUSES] + [("r", "completed", w) for w in admission.RUN_STATUSES], "run_id string, current string, wanted string")
    rows = admission.updates(asked, held).collect()
    assert {r.wanted for r in rows if r.current == "running" and r.refused} == refused
    ended = {r.wanted for r in rows if r.current == "completed" and r.refused}
    assert ended == set(admission.RUN_STATUSES) - {"running", "completed"} | ({"completed"} & refused)
    assert [r.refused for r in admission.updates(asked.limit(1).withColumn("wanted", F.lit(None).cast("string")), held).collect()] == ["unknown status"]


def test_contested(spark):
    rows = [(1, "p", "map"), (1, "p", "map@1"), (1, "p", "map@1"), (1, "q", "map@1"), (1, "q", "map@2"), (1, "s", "a"), (1, "s", "b"), (2, "s", "a"), (1, "u", None), (1, "v", "map"), (1, "v", "other@1"), (1, "w", "a@")]
    got = admission.contested(spark.createDataFrame(rows, "run_id int, path string, owner string")).collect()
    assert {(r.path, r.owners, r.first_owner) for r in got} == {("q", 2, "map@1"), ("s", 2, "a"), ("v", 2, "map")}


def relations(spark, **rows):
    shape = {"states": "status string", "candidates": "digest string, content string", "sidecars": "digest string, cache string", "results": "content string", "declared": ""}
    return {n: spark.createDataFrame([("r", *x) for x in rows.get(n, [])], "run_id string, target string" + (", " + t if t else "")) for n, t in shape.items()}


def test_audit(spark):
    x, y = (spark.range(1).select(sha(F.lit(t))).first()[0] for t in "xy")
    whole = {"states": [("a", "completed")], "candidates": [("a", x, "x")], "sidecars": [("a", x, "miss"), ("b", x, "hit"), ("stray", y, "miss")], "results": [("a", "x"), ("b", "x"), ("stray", "x")], "declared": [("a",), ("b",)]}
    assert audit.violations(**relations(spark, **whole)).count() == 0 and audit.violations(**relations(spark)).count() == 0

    def faults(**change):
        return {(r.target, r.violation) for r in audit.violations(**relations(spark, **whole | change)).collect()}

    assert faults(candidates=[]) == {("a", "completed without candidate")}
    assert faults(candidates=[("a", y, "x")]) == {("a", "candidate digest"), ("a", "sidecar differs from candidate")}
    assert faults(candidates=[("a", x, None)]) == {("a", "candidate digest")}
    assert faults(results=[("a", "y"), ("b", "x")]) == {("a", "result digest")}
    assert faults(results=[("b", "x")]) == {("a", "sidecar without result")}
    assert faults(sidecars=[("b", x, "miss")], results=[("b", "x")]) == {("a", "completed without sidecar"), ("b", "sidecar without state")}
    assert faults(states=[("a", "failed")]) == {("a", "sidecar of no success")}
    assert faults(states=[]) == {("a", "candidate without state"), ("a", "sidecar without state")}
    assert faults(states=[("a", "completed")] * 2) == {("a", "repeated rows")}
    assert faults(results=[*whole["results"], ("c", "x")]) == {("c", "result without sidecar")}


def record():
    files = [{"path": "a.txt", "content_hash": "h", "mime_type": "text/plain", "size_bytes": 3}]
    return {
        "prompt_resolution_schema": 1, "spec": "s", "structure_digest": "d", "base": {"name": "b", "digest": "d"}, "layers": [], "axes": [{"name": "n", "variant": "v"}], "materials": [], "rendered": {"sha256": "x", "bytes": 0},
        "messages": [{"role": "user", "parts": ['quote " \\ \n ü', ""]}], "attachments": files, "response_spec": {"schema_sha256": "x", "format": "json"},
    }


def test_resolution_problems(spark):
    ddl = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in prompts.RECORD.items()) + ">"
    made = spark.createDataFrame([(json.dumps(record()),)], "j string").select(F.from_json("j", ddl).alias("r"))
    plain, called = (prompts.sealed(made, "r", "said", **k).first().said for k in ({}, {"phase": F.lit("repair"), "repair_round": F.lit(2)}))
    known = json.loads(plain)
    # the digest is that of sorted, indented JSON without the paths of files
    bare = record()
    bare["attachments"] = [{k: v for k, v in f.items() if k != "path"} for f in bare["attachments"]]
    import hashlib

    assert known["resolution_digest"] == hashlib.sha256(json.dumps(bare, sort_keys=True, indent=2, ensure_ascii=False).encode()).hexdigest()
    turn = json.loads(called)
    moved = json.loads(plain)
    moved["attachments"][0]["path"] = "b.txt"
    cases = [
        (plain, None), (called, None), (json.dumps(moved), None), (None, "schema"), ("", "schema"), ("[]", "schema"), ("{", "schema"), (json.dumps(known | {"prompt_resolution_schema": True}), "schema"),
        (json.dumps({k: v for k, v in known.items() if k not in ("axes", "base")}), "missing: axes, base"), (json.dumps(known | {"z": 1, "more": None}), "extra: more, z"), (json.dumps(known | {"layers": None, "spec": 3}), "types: layers, spec"),
        (json.dumps(known | {"rendered": {"sha256": "x", "bytes": -1}}), "contents: rendered"), (json.dumps(known | {"axes": [{"name": "n"}]}), "contents: axes"), (json.dumps(known | {"spec": "t"}), "digest"),
        (json.dumps(known | {"phase": "primary"}), "incomplete lineage"), (json.dumps(turn | {"phase": "primary"}), "lineage of another round"), (json.dumps(turn | {"repair_round": 0}), "lineage of another round"),
        (json.dumps(turn | {"phase": "later"}), "lineage of another round"), (json.dumps(turn | {"base_resolution_digest": "x"}), "lineage of another record"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, said string")
    assert {r.i: r.problem for r in prompts.problems(df, "said").collect()} == {i: p for i, (_, p) in enumerate(cases)}


def test_limits(spark):
    messages = spark.createDataFrame([(1, "x" * 9), (2, "ü" * 4), (None, None)], "request_id int, text string")
    files = spark.createDataFrame([(1, 5), (1, None), (3, 20)], "request_id int, size_bytes long")
    got = {(r.request_id, r.check, r.limit, r.actual) for r in prompts.over_limits(messages, files, prompts.Limits(2, 1, 10)).collect()}
    assert got == {(1, "token_count", 2, 3), (1, "attachment_count", 1, 2), (3, "byte_size", 10, 20)}
    with pytest.raises(ValueError):
        prompts.Limits(tokens=-1)


def test_failure_facts(spark):
    cases = [
        (None, {"retry-after": " 1.5 "}, 1500), (None, {"Retry-After-Ms": "1e3"}, 1000), (0, {"retry-after": "9"}, 0), (-1, {"retry-after": "9"}, 9000), (None, {"retry-after": "nan"}, None), (None, {"retry-after": "inf"}, None),
        (None, {"retry-after": ""}, None), (None, {"retry-after": None}, None), (None, None, None), (None, {"retry-after-ms": "-7"}, 0), (None, {"retry-after-ms": "1e300"}, None),
    ]
    df = spark.createDataFrame([(i, a, h) for i, (a, h, _) in enumerate(cases)], "i int, asked long, headers map<string,string>")
    assert {r.i: r.ms for r in df.select("i", failures.retry_after_ms(F.col("asked"), F.col("headers")).alias("ms")).collect()} == {i: w for i, (*_, w) in enumerate(cases)}
    kinds = [(429, None, None, "rate_limit"), (599, "timeout", None, "server_error"), (404, None, "timeout", "invalid_request"), (600, "FORBIDDEN", None, "authorization"), (None, "timeout", "connection", "connection"), (None, None, None, "unknown"), (200, "odd", "odd", "unknown")]
    df = spark.createDataFrame([(i, *k[:3]) for i, k in enumerate(kinds)], "i int, status int, code string, raised string")
    assert {r.i: r.k for r in df.select("i", failures.kind(F.col("status"), F.col("code"), F.col("raised")).alias("k")).collect()} == {i: k[3] for i, k in enumerate(kinds)}
