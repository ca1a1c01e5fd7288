import hashlib

import pytest
from pyspark.sql import functions as F

from flowledger.functions.canon import sha
from flowledger.guard import findings
from flowledger.operators import attempts
from flowledger.sources.responders import cassette, scripted
from flowledger.sources.store import Store
from flowledger.streaming.live import SCHEMA, live_map


def test_store_appends_and_counts_commits_only(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.next_run_id() == "run-0001" and s.read("t", "a int").count() == 0
    s.append("t", spark.createDataFrame([(1,)], "a int"), "run-0001")
    spark.createDataFrame([(9,)], "a int").write.parquet(f"{tmp_path}/t/unfinished")
    s.append("t", spark.createDataFrame([(2,)], "a int"), "run-0009")
    assert sorted((r.a, r.run_id) for r in s.read("t", "a int").collect()) == [(1, "run-0001"), (2, "run-0009")]
    assert s.read("t", "a int", ["run-0001"]).count() == 1 and s.next_run_id() == "run-0010"


def test_blobs_are_kept_once_and_checked(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for run in ("run-0001", "run-0002"):
        ref = s.put_blobs(spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy")], "id int, content string"), run).collect()
    assert {(r.id, r.bytes) for r in ref} == {(1, 1), (2, 1), (3, 2)} and s.read_blobs().count() == 2
    s.append("blobs", spark.createDataFrame([("bad", bytearray(b"z"))], "sha256 string, content binary"), "run-0003")
    with pytest.raises(Exception, match="corrupt blob"):
        s.read_blobs().collect()


def test_live_map_computes_each_key_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    for i, rows in enumerate(([("a",), ("b",)], [("b",), ("c",)])):
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        items = spark.readStream.schema("text string").parquet(f"{tmp_path}/in/*")
        q = live_map(items, s, "memo", sha(F.col("text")), F.upper("text"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert q.exception() is None
    assert sorted(r.artifact for r in s.read("memo", SCHEMA).collect()) == ["A", "B", "C"]


def test_responders(spark):
    rows = spark.createDataFrame([(0, "k", "x\nmark"), (1, "l", "other")], "seq int, key string, text string")
    assert {r.key: r.response for r in scripted(rows, [("mark", "1"), ("other", "2")]).collect()} == {"k": "1", "l": "2"}
    with pytest.raises(Exception, match="no route"):
        scripted(rows, [("mark", "1")]).collect()
    tape = spark.createDataFrame([(0, hashlib.sha256(b"x\nmark").hexdigest(), "r"), (1, "changed", "r")], "seq int, request_sha string, response string")
    assert cassette(rows.where("seq = 0"), tape).first().response == "r"
    with pytest.raises(Exception, match="recorded"):
        cassette(rows, tape).collect()


def test_receipts_show_a_changed_state(spark):
    states = spark.createDataFrame([("t", i, f"s{i}") for i in range(4)], "target string, at int, state string")
    chain = attempts.receipts(states, "target", ["at"], "state")
    assert attempts.broken_receipts(chain, "target", "state").count() == 0
    forged = chain.withColumn("state", F.when(F.col("at") == 1, "forged").otherwise(F.col("state")))
    assert [r["at"] for r in attempts.broken_receipts(forged, "target", "state").collect()] == [2]


def test_policy_and_recovery(spark):
    p = attempts.RetryPolicy(max_attempts=2)
    rows = spark.createDataFrame([(False, "x", False, 1), (True, "timeout", True, 1), (True, "timeout", False, 1), (True, "timeout", False, 2), (True, "authentication", False, 1), (True, None, False, 1)], "f boolean, k string, e boolean, a int")
    got = [r.s for r in rows.select(p.next_status(F.col("f"), F.col("k"), F.col("e"), F.col("a")).alias("s")).collect()]
    assert got == ["success_candidate", "ambiguous", "retry_scheduled", "failed", "failed", "failed"]
    delay = spark.range(1).select(p.delay(F.lit("r"), F.lit("t"), F.lit(1), F.lit("d"), F.lit(20_000)).alias("d")).first().d
    assert delay == 20.0
    with pytest.raises(ValueError):
        attempts.RetryPolicy(max_attempts=0)
    nodes, edges = spark.createDataFrame([(x,) for x in "abcd"], "name string"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert sorted(r.name for r in attempts.inherited(nodes, edges, nodes.where("name = 'b'")).collect()) == ["a", "d"]


def test_guard():
    bad = "for x in y:\n    df.collect()\nopen('f')\nfor x in y:\n    df.collect()  # guard: ok five regions\n"
    assert [f.split(": ")[0] for f in findings(bad, "m")] == ["m:2", "m:3"]
