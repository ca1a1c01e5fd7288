"""Paths into nested values, and redaction by structure, against plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowledger.functions import paths
from flowledger.functions.redact import CONTENT_KEYS, redact_json, shape_of
from flowledger.operators import graph, run
from flowledger.sources.store import Store


def test_paths_are_parsed():
    assert paths.parse("a.b[0].c[-1]") == ("a", "b", 0, "c", -1) == paths.parse(("a", "b", 0, "c", -1)) and paths.shown(("a", "b", 0, "c", -1)) == "a.b[0].c[-1]"
    for bad in ("", "a..b", "a[x]", ".a", "a[0]b", (), ("a", True), ("",)):
        with pytest.raises(ValueError):
            paths.parse(bad)


def test_values_of_json_variant_and_typed_columns(spark):
    said = {"a": {"b": [1, 2, {"c": [10, 20]}], "it's": "x", "n": None}}
    df = spark.createDataFrame([(json.dumps(said), [{"k": 1}, {"k": 2}], {"m": [1, 2]})], "j string, s array<struct<k:int>>, m map<string,array<int>>").withColumn("v", F.parse_json("j"))
    for column in "jv":
        at = lambda path, kind, column=column, **o: df.select(paths.column_at(df, (column, *paths.parse(path)), kind, **o)).first()[0]
        assert at("a.b[0]", "int") == 1 and at("a.b[-1].c[-2]", "int") == 10 and at(("a", "it's"), "string") == "x" and at("a.n", "string") is None
        assert at("a.x", "int", strict=False) is None and at("a.b[7]", "int", strict=False) is None
        for path, why in (("a.x.y", "'a.x.y' broke at 'x': key is missing"), ("a.b.c", "a.b is not a mapping"), ("a.b[3]", "a.b has 3 items"), ("a.b[-4]", "a.b has 3 items"), ("a[0]", "a is not a list")):
            with pytest.raises(Exception, match=r"path ") as error:
                at(path, "int")
            assert why.replace("'a.x.y'", f"'{column}.a.x.y'").replace("a.b", f"{column}.a.b", 1).replace("a is", f"{column}.a is", 1).split(" broke at ")[-1] in str(error.value)
    one = lambda path, **o: df.select(paths.column_at(df, path, **o)).first()[0]
    assert one("s[-1].k") == 2 and one("m.m[0]") == 1 and one("m.x", strict=False) is None
    for path in ("m.x", "s[2].k"):
        with pytest.raises(Exception, match="missing"):
            one(path)
    for path in ("z.a", "s.k", "s[0].z", "m[0]"):
        with pytest.raises(ValueError, match="broke at"):
            one(path)
    assert [tuple(r) for r in paths.items_at(df, "v.a.b[2].c", "int", keep=["m"]).select("pos", "item").collect()] == [(0, 10), (1, 20)]


def test_a_consumer_by_paths_doesnt_see_other_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def build(k, other):
        p = graph.Pipeline()
        rows = spark.createDataFrame([(1, json.dumps({"k": [k], "other": other}))], "id long, j string")
        p.node("rows", cache="off")(lambda _: rows)
        p.node("seen", ["rows"], consumes={"rows": {"id": "id", "k": "j.k[0]"}})(lambda got: got["rows"].select("id", F.col("k").cast("int").alias("k")))
        return p

    assert [run.execute(build(*x), store).cache_hits["seen"] for x in ((1, "a"), (1, "b"), (2, "b"))] == [False, True, False]


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2)


def expected(value):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k.lower().replace("-", "_") in CONTENT_KEYS:
                held = canonical(v).encode()
                out[k] = {"redacted": True, "sha256": hashlib.sha256(held).hexdigest(), "bytes": len(held)}
            else:
                out[k] = expected(v)
        return out
    return [expected(v) for v in value] if isinstance(value, list) else value


VALUES = [
    {"role": "user", "content": "né \"x\"\n", "n": 1, "deep": [{"Reasoning-Content": {"a": [1, None]}, "k": True}, {}], "none": None},
    {"input": [], "deep": [], "list": [[1], []], "o": {}},
    {"role": "a\tb", "deep": [{"k": False, "text": None}], "n": 2},
]


def test_json_is_redacted_by_structure(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(7, "{broken"), (8, None), (9, "")], "id int, j string")
    got = {r.id: r.out for r in redact_json(df, "j", "out").collect()}
    for i, v in enumerate(VALUES):
        assert got[i] == canonical(expected(v))
    whole = lambda s, **m: canonical({"redacted": True, "sha256": hashlib.sha256(s.encode()).hexdigest(), "bytes": len(s.encode()), **m})
    assert got[7] == whole("{broken", media_type="application/json") and got[8] is None and got[9] == whole("", media_type="application/json")
    assert "PythonUDF" not in redact_json(df, "j", "out")._jdf.queryExecution().toString()
    upper = {r.id: json.loads(r.out) for r in redact_json(df.where("id = 0"), "j", "out", strings=F.upper).collect()}
    assert upper[0]["role"] == "USER" and upper[0]["content"] == json.loads(got[0])["content"]


def test_json_lines_and_mixed_shapes(spark):
    said = "\n".join([json.dumps(VALUES[0]), "no json", json.dumps(VALUES[2])]) + "\n"
    df = spark.createDataFrame([(1, said), (2, ""), (3, None)], "id int, j string")
    got = {r.id: r.out for r in redact_json(df, "j", "out", lines=True).collect()}
    raw = canonical({"redacted": True, "sha256": hashlib.sha256(b"no json").hexdigest(), "bytes": 7})
    assert got == {1: "\n".join([canonical(expected(VALUES[0])), raw, canonical(expected(VALUES[2]))]) + "\n", 2: "", 3: None}
    mixed = spark.createDataFrame([(1, '{"a": {"text": "secret"}}'), (2, '{"a": 5}'), (3, '[1]'), (4, '"s"')], "id int, j string")
    shown = {r.id: r.out for r in redact_json(mixed, "j", "out").collect()}
    assert shown == {i: canonical(expected(json.loads(j))) for i, j in ((r.id, r.j) for r in mixed.collect())} and "secret" not in shown[1]
    deep = '[1, {"text": [1]}, ["a", {"input": 2, "k": {"x": [{}, 3, {"prompt": "p"}]}}], null]'
    assert redact_json(spark.createDataFrame([(deep,)], "j string"), "j", "out").first().out == canonical(expected(json.loads(deep)))
    assert shape_of("OBJECT<a: ARRAY<OBJECT<b: BIGINT>>, `c d`: DECIMAL(3,1)>") == ("object", {"a": ("array", ("object", {"b": ("value", "BIGINT")})), "c d": ("value", "DECIMAL(3,1)")})
