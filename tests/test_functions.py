import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowledger.functions import canon, text
from flowledger.functions.urls import scrub_url, scrub_urls_in
from flowledger.operators.graph import Pipeline, Template


def one(spark, col, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(col.alias("x")).first().x


def test_canonical_json_equals_python(spark):
    rows = [(1, 'a"\\\n\t\x0b\x1f\\u000B 木😀', None, [1, 2], {"b": "x", "a": None}), (2, "", True, [], {}), (3, None, False, None, None)]
    df = spark.createDataFrame(rows, "id long, s string, f boolean, xs array<int>, m map<string,string>")
    kind = df.schema
    got = [r.x for r in df.select(canon.canonical_json(F.struct(*df.columns), kind).alias("x"), "id").orderBy("id").collect()]
    want = [json.dumps(dict(zip(df.columns, r, strict=True)), ensure_ascii=False, sort_keys=True, indent=2) for r in rows]
    assert got == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00\x7f"), max_size=30), min_size=20, max_size=40))
def test_json_strings_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r.i: (r.j, r.d) for r in df.select("i", canon.json_string(F.col("s")).alias("j"), canon.sha(F.col("s")).alias("d")).collect()}
    assert got == {i: (json.dumps(t, ensure_ascii=False), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def test_floats_have_no_canonical_text():
    from pyspark.sql import types as T

    with pytest.raises(TypeError):
        canon.canonical_json(F.lit(1.0), T.DoubleType())


def test_fence_outgrows_the_material(spark):
    assert one(spark, text.inject(F.col("s")), s="a ```` b") == "`````\na ```` b\n`````\n"


def test_filled_slots_are_not_filled_again(spark):
    slots = F.create_map(F.lit("x"), F.lit("{{y}}"), F.lit("y"), F.lit("z"))
    assert one(spark, text.render_template(F.col("t"), slots), t="{{x}}-{{y}}-{{x}}") == "{{y}}-z-{{y}}"


def test_clip_bounds(spark):
    assert one(spark, text.clip(F.col("s"), 4)["text"], s="abcdefgh") == "abcd\n(已截断：原文 8 字，保留 4 字)"
    assert one(spark, text.clip(F.col("s"), 6)["text"], s="ab\ncd\nefgh") == "ab\ncd\n(已截断：原文 10 字，保留 6 字)"
    with pytest.raises(ValueError):
        text.clip(F.col("s"), -1)


def test_url_secrets(spark):
    shown = lambda u: one(spark, scrub_url(F.col("u")), u=u)
    assert shown("https://a.b/c?x=1&api-key=zz&my_token=q#f") == "https://a.b/c?x=1&api-key=%2A%2A%2A&my_token=%2A%2A%2A#f"
    assert one(spark, scrub_urls_in(F.col("t")), t="go to http://u/p?secret=1&&b 'https://v?q=%zz+~*' no?token=1") == "go to http://u/p?secret=%2A%2A%2A&b= 'https://v?q=%25zz+~%2A' no?token=1"


def test_pipeline_order_and_errors():
    p = Pipeline()
    p.node("a")(lambda i: 1)
    p.node("b", ["a"])(lambda i: i["a"] + 1)
    p.node("unused", ["a"])(lambda i: 1 / 0)
    assert p.order(["b"]) == ["a", "b"] and p.run(["b"]).artifacts["b"] == 2
    with pytest.raises(ZeroDivisionError):
        p.run()
    with pytest.raises(ValueError):
        p.node("a")
    with pytest.raises(ValueError):
        p.node("c", ["a"], consumes={"b": ["x"]})
    p.node("x", ["y"])(lambda i: 0)
    p.node("y", ["x"])(lambda i: 0)
    with pytest.raises(ValueError):
        p.order(["x"])
    with pytest.raises(KeyError):
        p.order(["nothing"])


def test_templates_bind_all_ports_and_freeze():
    t = Template(["rows"], ["out"])
    t.node("out", ["rows"])(lambda i: i["rows"] * 10)
    p = Pipeline()
    p.node("s")(lambda i: 4)
    with pytest.raises(ValueError):
        p.mount(t, "m", {})
    out = p.mount(t, "m", {"rows": "s"})
    assert p.run([out["out"]]).artifacts["m.out"] == 40
    with pytest.raises(ValueError):
        t.node("more")


def test_corrupt_cache_rows_fail(spark):
    from flowledger.operators.cache import incremental

    keyed = spark.createDataFrame([("k", 1)], "key string, v int")
    held = spark.createDataFrame([("k", "a", "not its digest")], "key string, artifact string, artifact_sha256 string")
    with pytest.raises(Exception, match="corrupt"):
        incremental(keyed, held, F.lit("x")).collect()


def test_leak_windows_equal_brute_force(spark):
    import random

    from flowledger.operators.evals import leak_windows

    r = random.Random(8)
    samples = [(i, "".join(r.choices("abc", k=r.randrange(0, 40)))) for i in range(12)] + [(50, None), (51, "aaaaaaaaaaaa")]
    texts = [(i, "".join(r.choices("abc", k=r.randrange(0, 120)))) for i in range(40)] + [(90, None), (91, "xaaaaaaax"), (92, "")]
    a, b = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(samples, "id long, text string")
    for run in (1, 5, 8):
        want = {(i, j) for i, t in texts for j, s in samples if t and s and any(s[k : k + run] in t for k in range(len(s) - run + 1))}
        assert {tuple(x) for x in leak_windows(a, b, run).collect()} == want
