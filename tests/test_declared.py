"""Declared prompts: what is refused before a row is read, what is wrong with single rows, and whose record a text is."""

import hashlib

import pytest
from pyspark.sql import functions as F

from flowledger.operators import declared, prompts
from flowledger.operators.declared import Catalog, Choice, DeclarationError, Material, Prompt

TEXTS = {"base": "{{task}}: {{tone}}\n{{doc}}{{task}}", "task": "Sum", "brief": "short", "long": "long"}
TONE = Choice("tone", "item.tone", {"b": "brief", "l": "long"})
SUM = Prompt("sum", "base", {"task": "task", "tone": TONE}, {"doc": Material("item.doc")})


def rows(spark, *items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], "id long, item struct<tone: string, doc: string>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(
    "made",
    [
        lambda: Prompt("Sum", "base"), lambda: Prompt("sum", "/base"), lambda: Prompt("sum", "a/../b"), lambda: Prompt("sum", "base.md"), lambda: Prompt("sum", "base", {"Slot": "task"}),
        lambda: Prompt("sum", "base", {"doc": "task"}, {"doc": Material("x")}), lambda: Prompt("sum", "base", {"a": TONE, "b": TONE}), lambda: Choice("tone", "x", {}), lambda: Choice("tone", "x", {"": "a"}),
        lambda: Choice("tone", "x", {"a": "b\\c"}), lambda: Material("x", title=" "), lambda: Prompt("sum", ""),
    ],
)
def test_wrong_declarations_are_refused(made):
    with pytest.raises(DeclarationError):
        made()
    with pytest.raises(ValueError):
        Material("a..b")


def test_kinds_of_steps():
    carry = Prompt("next", "base", {}, {"doc": Material("carry.doc")})
    declared.check([SUM], ["item"], "map")
    declared.check([SUM, carry], ["item", "carry"], "scan")
    for specs, columns, kind in (([SUM], ["item"], "node"), ([carry], ["carry"], "map"), ([SUM, SUM], ["item"], "map"), ([SUM], ["id"], "map")):
        with pytest.raises(DeclarationError):
            declared.check(specs, columns, kind)
    assert SUM.paths() == ["item.tone", "item.doc"] and SUM.refs() == ["base", "task", "brief", "long"]


def test_catalogs_are_checked(spark, tmp_path):
    Catalog(TEXTS).check(SUM)
    for wrong in ({"base": "{{task}}{{tone}}"}, {"base": TEXTS["base"] + "{{more}}"}, {"brief": "{{task}}"}):
        with pytest.raises(DeclarationError):
            Catalog(TEXTS | wrong).check(SUM)
    with pytest.raises(DeclarationError, match="no such"):
        Catalog({"base": "x"}).check(SUM)
    with pytest.raises(DeclarationError, match="bytes"):
        Catalog({"base": "x" * (declared.MOST_BYTES + 1)})
    table = spark.createDataFrame([*TEXTS.items(), ("other", None), ("base", TEXTS["base"])], "name string, text string")
    assert Catalog.of(table, [SUM]).texts == TEXTS  # rows that repeat are one text, and others aren't read
    for more in ([("base", "another")], [("task", None)]):
        with pytest.raises(DeclarationError):
            Catalog.of(table.unionByName(spark.createDataFrame(more, table.schema)), [SUM])
    with pytest.raises(DeclarationError, match="long"):
        Catalog.of(table.where("name <> 'long'"), [SUM])
    for name, body in TEXTS.items():
        (tmp_path / f"{name}.md").write_text(body)
    assert Catalog.read(spark, str(tmp_path), [SUM]).texts == TEXTS
    (tmp_path / "task.md").write_bytes(b"\xff")
    with pytest.raises(DeclarationError):
        Catalog.read(spark, str(tmp_path), [SUM])


def test_rows_are_resolved_or_say_why(spark):
    df = rows(spark, ("b", "one"), ("l", "a ``` b {{task}}"), ("x", "one"), (None, "one"), ("b", None), None, ("b", ""), ("b", "one")).withColumn("prompt", F.lit("clash"))
    made = declared.resolve(df, SUM, Catalog(TEXTS))
    got = {r.id: r for r in made.collect()}
    assert made.columns == ["id", "item", "prompt", "prompt_record", "prompt_problem"] and len(got) == 8
    assert got[0].prompt == "Sum: short\n```\none\n```\nSum" == got[7].prompt
    assert got[1].prompt == "Sum: long\n````\na ``` b {{task}}\n````\nSum" and got[6].prompt == "Sum: short\n```\n\n```\nSum"
    assert [got[i].prompt_problem for i in range(8)] == [None, None, "choice tone: unknown variant x", "choice tone: no text", "material doc: no value", "choice tone: no text", None, None]
    assert all(r.prompt is None and r.prompt_record is None for r in got.values() if r.prompt_problem)
    record = got[0].prompt_record
    assert record.rendered.sha256 == sha(got[0].prompt) and [x.name for x in record.layers] == ["task", "brief"] and [tuple(x) for x in record.axes] == [("tone", "b")]
    stored = prompts.problems(prompts.sealed(made.where("prompt IS NOT NULL"), "prompt_record", "said", phase=F.lit("primary"), repair_round=F.lit(0)), "said")
    assert [r.problem for r in stored.collect()] == [None] * 4
    assert declared.resolve(df.limit(0), SUM, Catalog(TEXTS)).count() == 0


def test_only_what_was_chosen_is_in_the_record(spark):
    df = rows(spark, ("b", "one"), ("l", "one"))
    digests = lambda texts: [r[0] for r in declared.resolve(df, SUM, Catalog(texts)).orderBy("id").select(declared.resolution_digest()).collect()]
    old, new = digests(TEXTS), digests(TEXTS | {"long": "longer"})
    assert old[0] == new[0] and old[1] != new[1]
    assert Catalog(TEXTS).declaration(SUM) != Catalog(TEXTS | {"long": "longer"}).declaration(SUM)  # a run that goes on sees it
    moved = Prompt("sum", "base", {"task": "task", "tone": Choice("tone", "item.tone", {"l": "long", "b": "brief"})}, {"doc": Material("item.doc")})
    assert moved.structure_digest == SUM.structure_digest != Prompt("sum", "base", dict(SUM.layers), {"doc": Material("item.doc", title="T")}).structure_digest


def test_nested_values_and_files(spark):
    p = Prompt("p", "base", {}, {"a": Material("facts", title="Facts"), "b": Material("said.file", file=True)})
    df = spark.sql("SELECT id, named_struct('n', id, 'l', array('x')) AS facts, parse_json(CASE id WHEN 3 THEN '{\"file\": 7}' WHEN 4 THEN '{}' ELSE concat('{\"file\": \"f', id, '.JSON\"}') END) AS said FROM range(6)")
    files = spark.createDataFrame([("f0.JSON", b"{}"), ("f0.JSON", b"{}"), ("f1.JSON", b"\xc3("), ("f5.JSON", None)], "path string, content binary")
    got = {r.id: r for r in declared.resolve(df, p, Catalog({"base": "{{a}}{{b}}"}), files=files).collect()}
    assert len(got) == 6 and got[0].prompt == '## Facts\n\n```json\n{\n  "l": [\n    "x"\n  ],\n  "n": 0\n}\n```\n```\n{}\n```\n'
    assert tuple(got[0].prompt_record.attachments[0]) == ("f0.JSON", sha("{}"), "application/json", 2)
    assert [got[i].prompt_problem for i in range(1, 6)] == ["material b: not UTF-8: f1.JSON", "material b: no file f2.JSON", "material b: no path", "material b: no path", "material b: no file f5.JSON"]
    with pytest.raises(DeclarationError, match="no files"):
        declared.resolve(df, p, Catalog({"base": "{{a}}{{b}}"}))


def test_a_changed_text_has_no_record(spark):
    made = declared.resolve(rows(spark, ("b", "one"), ("b", "two"), ("x", "two")), SUM, Catalog(TEXTS))
    kept = declared.with_lineage(made.withColumn("prompt", F.when(F.col("id") == 1, F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt"))))
    assert {r.id: r.prompt_record is not None for r in kept.collect()} == {0: True, 1: False, 2: False}
