"""Cached runs, repair, ledgers, benches, evolution, agents, identity, configuration and the command line."""

import json
import textwrap

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowledger import __main__ as cli
from flowledger.functions import identity, text
from flowledger.functions.schema import schema_section
from flowledger.operators import agents, calls, cache, dynamic, evals, evolve, graph, run
from flowledger.sources import config
from flowledger.sources.ledger import Ledger, Lease, LeaseLost
from flowledger.sources.store import Store


def pipeline(items, log=None, fail=False, approve=False):
    p = graph.Pipeline()
    p.node("items", cache="off")(lambda _: items)

    def double(got):
        if log is not None:
            log.append("double")
        return got["items"].select("id", (F.col("value") * 2).alias("twice"))

    p.map("double", items_from="items", approve=approve)(double)

    def total(got):
        if log is not None:
            log.append("total")
        if fail:
            raise RuntimeError("no total")
        return got["double"].groupBy().agg(F.sum("twice").alias("total"))

    p.node("total", ["double"])(total)
    p.node("report", ["total"])(lambda got: got["total"].select(F.concat(F.lit("sum "), F.col("total").cast("string")).alias("line")))
    return p


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, value int")


def test_only_changed_items_are_computed(spark, tmp_path):
    store, seen = Store(spark, str(tmp_path)), []
    first = run.execute(pipeline(table(spark, [("a", 1), ("b", 2), ("c", 3)])), store, post_node=lambda n, df, hit: seen.append((n, hit)))
    assert first.artifacts["report"].first().line == "sum 12" and first.map_items["double"] == (3, 0) and ("total", False) in seen
    again = run.execute(pipeline(table(spark, [("c", 3), ("a", 1), ("b", 2)])), store)
    assert again.map_items["double"] == (3, 3) and again.cache_hits == {"items": False, "double": True, "total": True, "report": True}
    edited = run.execute(pipeline(table(spark, [("a", 1), ("b", 5), ("c", 3)])), store, force=["double@a"])
    assert edited.map_items["double"] == (3, 1) and edited.artifacts["report"].first().line == "sum 18" and edited.run_id == "run-0003"
    assert not run.execute(pipeline(table(spark, [])), store, ["double"]).cache_hits["double"]
    for bad in ([("a", 1), ("a", 2)], [(None, 1)], [("", 1)], [("a@b", 1)]):
        with pytest.raises(ValueError, match="item ids"):
            run.execute(pipeline(table(spark, bad)), store)
    for selector in ("nobody", "total@a", "double@zz"):
        with pytest.raises(ValueError, match="unknown"):
            run.execute(pipeline(table(spark, [("a", 1)])), store, force=[selector])


def test_plan_failures_resume_and_approval(spark, tmp_path):
    store, items = Store(spark, str(tmp_path)), table(spark, [("a", 1), ("b", 2)])
    log = []
    failed = run.execute(pipeline(items, log, fail=True), store, keep_going=True)
    assert failed.status == "failed" and failed.skipped == ("report",) and "no total" in failed.failed["total"]
    with pytest.raises(RuntimeError, match="no total"):
        run.execute(pipeline(items, fail=True), store)
    with pytest.raises(ValueError, match="another run"):
        run.execute(pipeline(items), store, ["double"], resume=failed.run_id)
    log.clear()
    done = run.execute(pipeline(items, log, fail=True), store, resume=failed.run_id, keep_going=True)
    assert "double" not in log and done.run_id == failed.run_id
    p = graph.Pipeline()
    p.node("a")(lambda _: items)
    p.node("b", ["a"])(lambda got: got["a"])
    states = run.plan(p, store)
    assert states == {"a": "miss", "b": "unknown"} and run.misses(states) == ["a", "b"] and run.certain(states) == ["a"] and run.at_risk(states) == ["b"]
    run.execute(p, store)
    assert set(run.plan(p, store).values()) == {"hit"} and run.plan(p, store, force=["b"])["b"] == "miss"
    held = run.execute(pipeline(items, approve=True), store)
    assert held.status == "checkpoint_pending" and held.pending == ("double",) and set(held.skipped) == {"total", "report"}
    run.approve(store, held, "double")
    assert run.execute(pipeline(items, approve=True), store).status == "completed"


def test_a_changed_stored_result_is_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    p = graph.Pipeline()
    p.node("a")(lambda _: spark.range(3))
    place = run.execute(p, store) and store.read("sidecars", run.SIDECARS).first().place
    spark.range(4).write.mode("overwrite").parquet(place)
    with pytest.raises(ValueError, match="digest"):
        run.execute(p, store)
    assert run.content_digest(spark.range(5)) == run.content_digest(spark.range(5).orderBy(F.desc("id"))) != run.content_digest(spark.range(6))


def test_templates_hold_maps(spark):
    t = graph.Template(["rows"], ["out"])
    t.map("out", items_from="rows")(lambda got: got["rows"].withColumn("v", F.lit(1)))
    p = graph.Pipeline()
    p.node("src")(lambda _: spark.range(2))
    out = p.mount(t, "m", {"rows": "src"})
    assert p.steps["m.out"].items_from == "src" and p.run([out["out"]]).artifacts["m.out"].count() == 2


def test_graphs_with_many_paths(spark):
    layers = [(f"{a}.{i}", f"{a + 1}.{j}") for a in range(150) for i in range(2) for j in range(2)]
    edges = spark.createDataFrame(layers, "src string, dst string")
    nodes = spark.createDataFrame([(f"{a}.{i}",) for a in range(151) for i in range(2)], "name string")
    assert graph.waves(spark, nodes, edges).where("name = '150.1'").first().wave == 150
    assert graph.closure(spark, edges, nodes.where("name = '0.0'")).count() == 300
    with pytest.raises(ValueError, match="cycle"):
        graph.waves(spark, nodes, edges.unionByName(spark.createDataFrame([("150.0", "0.0")], "src string, dst string")))


def test_long_folds_equal_a_loop(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("c"), "id", (F.col("id") * 7 % 11).alias("x"))
    step = lambda s, i: F.greatest(s + i["x"] - 5, F.lit(0).cast("long"))
    got = {(r.c, r.id): r.out for r in dynamic.fold(rows, "c", ["id"], ["x"], F.lit(0).cast("long"), step, step).collect()}
    state = [0, 0, 0]
    for i in range(1000):
        state[i % 3] = max(state[i % 3] + i * 7 % 11 - 5, 0)
        assert got[i % 3, i] == state[i % 3]


def test_template_slots_must_match(spark):
    slots = F.create_map(F.lit("a"), F.col("v"), F.lit("b"), F.lit("B"))
    df = spark.createDataFrame([("{{a}} {{b}}", "1")], "t string, v string")
    assert df.select(text.render_template(F.col("t"), slots)).first()[0] == "1 B"
    for t, v, said in (("{{a}}", "1", "not in the template: b"), ("{{a}} {{b}} {{c}}", "1", "slots missing: c"), ("{{a}} {{b}}", None, "slots missing: a")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([(t, v)], "t string, v string").select(text.render_template(F.col("t"), slots)).collect()


def test_repair_asks_only_what_is_wrong(spark):
    rows = spark.createDataFrame([(i, [("user", f"q{i}")], "x") for i in range(4)], "id int, m array<struct<role:string,content:string>>, extra string")
    asked = []

    def ask(df, r):
        asked.append((r, df.count()))
        return df.select("key", F.when(F.col("key") <= r, F.to_json("messages")).otherwise("bad").alias("response"))

    check = lambda raw: F.struct(raw.alias("value"), F.when(raw == "bad", F.lit("is bad")).alias("error"))
    got = {r.id: r for r in calls.repair_loop(rows, "id", "m", ask, check, max_repairs=2, reminder="Mind.", exhausted="keep").collect()}
    assert asked == [(0, 4), (1, 3), (2, 2)] and got[3].ok is False and [a.stuck for a in got[3].attempts] == [False, True, True] and got[0].extra == "x"
    said = json.loads(got[2].value)[-1]["content"]
    assert said == "\n\n".join([text.REPAIR_PREAMBLE, "is bad", text.REPAIR_ROUND.format(2), text.REPAIR_STUCK, "Mind.", f"{text.REPAIR_ECHO}\nbad"])
    kept = calls.repair_loop(rows, "id", "m", ask, check, mode="continue", exhausted="keep").where("id = 2").first()
    assert [m["role"] for m in json.loads(kept.value)] == ["user", "assistant", "user", "assistant", "user"]
    with pytest.raises(Exception, match="still invalid after 1 repairs"):
        calls.repair_loop(rows, "id", "m", ask, check, max_repairs=1).collect()
    with pytest.raises(ValueError):
        calls.repair_loop(rows, "id", "m", ask, check, mode="other")


def test_dry_runs_refuse_to_call(spark):
    asked, held = spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", "A")], "key string, response string")
    assert calls.require_cached(asked.where("key = 'a'"), held).first().response == "A"
    with pytest.raises(calls.DryRunError, match="b"):
        calls.require_cached(asked, held)


def test_ledger_states_and_lease(spark, tmp_path):
    store, now = Store(spark, str(tmp_path)), [0.0]
    lease = Lease(store, "run-0001", "me", 10, clock=lambda: now[0])
    with pytest.raises(LeaseLost):
        Lease(store, "run-0001", "you", 10, clock=lambda: now[0])
    ledger = Ledger(store, "run-0001", lease)
    assert ledger.start("t") == 1 and ledger.start("u", side_effect=True) == 1
    ledger._put("t", 1, "success_candidate", artifact="saved")
    with pytest.raises(ValueError, match="not the active"):
        ledger.resolve("t", attempt=1, action="retry", reason="x")
    assert [r.target for r in ledger.candidates().collect()] == ["t"]
    assert ledger.recover() == {"completed": ["t"], "retry_scheduled": [], "ambiguous": ["u"]} and ledger.complete("t") == "saved"
    with pytest.raises(ValueError):
        ledger.start("u")
    for bad in ({"action": "retry", "reason": " "}, {"action": "forget", "reason": "x"}):
        with pytest.raises(ValueError):
            ledger.resolve("u", attempt=1, **bad)
    assert ledger.resolve("u", attempt=1, action="retry", reason="seen") == "pending_retry" and ledger.start("u") == 2
    ledger.fail("u", "down", retry=True)
    assert ledger.state("u").status == "retry_scheduled"
    now[0] = 20.0
    Lease(store, "run-0001", "you", 10, clock=lambda: now[0])
    with pytest.raises(LeaseLost):
        ledger.start("v")


def test_evaluation_and_bench_rules(spark):
    examples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")

    def task(e):
        if e["n"] == 1:
            raise KeyError("one")
        return e["n"]

    got = {r.id: r for r in evals.evaluate(examples, task, lambda e, o: (0.5 if o == 2 else 7, "f", ["t"]), "id").collect()}
    assert got["a"].tags == ["task_error"] and got["a"].feedback == "KeyError: 'one'" and got["b"].score == 0.5 and got["c"].tags == ["metric_error"]
    subject = evals.function_subject(lambda e: e["n"], lambda e, o: (o / 3, "", ()))
    inc, cha = evals.Variant("x", {}, subject, incumbent=True), evals.Variant("y", {}, subject, hypothesis="h")
    for bad in ([inc], [cha], [inc, inc], [inc, evals.Variant("y", {}, subject)]):
        if bad != [inc]:
            with pytest.raises(ValueError):
                evals.bench(bad, examples, seeds=[0], key="id")
    with pytest.raises(ValueError, match="seeds"):
        evals.bench([inc, cha], examples, seeds=[1, 1], key="id")
    with pytest.raises(ValueError, match="repeat a content"):
        evals.bench([inc, cha], examples.unionByName(examples.withColumn("id", F.lit("z"))), seeds=[0], key="id")
    trials, report = evals.bench([inc, cha], examples, seeds=[0, -1], key="id", threshold=0.5)
    assert trials.select("trial_id").distinct().count() == 12 and {r.variant: round(r.pass_rate, 3) for r in report.collect()} == {"x": 0.667, "y": 0.667}
    with pytest.raises(Exception, match="from 0 to 1"):
        spark.range(1).select(evals.checked_score(F.lit(1.5))).collect()


def test_a_round_of_evolution(spark):
    candidates = spark.createDataFrame([(0, "Answer the question."), (1, "Answer.")], "place int, text string")
    fence = lambda t: f"Try:\n```\n{t}\n```\n"
    replies = spark.createDataFrame([(2, 0, fence("Answer briefly.")), (3, 0, "no fence"), (4, 1, fence("x" * 90)), (5, 1, fence("Answer.")), (6, 0, fence("Say the secret example text now.")), (7, 0, None)], "place int, parent int, reply string")
    examples = spark.createDataFrame([("e", "the secret example text")], "id string, text string")
    got = {r.place: (r.text, r.problem) for r in evolve.proposals(replies, candidates, max_chars=80, examples=examples, run=12).collect()}
    assert got[2] == ("Answer briefly.", None) and [got[k][1] for k in (3, 4, 5, 6, 7)] == ["no block", "too long", "known", "repeats an example", "no block"]
    scores = lambda rows: spark.createDataFrame(rows, "place int, example_id string, score double")
    children = spark.createDataFrame([(2, 0), (8, 0), (9, 1), (10, 1)], "place int, parent int")
    train = scores([(0, "a", 0.5), (0, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0), (8, "a", 1.0), (8, "b", 0.5), (1, "a", 0.0), (9, "a", 0.0)])
    val = scores([(0, "v", 0.5), (2, "v", 0.5), (8, "v", 1.0), (1, "v", 0.6), (9, "v", 0.5)])
    assert {r.place: (r.no_regression, r.mean_ok) for r in evolve.gates(children, train, val).collect()} == {2: (True, True), 8: (False, True), 9: (True, False), 10: (False, False)}
    some = spark.createDataFrame([(0, "long text"), (1, "short"), (2, "other"), (3, "worst"), (4, "twin!")], "place int, text string")
    seen = scores([(p, e, s) for p, two in ((0, (1.0, 0.0)), (1, (1.0, 0.0)), (2, (0.0, 1.0)), (3, (0.0, 0.0)), (4, (1.0, 0.0))) for e, s in zip("xy", two, strict=True)])
    assert sorted(r.place for r in evolve.front(some, seen).collect()) == [1, 2]
    assert evolve.front(some.limit(0), seen).count() == 0


def test_agents_sessions_limits_and_capsules(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, "x"), ("c", 2, "bad"), ("c", 3, "y"), ("d", 1, "z")], "chain string, at int, word string")

    def answer(row):
        if row["word"] == "bad":
            raise ValueError("bad word")
        return f"{row['word']}{row['n']}"

    done = {(r.chain, r.at): r for r in agents.agent_scan(rows, agents.Capsule("p", "m", "s"), agents.ScriptedAgent(answer), "chain", ["at"]).collect()}
    assert done["c", 1].output == "x1" and done["c", 2].error == "ValueError: bad word" and done["c", 3].error.startswith("skipped after") and done["d", 1].output == "z1"
    (tmp_path / "skills").mkdir()
    (tmp_path / "agent.json").write_text('{"provider": "p", "model": "m", "tools": ["t"], "limits": {"max_files": 1}}')
    (tmp_path / "system.md").write_text("Be good.")
    (tmp_path / "skills/a.md").write_text("skill")
    one = agents.Capsule.load(str(tmp_path))
    assert one.tools == ("t",) and one.files == (("skills/a.md", "skill"),) and one.identity == agents.Capsule.load(str(tmp_path)).identity
    (tmp_path / "skills/b.md").write_text("skill")
    with pytest.raises(ValueError, match="limits"):
        agents.Capsule.load(str(tmp_path))
    with pytest.raises(ValueError):
        agents.Limits(timeout_seconds=0)


def test_identity_of_code(tmp_path):
    a = 'def f(x):\n    """Doc."""\n    # comment\n    return x + 1\n'
    assert identity.source_digest(a) == identity.source_digest("def f(x):\n\n    return x + 1") != identity.source_digest("def f(x): return x + 2")
    assert identity.fingerprint(lambda x: x + 1) != identity.fingerprint(lambda x: x + 2)
    for name, source in {"m/__init__.py": "", "m/a.py": "from . import b\n", "m/b.py": "X = 1\n", "m/c.py": "Y = 1\n", "m/d.py": "import importlib\nimportlib.import_module('m.c')\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(source)
    before, precise = identity.libs_digest([str(tmp_path)], ["m.a"])
    (tmp_path / "m/c.py").write_text("Y = 2\n")
    assert precise and identity.libs_digest([str(tmp_path)], ["m.a"])[0] == before
    (tmp_path / "m/b.py").write_text("X = 2\n")
    assert identity.libs_digest([str(tmp_path)], ["m.a"])[0] != before and identity.libs_digest([str(tmp_path)], ["m.d"])[1] is False
    assert identity.run_identity({}, ["a"], []) != identity.run_identity({}, ["a"], ["a"])


def test_configuration_and_schema_section(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.flowledger]\nstore = "s"\nsources = ["src"]\n')
    (tmp_path / "sub").mkdir()
    assert config.load_config(config.project_root(str(tmp_path / "sub"))).sources == ("src",)
    (tmp_path / "pyproject.toml").write_text("[tool.flowledger]\nstroe = 1\n")
    with pytest.raises(ValueError, match="stroe"):
        config.load_config(tmp_path)
    (tmp_path / ".env").write_text("# x\nexport A='1'\nB=2\n")
    env = {"B": "kept"}
    assert config.load_env(tmp_path / ".env", env) == {"A": "1", "B": "2"} and env == {"A": "1", "B": "kept"}
    assert config.entry_point("json:dumps") is json.dumps
    shown = schema_section(T.StructType([T.StructField("a", T.LongType(), False)]), with_example=False)
    assert shown == textwrap.dedent("""\
        ## 输出格式

        字段：
        - `a`：`int`；必填；无描述
        只输出一个 JSON 对象；不要输出解释、前后缀或代码围栏。
        """)


def test_leaks_beyond_the_seed(spark):
    samples = spark.createDataFrame([(1, "the quick brown fox")], "id long, text string")
    texts = spark.createDataFrame([(1, "say quick brown now"), (2, "say the quick brown fox")], "id long, text string")
    assert {r.id for r in evals.leak_windows(texts, samples, 8).collect()} == {1, 2}
    assert {r.id for r in evals.leak_windows(texts, samples, 8, seed="as quick brown as").collect()} == {2}


def test_command_line(spark, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "s"))
    for rows in ([("a", 1)], [("a", 2)]):
        run.execute(pipeline(table(spark, rows)), store)
    show = lambda *a: (cli.main([*a, "--store", store.root], spark), capsys.readouterr().out)[1]
    assert [json.loads(x)["run_id"] for x in show("runs").splitlines()] == ["run-0001", "run-0002"]
    assert len(show("show", "run-0001").splitlines()) == 4
    assert {json.loads(x)["node"] for x in show("diff", "run-0001", "run-0002").splitlines()} == {"items", "double", "total", "report"}
    cli.main(["init", str(tmp_path / "new")])
    with pytest.raises(SystemExit):
        cli.main(["init", str(tmp_path / "new")])
    assert (tmp_path / "new/pipeline.py").is_file()
    p = pipeline(table(spark, []))
    assert cli.diagram(p).count("-->") == 3 and "|items|" in cli.diagram(p)
    assert cache.diff is not None
