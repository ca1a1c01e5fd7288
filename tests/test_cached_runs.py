"""Cached runs: what makes a result stale, items with any number of rows, failures, files, scans, collection."""

import json
import os
import time
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from flowledger.functions import identity
from flowledger.functions.identity import fingerprint
from flowledger.operators import dynamic, graph, run, scans
from flowledger.operators.attempts import RetryPolicy
from flowledger.sources.files import UndeclaredInputError
from flowledger.sources.store import Store


def items_of(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(items, log=None):
    p = graph.Pipeline()
    p.node("items", cache="off")(lambda _: items)

    @p.map("words", items_from="items")
    def split(got):
        return got["items"].select("id", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))

    return p


def test_items_with_several_rows_or_none(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = items_of(spark, [(1, "a b a"), (2, "c"), (3, "")])
    want = [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
    for hits in (0, 3):
        done = run.execute(words(first), store)
        assert rows_of(done.artifacts["words"]) == want and done.map_items["words"] == (3, hits)
    done = run.execute(words(items_of(spark, [(1, "a b a"), (2, "c d"), (3, "")])), store, force=["words@1"])
    assert rows_of(done.artifacts["words"]) == [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "d")] and done.map_items["words"] == (3, 1)
    assert run.execute(words(items_of(spark, [])), store).artifacts["words"].count() == 0


def test_stored_rows_are_verified(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    items = items_of(spark, [(1, "a b"), (2, "c")])
    run.execute(words(items), store)
    name = next(n for n in os.listdir(tmp_path) if n.startswith("rows-"))
    part = os.path.join(tmp_path, name, os.listdir(tmp_path / name)[0])
    rows = spark.read.parquet(part)
    rows.withColumn("word", F.lit("x")).write.partitionBy("__bucket").parquet(str(tmp_path / "other"))
    os.rename(part, tmp_path / "old")
    os.rename(tmp_path / "other", part)
    with pytest.raises(ValueError, match="don't match"):
        run.execute(words(items), store)


def test_a_source_is_never_stale(spark, tmp_path):
    store, place = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")

    def pipeline():
        p = graph.Pipeline()
        p.node("rows")(lambda _: spark.read.parquet(place))
        p.node("n", ["rows"])(lambda got: got["rows"].agg(F.count("*").alias("n")))
        return p

    for n, hit in ((3, False), (5, False), (5, True), (3, True)):
        spark.range(n).coalesce(1).write.mode("overwrite").parquet(place)
        done = run.execute(pipeline(), store)
        assert done.artifacts["n"].first().n == n and done.cache_hits == {"rows": hit, "n": hit}


def test_code_values_and_templates_are_in_the_key(spark, tmp_path):
    def adder(k, mark="x"):
        def add(got):
            return got["rows"].withColumn("k", F.lit(k)).withColumn("m", F.lit(mark))

        return add

    helper = lambda k: lambda got: got["rows"].withColumn("k", F.lit([k][0]))
    assert fingerprint(adder(1)) != fingerprint(adder(2)) and fingerprint(adder(1, "y")) != fingerprint(adder(1)) and fingerprint(adder([1, {"a": 2}])) == fingerprint(adder([1, {"a": 2}]))
    assert fingerprint(helper((1, [2]))) != fingerprint(helper((1, [3])))
    assert fingerprint(lambda got: got) != fingerprint(lambda got: got["a"])
    with pytest.raises(ValueError, match="no digest"):
        fingerprint(adder(iter([1])))
    table = spark.range(3)
    assert fingerprint(lambda got: got["a"].join(table, "id")) != fingerprint(lambda got, t=spark.range(4): got["a"].join(t, "id"))
    store, rows = Store(spark, str(tmp_path)), spark.range(2)

    def build(items, k):
        p = graph.Pipeline()
        p.node("rows")(lambda _: rows)
        p.foreach("each_{name}", items, ["rows"])(lambda got, name, v: got["rows"].withColumn("v", F.lit(v)))
        t = graph.Template(["rows"], ["out"])
        t.node("out", ["rows"])(lambda got: got["rows"].withColumn("k", F.lit(k)))
        p.mount(t, "m", {"rows": "rows"})
        return p

    run.execute(build([{"name": "a", "v": 1}, {"name": "b", "v": 2}], 1), store)
    done = run.execute(build([{"name": "a", "v": 1}, {"name": "b", "v": 3}], 2), store)
    assert done.cache_hits == {"rows": True, "each_a": True, "each_b": False, "m.out": False}
    assert done.artifacts["each_b"].first().v == 3 and done.artifacts["m.out"].first().k == 2


def test_a_changed_result_type_and_parameters(spark, tmp_path):
    store, items = Store(spark, str(tmp_path)), items_of(spark, [(1, "5"), (2, "6")])

    def build(kind, times):
        p = graph.Pipeline()
        p.node("items", cache="off")(lambda _: items)
        p.map("v", items_from="items", params={"times": times})(lambda got: got["items"].select("id", (F.col("text").cast(kind) * got.params["times"]).cast(kind).alias("v")))
        return p

    for kind, times, hits, want in (("int", 2, 0, [(1, 10), (2, 12)]), ("double", 2, 0, [(1, 10.0), (2, 12.0)]), ("int", 2, 2, [(1, 10), (2, 12)]), ("int", 3, 0, [(1, 15), (2, 18)])):
        done = run.execute(build(kind, times), store)
        assert rows_of(done.artifacts["v"]) == want and done.map_items["v"] == (2, hits)


def failing(items, retries=0, keep=False):
    p = graph.Pipeline()
    p.node("items", cache="off")(lambda _: items)

    def one(item):
        if item["text"] == "bad":
            raise ValueError("broken")
        return [{"n": len(item["text"])}]

    p.map("m", items_from="items", errors="error", retries=retries, keep_errors=keep)(lambda got: dynamic.per_item(got["items"], "id", one, "n long"))
    return p


def test_failed_items_leave_the_others_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    bad, good = items_of(spark, [(1, "aa"), (2, "bad"), (3, "b")]), items_of(spark, [(1, "aa"), (2, "ok!"), (3, "b")])
    with pytest.raises(run.MapItemsError, match=r"2 \(ValueError: broken\)"):
        run.execute(failing(bad), store)
    kept = run.execute(failing(bad, retries=2, keep=True), store)
    assert rows_of(kept.artifacts["m"]) == [(1, 2), (3, 1)] and kept.map_items["m"] == (3, 2)
    assert [(r.id, r.error, r.attempts) for r in kept.item_errors["m"].collect()] == [("2", "ValueError: broken", 3)]
    done = run.execute(failing(good), store)
    assert rows_of(done.artifacts["m"]) == [(1, 2), (2, 3), (3, 1)] and done.map_items["m"] == (3, 2)
    told = {(r.run_id, r.node): r for r in run.profile(store).collect()}
    assert told["run-0002", "m"].failed == 1 and told["run-0003", "m"]["items"] == 3 and told["run-0003", "m"].hits == 2 and told["run-0001", "m"].cache is None


def test_retries_of_a_step_and_steps_side_by_side(spark, tmp_path):
    store, tries, busy, most = Store(spark, str(tmp_path)), [], [], []
    p = graph.Pipeline()
    p.node("src", cache="off")(lambda _: spark.range(3))

    def flaky(got):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return got["src"]

    p.node("flaky", ["src"], retries=2, version="1")(_Step(flaky))
    for k in range(3):
        def slow(got, k=k):
            busy.append(k)
            most.append(len(busy))
            time.sleep(0.3)
            busy.remove(k)
            return got["src"].withColumn("k", F.lit(k))

        p.node(f"slow{k}", ["src"], uses=["one"], version="1")(_Step(slow, k))
    done = run.execute(p, store, workers=4, limits={"one": 1})
    assert done.status == "completed" and len(tries) == 3 and max(most) == 1
    assert next(r for r in store.notes("sidecars") if r["node"] == "flaky")["attempts"] == 3
    most.clear()
    run.execute(p, store, force=["slow0", "slow1", "slow2"], workers=4)
    assert max(most) > 1
    with pytest.raises(TimeoutError):
        run.execute(p, store, force=["slow0", "slow1", "slow2"], workers=4, limits={"one": 1}, patience=0.05)


class Busy(Exception):
    def __init__(self, status=429, wait=None):
        self.status_code, self.retry_after_ms = status, wait


def test_policies_wait_and_choose(spark, tmp_path, monkeypatch):
    store, slept, raised = Store(spark, str(tmp_path)), [], []
    monkeypatch.setattr(run, "sleep", slept.append)
    policy = RetryPolicy(max_attempts=3, initial_delay=10, max_delay=15, jitter="none")

    def run_of(*errors, retries=policy):
        left = list(errors)

        def flaky(got):
            if left:
                raise left.pop(0)
            return got["src"]

        p = graph.Pipeline()
        p.node("src", cache="off")(lambda _: spark.range(3))
        p.node("flaky", ["src"], retries=retries, version=str(len(raised)))(_Step(flaky))
        raised.append(1)
        slept.clear()
        return run.execute(p, store)

    assert run_of(Busy(503), TimeoutError()).status == "completed" and slept == [10, 15]
    assert run_of(Busy(429, 20_000)).status == "completed" and slept == [20]
    for errors in ([Busy(401)], [ValueError("timeout")], [ConnectionError()] * 3):
        with pytest.raises(type(errors[0])):
            run_of(*errors)
    assert slept == [10, 15]  # the last: three attempts, two delays
    run_of(ValueError("x"), retries=1)
    assert slept == []  # a number of retries has neither kinds nor delays
    kept = run.execute(failing(items_of(spark, [(1, "bad"), (2, "b")]), retries=policy, keep=True), store)
    assert slept == [10, 15] and [(r.id, r.attempts) for r in kept.item_errors["m"].collect()] == [("1", 3)]


def test_waits_are_those_of_the_ledger(spark):
    policy = RetryPolicy(max_attempts=9)
    rows = spark.range(1, 6).select("id", policy.delay(F.lit("run-0001"), F.lit("a"), F.col("id"), F.lit(identity.digest(asdict(policy))), F.lit(None).cast("long")).alias("delay")).collect()
    assert all(abs(policy.wait("run-0001", "a", r.id, Busy()) - r.delay) < 1e-9 for r in rows)
    assert policy.wait("r", "a", 9, Busy()) is None and policy.wait("r", "a", 1, Busy(404)) is None and policy.wait("r", "a", 1, None) is not None


class _Step:
    """A function whose digest is its name: what it does in a test has no value to digest."""

    def __init__(self, fn, k=0):
        self.fn, self.k = fn, k

    @property
    def __dict__(self):
        return {"k": self.k}

    def __call__(self, got):
        return self.fn(got)


def sites(spark, root, contents):
    for name, text in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    items = items_of(spark, [(1, ["d/a.txt"]), (2, ["d/b.txt", "d/c.txt"]), (3, [])], "id long, paths array<string>")
    p = graph.Pipeline()
    p.node("items", cache="off")(lambda _: items)
    p.map("read", items_from="items", files=["d/*.txt"], files_fn=_paths)(lambda got: got["items"].select("id", F.array_join(F.transform("files", lambda f: f["content"].cast("string")), "|").alias("said")))
    p.node("prompt", files=["prompt.md"], params={"n": 1})(lambda got: spark.range(1).select(F.lit(got.read_text("prompt.md")).alias("prompt")))
    return p


def _paths(items):
    return items["paths"]


def test_files_of_steps_and_items(spark, tmp_path):
    store, root = Store(spark, str(tmp_path / "s")), tmp_path / "in"
    done = run.execute(sites(spark, root, {"d/a.txt": "A", "d/b.txt": "B", "d/c.txt": "C", "prompt.md": "Say."}), store, root=str(root))
    assert rows_of(done.artifacts["read"]) == [(1, "A"), (2, "B|C"), (3, "")] and done.artifacts["prompt"].first().prompt == "Say."
    done = run.execute(sites(spark, root, {"d/c.txt": "CC"}), store, root=str(root))
    assert rows_of(done.artifacts["read"]) == [(1, "A"), (2, "B|CC"), (3, "")] and done.map_items["read"] == (3, 2) and done.cache_hits["prompt"]
    done = run.execute(sites(spark, root, {"prompt.md": "Sing."}), store, root=str(root))
    assert done.map_items["read"] == (3, 3) and not done.cache_hits["prompt"] and done.artifacts["prompt"].first().prompt == "Sing."
    assert store.read_blobs().count() == 6  # A, B, C, CC and two prompts, each once
    with pytest.raises(ValueError, match="root"):
        run.execute(sites(spark, root, {}), store)
    p = sites(spark, root, {})
    p.node("other", files=["prompt.md"])(lambda got: spark.range(1).select(F.lit(got.read_text("d/a.txt"))))
    with pytest.raises(UndeclaredInputError):
        run.execute(p, store, ["other"], root=str(root))
    p.node("none")(lambda got: got.files)
    with pytest.raises(UndeclaredInputError):
        run.execute(p, store, ["none"], root=str(root))
    p.node("gone", files=["x/*.md"])(lambda got: got.files)
    with pytest.raises(FileNotFoundError):
        run.execute(p, store, ["gone"], root=str(root))
    p.map("bad", items_from="items", files=["d/a.txt"], files_fn=_paths)(lambda got: got["items"].select("id"))
    with pytest.raises(Exception, match="undeclared file: d/b.txt"):
        run.execute(p, store, ["bad"], root=str(root))


def talk(items, start=0, add=0):
    p = graph.Pipeline()
    p.node("items", cache="off")(lambda _: items)

    @p.scan("sum", items_from="items", chain="c", by=["at"], start={"total": start}, out="before long, total long")
    def total(carry, item):
        now = carry["total"] + (item["v"] or 0) + add
        return {"total": now}, {"before": carry["total"], "total": now}

    return p


def test_scans_go_on_from_the_first_change(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "c string, at long, v long"

    def check(rows, hits, **options):
        done = run.execute(talk(items_of(spark, rows, schema), **options), store)
        want, carry = [], {}
        for c, at, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            before = carry.get(c, options.get("start", 0))
            carry[c] = before + (v or 0) + options.get("add", 0)
            want.append((c, at, before, carry[c]))
        assert rows_of(done.artifacts["sum"]) == sorted(want, key=repr) and done.map_items["sum"] == (len(rows), hits)

    rows = [(c, i, 10 * i) for c in ("a", "b", None) for i in range(6)]
    check(rows, 0)
    check(rows, 18)
    edited = [(c, i, 99 if (c, i) == ("a", 3) else v) for c, i, v in rows]
    check(edited, 15)
    check([r for r in edited if r[:2] != ("b", 2)], 14)  # 17 rows; what follows the missing one in b is new: 3, 4, 5
    check([r for r in edited if r[:2] != ("b", 2)] + [("b", 6, 1), ("d", 0, 1)], 17)
    swapped = [(c, i, 98 if (c, i) == ("a", 3) else 41 if (c, i) == ("a", 4) else v) for c, i, v in edited]
    check(rows, 18 - 3 - 4)  # a from 3 on and b from 2 on are computed anew: only the last version is compared
    check(swapped, 15)
    check([(c, i, v) for c, i, v in swapped if not (c == "a" and i == 5)] + [("a", 5, 50)], 18)
    check(rows, 0, start=5)
    check(rows, 0, add=1)
    check([], 0)
    for bad in ([("a", 1, 1), ("a", 1, 2)], [("a", None, 1)]):
        with pytest.raises(ValueError, match="unique"):
            run.execute(talk(items_of(spark, bad, schema)), store)


def test_an_edit_that_does_not_change_the_carry_ends_the_suffix(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("a", i, i) for i in range(6)]

    def build(rows):
        p = graph.Pipeline()
        items = items_of(spark, rows, "c string, at long, v long")
        p.node("items", cache="off")(lambda _: items)
        p.scan("odd", items_from="items", chain="c", by=["at"], start=0, out="odd long")(lambda carry, item: ((carry + item["v"]) % 2, {"odd": carry}))
        return p

    run.execute(build(rows), store)
    done = run.execute(build([(c, i, v + 10 * (i == 1)) for c, i, v in rows]), store)
    assert done.map_items["odd"] == (6, 5)


def test_long_chains_stream(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("c"), "id")
    got = scans.fold(rows, "c", ["id"], 0, lambda carry, row: ((carry * 31 + row["id"]) % 1_000_003, {"h": carry}), "h long").agg(F.sum("h")).first()[0]
    carry = total = 0
    for i in range(300_000):
        total += carry
        carry = (carry * 31 + i) % 1_000_003
    assert got == total


def test_aggregates_have_a_key_of_their_own(spark, tmp_path):
    store, items = Store(spark, str(tmp_path)), items_of(spark, [(1, "a b"), (2, "c")])

    def build(most):
        p = graph.Pipeline()
        p.node("items", cache="off")(lambda _: items)
        p.map("n", items_from="items", aggregate=lambda rows: rows.agg(F.least(F.sum("n"), F.lit(most)).alias("n")))(lambda got: got["items"].select("id", F.size(F.split("text", " ")).alias("n")))
        return p

    assert run.execute(build(10), store).artifacts["n"].first().n == 3
    done = run.execute(build(2), store)
    assert done.artifacts["n"].first().n == 2 and done.map_items["n"] == (2, 2) and not done.cache_hits["n"]
    assert run.execute(build(2), store).cache_hits["n"] and run.plan(build(2), store, read_sources=True) == {"items": "miss", "n": "hit"}


def test_collection_deletes_and_readers_end(spark, tmp_path):
    now = [1000.0]
    store, root = Store(spark, str(tmp_path / "s"), clock=lambda: now[0]), tmp_path / "in"
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "s") for f in fs)
    versions = [[(k, f"text {k} {v if k % 5 == 0 else 0}") for k in range(40)] for v in range(3)]
    results = [run.execute(words(items_of(spark, rows)), store) for rows in versions]
    for v in range(2):
        run.execute(sites(spark, root, {"d/a.txt": f"A{v}", "d/b.txt": "B", "d/c.txt": "C", "prompt.md": "Say."}), store, root=str(root))
    reader, before = results[0].artifacts["words"], size()
    old = rows_of(reader)
    went = run.gc(store, keep=3, grace=60)
    assert went["keys"] == 16 and went["blobs"] == 0 and went["deleted"] == 0 and went["results"] == 0
    assert rows_of(reader) == old and size() >= before
    now[0] += 100
    there = lambda: {p for d in os.listdir(tmp_path / "s") if d.startswith("rows-") for p in os.listdir(tmp_path / "s" / d)}
    parts = there()
    assert run.gc(store, keep=3, grace=60)["deleted"] > 0 and len(there()) < len(parts)
    again = run.execute(words(items_of(spark, versions[2])), store)
    assert again.map_items["words"] == (40, 40) and rows_of(again.artifacts["words"]) == rows_of(run.opened(store, next(r for r in store.notes("sidecars", ["run-0003"]) if r["node"] == "words")["place"]))
    assert run.execute(words(items_of(spark, versions[0])), store).map_items["words"] == (40, 32)
    went = run.gc(store, keep=1, grace=0)
    assert went["blobs"] == 5 and store.read_blobs().count() == 0 and went["results"] > 0
    assert Store(spark, store.root).runs() == [f"run-{k:04d}" for k in range(1, 8)] and len([n for n in os.listdir(tmp_path / "s/_log") if n.endswith(".json")]) <= 2
    with pytest.raises(ValueError):
        run.gc(store, keep=0)


def test_resume_opens_maps_and_scans(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    p = words(items_of(spark, [(1, "a b")]))
    log = []

    def boom(got):
        log.append(1)
        raise RuntimeError("boom")

    p.node("end", ["words"], version="1")(_Step(boom))
    failed = run.execute(p, store, keep_going=True)
    again = run.execute(p, store, resume=failed.run_id, keep_going=True)
    assert failed.failed == again.failed and rows_of(again.artifacts["words"]) == [(1, "a"), (1, "b")] and json.loads(store.notes("sidecars")[-1]["place"] or "{}") == {}
