"""Cached runs of a pipeline over a store: keys, lookup, write-back, force, resume, skips, checkpoints and sidecar rows.

A node's result is stored whole under the digest of its function, version, parameters, files and inputs. A map's results are stored item by item,
any number of rows for each, so that only items without a stored result are computed; items that fail are kept apart and the others' results
stored. A scan's results are stored step by step: each chain goes on from the carry before its first changed item. Digests of tables
don't depend on the order of rows. A source (a step without dependencies) is keyed by its rows, so a changed source is never taken from the store; one
that isn't stored is read where it is needed and not copied.

Policies: `auto` looks up and writes, `refresh` only writes, `off` does neither.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from time import sleep

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import sha
from ..functions.frames import content_digest
from ..functions.identity import digest, fingerprint, run_identity
from ..sources.files import Inputs, capture, contents, declared, with_files
from ..sources.keyed import BUCKET, KEY, Keyed, bucket
from ..sources.store import Store
from . import scans
from .attempts import RetryPolicy
from .dynamic import check_items, with_keys
from .graph import Pipeline, RunResult, Step, viewed

ENTRIES = "key string, step string, place string, digest string"
SIDECARS = "node string, cache_key string, cache string, cache_policy string, outputs array<string>, seconds double, artifact_sha256 string, place string, run_identity string, run_sidecar_schema int, created_at double, attempts int"
APPROVALS = "node string, artifact_sha256 string"
FAILURES = "node string, id string, key string, error string, attempts int"


class MapItemsError(RuntimeError):
    """Some items of a map failed; the others' results are stored."""


def declarations(pipeline: Pipeline, order: Iterable[str]) -> dict[str, dict]:
    return {
        n: {"fn": fingerprint(s.fn), "deps": s.deps, "kind": s.kind, "cache": s.cache, "version": s.version, "consumes": {d: fingerprint(c) if callable(c) else c for d, c in s.consumes.items()}, "files": s.files, "params": dict(s.params)}
        for n in order for s in [pipeline.steps[n]]
    }


def _selected(pipeline: Pipeline, order: list[str], force: Iterable[str]) -> tuple[set[str], dict[str, list[str]]]:
    """Forced steps, and forced items of maps; a selector is `step` or `step@item`."""
    steps, items = set(), {}
    for selector in force:
        name, at, item = selector.partition("@")
        if name not in order or (at and pipeline.steps[name].kind != "map"):
            raise ValueError(f"unknown selector {selector!r}")
        if at:
            items.setdefault(name, []).append(item)
        else:
            steps.add(name)
    return steps, items


class _Run:
    def __init__(self, pipeline: Pipeline, store: Store, libs: str, reusable: bool, force: tuple[set[str], dict[str, list[str]]], run_id: str, snapshot: DataFrame | None = None) -> None:
        self.pipeline, self.store, self.libs, self.reusable, self.run_id, self.snapshot = pipeline, store, libs, reusable, run_id, snapshot
        self.forced, self.forced_items = force
        self.digests: dict[tuple, str] = {}
        self.hits: dict[str, bool] = {}
        self.items: dict[str, tuple[int, int]] = {}
        self.item_errors: dict[str, DataFrame] = {}
        self.views: dict[int, DataFrame] = {}  # tables that aren't known by their step and columns

    # keys

    def digest_of(self, name: str, df: DataFrame) -> str:
        at = (name, *df.columns)
        if id(df) in self.views:
            at = (name, id(df))
        if at not in self.digests:
            self.digests[at] = content_digest(df)
        return self.digests[at]

    def seen(self, step: Step, made: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """A step's dependencies as it sees them."""
        got = {d: viewed(step, d, made[d]) for d in step.deps}
        self.views |= {id(df): df for d, df in got.items() if d in step.consumes and not isinstance(step.consumes[d], tuple)}
        return got

    def declared(self, step: Step) -> DataFrame | None:
        return declared(self.snapshot, step.files) if step.files and self.snapshot is not None else None

    def inputs(self, step: Step, got: Mapping[str, DataFrame]) -> Inputs:
        return Inputs(got, params=step.params, store=self.store, snapshot=self.declared(step))

    def source(self, step: Step) -> str:
        """What computes a step: its function, parameters and, unless its items choose among them, its files."""
        files = self.declared(step)
        read = content_digest(files.select("path", "sha256")) if files is not None and not step.files_fn else ""
        more = [fingerprint(f) for f in (step.files_fn,) if f]
        return digest([step.name, fingerprint(step.fn), step.version, self.libs, dict(step.params), read, more])

    def node_key(self, step: Step, source: str, got: Mapping[str, DataFrame], made: DataFrame | None) -> str:
        if made is not None:
            return digest([source, content_digest(made)])
        return digest([source, {d: self.digest_of(d, df) for d, df in got.items()}])

    # steps

    def build(self, step: Step, got: dict[str, DataFrame]) -> tuple[DataFrame, dict]:
        policy = step.cache if self.reusable else "off"
        source, attempts = self.source(step), 1
        if step.kind == "map" and policy != "off":
            df, key, place, hit, sha = self._map(step, got, source, policy)
            if step.aggregate:
                one = Step(step.name, lambda _, df=df: step.aggregate(df))
                df, place, hit, sha, attempts = self._node(one, {}, digest([step.name, "aggregate", fingerprint(step.aggregate), sha]), policy, None)
        elif step.kind == "scan" and step.chain and policy != "off":
            df, key, place, hit, sha = self._scan(step, got, source, policy)
        elif step.kind == "scan" and step.chain:
            df = scans.fold(got[step.items_from], step.chain, list(step.by), step.start, step.fn, step.out)
            key, place, hit, sha = digest([source, self.digest_of(step.items_from, got[step.items_from])]), "", False, content_digest(df)
        else:
            made = step.fn(self.inputs(step, got)) if not step.deps else None
            key = self.node_key(step, source, got, made)
            if made is not None and policy == "off":
                df, place, hit, sha = made, "", False, content_digest(made)
            else:
                df, place, hit, sha, attempts = self._node(step, got, key, policy, made)
        self.hits[step.name] = hit
        self.digests[(step.name, *df.columns)] = sha
        return df, {"node": step.name, "cache_key": key, "cache": "hit" if hit else "miss", "cache_policy": policy, "outputs": sorted(df.columns), "artifact_sha256": sha, "place": place, "attempts": attempts}

    def _held(self, name: str, key: str) -> dict | None:
        return next((r for r in reversed(self.store.notes("entries")) if r["key"] == key and r["step"] == name), None)

    def _node(self, step: Step, got: dict[str, DataFrame], key: str, policy: str, made: DataFrame | None) -> tuple[DataFrame, str, bool, str, int]:
        spark = self.store.spark
        held = self._held(step.name, key) if policy == "auto" and step.name not in self.forced else None
        if held:
            df = spark.read.parquet(held["place"])
            if content_digest(df) != held["digest"]:
                raise ValueError(f"the stored result of {step.name!r} doesn't match its digest")
            return df, held["place"], True, held["digest"], 0
        attempt = 0
        while True:
            attempt += 1
            place = f"{self.store.root}/results/{uuid.uuid4().hex}"
            try:
                df = made if made is not None else step.fn(self.inputs(step, got))
                df.write.parquet(place)
                break
            except Exception as error:
                if not self._again(step, attempt, error):
                    raise
        df = spark.read.schema(df.schema).parquet(place)
        sha = content_digest(df)
        if policy != "off":
            self.store.note("entries", [{"key": key, "step": step.name, "place": place, "digest": sha}], self.run_id)
        return df, place, False, sha, attempt

    def _again(self, step: Step, attempt: int, error: Exception | None) -> bool:
        """Whether a step is tried again after a failed attempt; if it is, when its policy's delay is over. It keeps its permits meanwhile."""
        if not isinstance(step.retries, RetryPolicy):
            return attempt <= step.retries
        delay = step.retries.wait(self.run_id, step.name, attempt, error)
        if delay is not None:
            sleep(delay)
        return delay is not None

    def keyed(self, step: Step, got: dict[str, DataFrame], source: str) -> tuple[DataFrame, DataFrame, str, Keyed]:
        """(items with their files, (id, key) of each, digest of what they share, where results are)."""
        items = check_items(got[step.items_from], step.item)
        if step.files_fn:
            items = with_files(items, step.item, step.files_fn(items), self.declared(step))
        shared = digest({d: self.digest_of(d, df) for d, df in got.items() if d != step.items_from})
        keys = with_keys(items, source, step.item, shared=F.lit(shared), name=KEY).select(F.col(step.item).alias("__id"), KEY)
        schema = self._called(step, got, items.limit(0)).schema
        for name in filter(None, (step.item, step.errors)):
            if name not in schema.fieldNames():
                raise ValueError(f"the map {step.name!r} must return the column {name!r}")
        columns = [(f.name, f.dataType.simpleString()) for f in schema if f.name != step.errors]
        return items, keys, shared, Keyed(self.store, _table(step, [columns, keys.schema["__id"].dataType.simpleString()]), columns)

    def _called(self, step: Step, got: dict[str, DataFrame], items: DataFrame) -> DataFrame:
        given = contents(self.store, items, step.item) if step.files_fn else items
        return step.fn(self.inputs(step, {**got, step.items_from: given}))

    def _map(self, step: Step, got: dict[str, DataFrame], source: str, policy: str) -> tuple[DataFrame, str, str, bool, str]:
        items, keys, shared, table = self.keyed(step, got, source)
        index, kind = f"index-{table.name}", keys.schema["__id"].dataType.simpleString()
        part = self.store.write(index, keys)
        keys = self.store.load(index, f"`__id` {kind}, `{KEY}` string", [part]).drop("part")
        forced = self.forced_items.get(step.name, [])
        if forced:
            there = {r[0] for r in keys.where(F.col("__id").cast("string").isin(forced)).select(F.col("__id").cast("string")).collect()}
            if unknown := sorted(set(forced) - there):
                raise ValueError(f"unknown items of {step.name!r}: {unknown}")
        again = F.lit(policy == "refresh" or step.name in self.forced)
        again = again | F.col("__id").cast("string").isin(forced) if forced else again
        stored = table.manifest().select(KEY, BUCKET, F.lit(True).alias("__has"))
        looked = keys.withColumn(BUCKET, bucket()).join(stored, [KEY, BUCKET], "left").withColumn("__miss", again | F.col("__has").isNull())
        n, missed = looked.agg(F.count(F.lit(1)), F.count_if("__miss")).first()
        parts, todo, bad, attempt, scratch = [(index, part)], looked.where("__miss").select("__id", KEY), None, 0, []
        while missed and (attempt == 0 or self._again(step, attempt, None)):
            attempt += 1
            mine = items.join(todo.select(F.col("__id").alias("__todo")), F.col(step.item) == F.col("__todo"), "left_semi")
            made = self._called(step, got, mine).join(todo, F.col(step.item) == F.col("__id"))
            if step.errors:
                place = f"{self.store.root}/results/{uuid.uuid4().hex}"
                scratch.append(f"results/{place.rpartition('/')[2]}")
                made.write.parquet(place)
                made = self.store.spark.read.schema(made.schema).parquet(place)
                bad = made.where(F.col(step.errors).isNotNull()).groupBy("__id", KEY).agg(F.min(F.col(step.errors).cast("string")).alias("error"))
                fine = todo.join(bad.select(KEY), KEY, "left_anti")
                made = made.join(bad.select(KEY), KEY, "left_anti").drop(step.errors)
            else:
                fine = todo
            parts += table.tables(table.put(made, fine))
            if bad is None or bad.isEmpty():
                bad = None
                break
            todo = bad.select("__id", KEY)
        if bad is not None:
            failed = bad.select(F.lit(step.name).alias("node"), F.col("__id").cast("string").alias("id"), F.col(KEY).alias("key"), "error", F.lit(attempt).alias("attempts"))
            wrong = self.store.write("failures", failed)
            parts.append(("failures", wrong))
        self.store.commit(self.run_id, parts, {"keyed": [_described(table, kind)]}, scratch)
        self.items[step.name] = (n, n - missed)
        if bad is not None:
            self.item_errors[step.name] = failed = self.store.load("failures", FAILURES, [wrong]).drop("part")
            if not step.keep_errors:
                some = failed.orderBy("id").limit(10).collect()
                raise MapItemsError(f"{failed.count()} items of {step.name!r} failed: " + ", ".join(f"{r.id} ({r.error})" for r in some))
        listed = _listed(table, keys)
        if missed < n:
            table.check(listed)
        place = json.dumps(_described(table, kind) | {"index": part})
        return table.rows(listed).drop(KEY), digest([source, shared, self.digest_of(step.items_from, items)]), place, bool(n and not missed), table.digest(listed)

    def _scan(self, step: Step, got: dict[str, DataFrame], source: str, policy: str) -> tuple[DataFrame, str, str, bool, str]:
        """Chains go on from the carry before their first new, changed or missing item; the others are taken as they are stored."""
        items, at, store = got[step.items_from], [step.chain, *step.by], self.store
        source = digest([source, {d: self.digest_of(d, df) for d, df in got.items() if d != step.items_from}])
        twice = items.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR " + " OR ".join(f"`{c}` IS NULL" for c in step.by)).limit(5).collect()
        if twice:
            raise ValueError(f"places of {step.name!r} must be unique in their chain and not null: " + ", ".join(str(tuple(r)[:-1]) for r in twice))
        keep = [(c, items.schema[c].dataType.simpleString()) for c in at]
        columns = keep + [("__carry", "string")] + [(f.name, f.dataType.simpleString()) for f in scans.StructType.fromDDL(step.out)]
        table = Keyed(store, _table(step, [columns]), columns)
        index, ddl = f"index-{table.name}", ", ".join(f"`{c}` {t}" for c, t in keep) + f", item_sha string, carry_sha string, `{KEY}` string"
        last = store.parts(index)[-1:] if policy == "auto" and step.name not in self.forced else []
        held = store.load(index, ddl, [p for p, _ in last]).drop("part")
        body = F.to_json(F.struct(*sorted(items.columns)), {"ignoreNullFields": "false"})
        marked = items.withColumn("item_sha", sha(F.concat_ws("\x1f", F.lit(source), F.lit(scans.carried(step.start)), body)))
        firsts = scans.suffixes(marked, held, step.chain, list(step.by))
        here, on = F.struct(*step.by), F.col(step.chain).eqNullSafe(F.col("__c"))
        firsts = firsts.withColumnRenamed(step.chain, "__c")
        stored = table.rows(_listed(table, held)) if last else None
        carries = held.join(stored.select(KEY, F.col("__carry").alias("__held_carry")), KEY) if last else held.withColumn("__held_carry", F.lit(None).cast("string"))
        changed = marked.join(firsts, on).where(here >= F.col("__first")).drop("__c", "__first").withColumnRenamed("item_sha", "__item_sha").withColumns({"__kind": F.lit(1), "__carry": F.lit(None).cast("string")})
        before = carries.join(firsts, on).where(here < F.col("__first")).groupBy(step.chain).agg(F.max_by("__held_carry", here).alias("__carry")).withColumn("__kind", F.lit(0))
        memo = carries.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(at)), F.col("item_sha").alias("__held_sha"), "__held_carry", F.col("carry_sha").alias("__held_in"))
        changed = changed.join(memo, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(at)], "left").drop(*(f"__{i}" for i in range(len(at))))
        rows = changed.unionByName(before, allowMissingColumns=True)
        streamed = scans.resumed(rows, step.chain, list(step.by), source, step.start, step.fn, step.out)
        place = f"{store.root}/results/{uuid.uuid4().hex}"
        streamed.write.parquet(place)
        streamed = store.spark.read.schema(streamed.schema).parquet(place)
        computed = streamed.where("NOT hit").withColumnRenamed("carry", "__carry")
        new = table.put(computed, computed)
        kept = held.join(firsts, on, "left").where(F.col("__first").isNull() | (here < F.col("__first"))).select(*held.columns)
        part = store.write(index, kept.unionByName(streamed.select(*held.columns)))
        store.commit(self.run_id, [*table.tables(new), (index, part)], {"keyed": [_described(table, "")]}, [f"results/{place.rpartition('/')[2]}"])
        keys = store.load(index, ddl, [part]).select(KEY)
        listed = _listed(table, keys)
        table.check(listed)
        n, missed = keys.count(), computed.count()
        self.items[step.name] = (n, n - missed)
        df = table.rows(listed).drop(KEY, "__carry")
        place = json.dumps(_described(table, "") | {"index": part, "drop": ["__carry"]})
        return df, digest([source, self.digest_of(step.items_from, items)]), place, bool(n and not missed), content_digest(df)


def _table(step: Step, what) -> str:
    """The name of a step's results: those of other columns or types are apart."""
    return f"{digest(step.name)[:12]}-{digest(what)[:12]}"


def _described(table: Keyed, kind: str) -> dict:
    return {"table": table.name, "columns": [list(c) for c in table.columns], "id": kind}


def _listed(table: Keyed, keys: DataFrame) -> DataFrame:
    """The manifest rows of the keys."""
    return keys.select(KEY).withColumn(BUCKET, bucket()).join(table.manifest(), [KEY, BUCKET])


def opened(store: Store, place: str) -> DataFrame:
    """A step's stored result: a folder, or the keys of one run's items with the rows that are stored for them."""
    if not place.startswith("{"):
        return store.spark.read.parquet(place)
    held = json.loads(place)
    table = Keyed(store, held["table"], [tuple(c) for c in held["columns"]])
    keys = store.load(f"index-{table.name}", f"`{KEY}` string", [held["index"]]).select(KEY)
    return table.rows(_listed(table, keys)).drop(KEY, *held.get("drop", []))


class _Permits:
    """So many of each limited resource at a time; names are taken in one order, so that no two steps wait for each other."""

    def __init__(self, limits: Mapping[str, int], patience: float | None) -> None:
        self.held, self.patience = {n: threading.BoundedSemaphore(k) for n, k in limits.items()}, patience

    def run(self, uses: Iterable[str], what: Callable):
        names, got = sorted(set(uses) & set(self.held)), []
        try:
            for name in names:
                if not self.held[name].acquire(timeout=self.patience):
                    raise TimeoutError(f"no {name!r} became free in {self.patience} seconds")
                got.append(name)
            return what()
        finally:
            for name in got:
                self.held[name].release()


def execute(
    pipeline: Pipeline, store: Store, targets: Iterable[str] | None = None, *, force: Iterable[str] = (), resume: str | None = None, libs: str = "", reusable: bool = True,
    keep_going: bool = False, post_node: Callable[[str, DataFrame, bool], None] | None = None, root: str | None = None, workers: int = 1,
    limits: Mapping[str, int] | None = None, patience: float | None = None,
) -> RunResult:
    """Build the targets with the store's results. force: `step` or `step@item` is computed anew. resume: steps that the named run
    finished, if it was the same run, are taken as they are. A step that asks for approval holds back what needs it until `approve` was
    called for its artifact. After a failure, what needs the failed step is skipped; then the first failure is raised, or with keep_going
    listed in the result. post_node(name, artifact, hit) is called for each built step, not for resumed ones.

    root: the folder of the declared files, which are read once before any step. workers: steps that don't need each other run side by side on so many
    threads; limits: how many steps at a time may use a resource, and patience, how many seconds one waits for it."""
    order = pipeline.order(targets)
    selected = _selected(pipeline, order, list(force))
    identity = run_identity(declarations(pipeline, order), targets or order, force, libs)
    run_id = resume or store.next_run_id()
    patterns = sorted({f for n in order for f in pipeline.steps[n].files})
    if patterns and root is None:
        raise ValueError("a run of steps with files needs the files' root")
    snapshot = capture(store, root, patterns, run_id) if patterns else None
    run = _Run(pipeline, store, libs, reusable, selected, run_id, snapshot)
    earlier = {}
    if resume:
        rows = store.notes("sidecars", [resume])
        if rows and rows[0]["run_identity"] != identity:
            raise ValueError(f"{resume} was another run: its declarations, targets or forced steps differ")
        earlier = {r["node"]: r for r in rows if r["place"]}
    approved = {(r["node"], r["artifact_sha256"]) for r in store.notes("approvals")}
    made: dict[str, DataFrame] = {}
    failed: dict[str, BaseException] = {}
    skipped, pending = [], []
    permits = _Permits(limits or {}, patience)

    def build(step: Step) -> tuple[DataFrame, dict | None]:
        if step.name in earlier:
            df = opened(store, earlier[step.name]["place"])
            run.hits[step.name] = earlier[step.name]["cache"] == "hit"
            run.digests[(step.name, *df.columns)] = earlier[step.name]["artifact_sha256"]
            return df, None
        got = run.seen(step, made)
        began = time.time()
        df, row = permits.run(step.uses, lambda: run.build(step, got))
        return df, row | {"seconds": time.time() - began, "run_identity": identity, "run_sidecar_schema": 1, "created_at": time.time()}

    def finish(name: str, job: Future) -> None:
        try:
            made[name], row = job.result()
            artifact = row["artifact_sha256"] if row else earlier[name]["artifact_sha256"]
            if row:
                counts = [{"node": name, "items": run.items[name][0], "hits": run.items[name][1]}] if name in run.items else []
                store.commit(run_id, rows={"sidecars": [row], "counts": counts})
                if post_node:
                    post_node(name, made[name], run.hits[name])
            if pipeline.steps[name].approve and (name, artifact) not in approved:
                pending.append(name)
        except Exception as e:  # noqa: BLE001 - kept, and raised below in order
            made.pop(name, None)
            failed[name] = e

    with ThreadPoolExecutor(max(1, workers)) as pool:
        waiting, running = list(order), {}
        while waiting or running:
            for name in list(waiting):
                deps = pipeline.steps[name].deps
                if any(d in failed or d in skipped or d in pending for d in deps):
                    waiting.remove(name)
                    skipped.append(name)
                elif all(d in made for d in deps) and len(running) < max(1, workers):
                    waiting.remove(name)
                    running[pool.submit(build, pipeline.steps[name])] = name
            for job in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                finish(running.pop(job), job)
    skipped.sort(key=order.index)
    if failed and not keep_going:
        first, *rest = sorted(failed, key=order.index)
        for other in rest:
            failed[first].add_note(f"{other} failed too: {failed[other]}")
        raise failed[first]
    status = "failed" if failed else "checkpoint_pending" if pending else "completed"
    return RunResult(made, tuple(order), tuple(skipped), status, run.hits, run.items, tuple(pending), {n: str(e) for n, e in failed.items()}, run_id, identity, run.item_errors)


def approve(store: Store, result: RunResult, name: str) -> None:
    """Let a later run go on behind a step, as long as its artifact stays the same."""
    found = [r["artifact_sha256"] for r in store.notes("sidecars", [result.run_id]) if r["node"] == name]
    if not found:
        raise ValueError(f"{name!r} has no result in {result.run_id}")
    store.note("approvals", [{"node": name, "artifact_sha256": found[-1]}], result.run_id)


def plan(pipeline: Pipeline, store: Store, targets: Iterable[str] | None = None, *, force: Iterable[str] = (), libs: str = "", root: str | None = None, read_sources: bool = False) -> dict[str, str]:
    """(step -> hit, miss or unknown) without computing a step: unknown where an input isn't known yet.

    Sources are read for their digests where they are stored; with read_sources also those that aren't, which then are misses, but what needs
    them is known."""
    order = pipeline.order(targets)
    patterns = sorted({f for n in order for f in pipeline.steps[n].files})
    snapshot = capture(store, root, patterns, "plan") if patterns and root else None
    run = _Run(pipeline, store, libs, True, _selected(pipeline, order, list(force)), "", snapshot)
    known: dict[str, DataFrame] = {}
    out = {}
    for name in order:
        step = pipeline.steps[name]
        if any(d not in known for d in step.deps) or (step.files and snapshot is None):
            out[name] = "unknown"
            continue
        got = run.seen(step, known)
        out[name] = "miss"
        made = step.fn(run.inputs(step, got)) if not step.deps and (read_sources or step.cache == "auto") else None
        if made is not None and read_sources:
            known[name] = made
        if step.cache != "auto" or name in run.forced or run.forced_items.get(name) or (step.kind == "scan" and step.chain):
            continue
        source = run.source(step)
        if step.kind == "map":
            _, keys, _, table = run.keyed(step, got, source)
            listed = _listed(table, keys)
            if keys.join(listed.select(KEY), KEY, "left_anti").isEmpty():
                out[name], known[name] = "hit", table.rows(listed).drop(KEY)
                if step.aggregate:
                    held = run._held(name, digest([name, "aggregate", fingerprint(step.aggregate), table.digest(listed)]))
                    out[name], known[name] = ("hit", store.spark.read.parquet(held["place"])) if held else ("miss", None)
                    known = {k: v for k, v in known.items() if v is not None}
        else:
            held = run._held(name, run.node_key(step, source, got, made))
            if held:
                out[name], known[name] = "hit", store.spark.read.parquet(held["place"])
    return out


def gc(store: Store, keep: int = 10, *, grace: float = 3600.0) -> dict[str, int]:
    """Keep what the last `keep` runs refer to and take away the rest: results of nodes, rows of items and steps, file lists and the contents that
    only they name. It counts from one commit on; files go once they have been out for `grace` seconds, so readers that
    began before can end. How much went, by kind."""
    if keep < 1:
        raise ValueError("at least one run is kept")
    kept = set(store.runs()[-keep:])
    live = {r["place"] for r in store.notes("sidecars") if r["run_id"] in kept}
    places = sorted({r["place"] for t in ("entries", "sidecars") for r in store.notes(t) if r["place"] and not r["place"].startswith("{")} - live)
    adds, removes, went = [], places, {"results": len(places), "keys": 0, "blobs": 0}
    tables = {r["table"]: r for r in store.notes("keyed")}
    for name, held in sorted(tables.items()):
        index, table = f"index-{name}", Keyed(store, name, [tuple(c) for c in held["columns"]])
        parts = store.parts(index)
        alive = [p for p, run in parts if run in kept]
        new, old, keys = table.sweep(store.load(index, f"`{KEY}` string", alive).select(KEY))
        adds, removes = adds + new, removes + old + [f"{index}/part={p}" for p, _ in parts if p not in alive]
        went["keys"] += keys
    files = store.parts("files")
    dead = [p for p, run in files if run not in kept]
    if dead:
        names = lambda parts: store.load("files", "sha256 string", parts).select("sha256").distinct()
        gone = names(dead).join(names([p for p, run in files if run in kept]), "sha256", "left_anti")
        blobs = store.load("blobs", "sha256 string, content binary", [p for p, _ in store.parts("blobs")])
        parts = [r.part for r in blobs.join(gone, "sha256", "left_semi").select("part").distinct().collect()]  # a row for each part
        if parts:
            stay = blobs.where(F.col("part").isin(parts)).join(gone, "sha256", "left_anti").select("sha256", "content")
            adds = [*adds, ("blobs", store.write("blobs", stay))]
            removes = removes + [f"blobs/part={p}" for p in parts]
        went["blobs"] = gone.count()
        removes = removes + [f"files/part={p}" for p in dead]
    store.commit("gc", adds, removes=removes)
    store.snapshot()
    went["deleted"] = store.vacuum(grace)
    return went


def profile(store: Store, runs: Iterable[str] | None = None) -> DataFrame:
    """(run_id, node, cache, cache_policy, seconds, attempts, items, hits, failed): what each step of stored runs did, joined from their rows."""
    runs = list(runs) if runs is not None else None
    side = store.read("sidecars", SIDECARS, runs).select("run_id", "node", "cache", "cache_policy", "seconds", "attempts")
    counted = store.read("counts", "node string, items long, hits long", runs)
    failures = store.read("failures", FAILURES, runs).groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("failed"))
    out = side.join(counted, ["run_id", "node"], "left").join(failures, ["run_id", "node"], "full_outer")
    return out.select("run_id", "node", "cache", "cache_policy", "seconds", "attempts", "items", "hits", F.coalesce("failed", F.lit(0)).alias("failed"))


def misses(states: dict[str, str]) -> list[str]:
    """Steps that may have to work."""
    return [n for n, s in states.items() if s != "hit"]


def certain(states: dict[str, str]) -> list[str]:
    """Steps that have to work."""
    return [n for n, s in states.items() if s == "miss"]


def at_risk(states: dict[str, str]) -> list[str]:
    """Steps whose work depends on what is computed before them."""
    return [n for n, s in states.items() if s == "unknown"]


def trace(sidecars: DataFrame, calls: DataFrame, payloads: DataFrame, node: str | None = None) -> DataFrame:
    """A row for each call of each sidecar row (node, ...): calls (node, seq, call_key) with payloads (key, response), and a warning where a call
    has no key or its payload is missing. node filters to a step and its items (`step@item`)."""
    rows = sidecars.join(calls, "node", "left").join(payloads.select(F.col("key").alias("call_key"), "response"), "call_key", "left")
    if node is not None:
        rows = rows.where((F.col("node") == node) | F.col("node").startswith(node + "@"))
    warning = F.when(F.col("seq").isNull(), F.lit(None).cast("string")).when(F.col("call_key").isNull(), "call without key").when(F.col("response").isNull(), F.concat(F.lit("payload missing for "), "call_key"))
    return rows.withColumn("warning", warning)
