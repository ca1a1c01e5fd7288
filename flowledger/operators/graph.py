"""Declared pipelines of DataFrame steps, and their graph questions (order, waves, closures, forecast)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import projected

MOST_EDGES = 100_000
_NAME = re.compile(r"[^\W@/\\][^@/\\]*")


@dataclass(frozen=True)
class Step:
    name: str
    fn: Callable[..., DataFrame]
    deps: tuple[str, ...] = ()
    kind: str = "node"
    consumes: Mapping = field(default_factory=dict)  # of dependencies: columns, paths by name, or a function of the table
    items_from: str | None = None
    cache: str = "auto"
    item: str = "id"
    version: str = ""
    approve: bool = False
    files: tuple[str, ...] = ()  # declared paths and globs, below the run's root
    files_fn: Callable[[DataFrame], Column] | None = None  # of a map's items: the paths that each one reads
    params: Mapping = field(default_factory=dict)
    retries: object = 0  # of a failed step, or of a map's failed items: a number of them, at once, or a policy of attempts
    errors: str | None = None  # the column of a map's results that tells what is wrong with an item
    keep_errors: bool = False  # go on with the other items' results where some items fail
    uses: tuple[str, ...] = ()  # resources of which the run may have a limited number
    aggregate: Callable[[DataFrame], DataFrame] | None = None
    chain: str | None = None  # of a scan: its items' chain, their order in it, the first carry and the columns of its results
    by: tuple[str, ...] = ()
    start: object = None
    out: str = ""


@dataclass(frozen=True)
class RunResult:
    artifacts: dict[str, DataFrame]
    order: tuple[str, ...]
    skipped: tuple[str, ...] = ()
    status: str = "completed"
    cache_hits: dict[str, bool] = field(default_factory=dict)
    map_items: dict[str, tuple[int, int]] = field(default_factory=dict)  # items and hits of each map
    pending: tuple[str, ...] = ()
    failed: dict[str, str] = field(default_factory=dict)
    run_id: str = ""
    identity: str = ""
    item_errors: dict[str, DataFrame] = field(default_factory=dict)  # (id, key, error, attempts) of maps whose failed items were kept apart


def viewed(step: Step, dep: str, df: DataFrame) -> DataFrame:
    """What a step sees of a dependency: all, some columns, what stands at some paths (by name), or what a function of the table gives."""
    view = step.consumes.get(dep)
    if view is None:
        return df
    try:
        if callable(view):
            made = view(df)
            if not isinstance(made, DataFrame):
                raise TypeError("a projection returns a table")
            return made
        return projected(df, view) if isinstance(view, Mapping) else df.select(*view)
    except Exception as e:
        raise RuntimeError(f"step {step.name!r} can't consume {dep!r}: {type(e).__name__}: {e}") from e


class Template:
    """Steps with input ports, to be mounted under a namespace any number of times."""

    def __init__(self, inputs: Iterable[str], outputs: Iterable[str]) -> None:
        self.inputs, self.outputs, self.steps, self.frozen = tuple(inputs), tuple(outputs), [], False

    def map(self, name: str, *, items_from: str, deps: Iterable[str] = (), **options):
        return self.node(name, (items_from, *deps), kind="map", items_from=items_from, **options)

    def scan(self, name: str, *, items_from: str, deps: Iterable[str] = (), **options):
        return self.node(name, (items_from, *deps), kind="scan", items_from=items_from, **options)

    def node(self, name: str, deps: Iterable[str] = (), **options):
        if self.frozen:
            raise ValueError("a mounted template takes no more steps")

        def register(fn):
            self.steps.append((name, fn, tuple(deps), options))
            return fn

        return register


def _renamed(fn: Callable, names: Mapping[str, str]) -> Callable:
    """fn of a template, which knows its dependencies by the template's names."""

    def call(got, *more):
        mine = {d: got[n] for d, n in names.items()}
        return fn(got.having(mine) if hasattr(got, "having") else mine, *more)

    return call


class Pipeline:
    """Steps by name. A step's function gets a dict of its dependencies' DataFrames; nothing runs before an action."""

    def __init__(self) -> None:
        self.steps: dict[str, Step] = {}

    def node(self, name: str, deps: Iterable[str] = (), *, consumes: Mapping[str, Iterable[str]] | None = None, kind: str = "node", cache: str = "auto", **options):
        """Options are the fields of Step: item names the id column of a map's items; version and params are part of every key; approve holds
        back what needs the step until it is approved; files and files_fn declare what is read."""
        deps = tuple(dict.fromkeys(deps))
        view = {d: dict(c) if isinstance(c, Mapping) else c if callable(c) else tuple(c) for d, c in (consumes or {}).items()}
        if name in self.steps or not _NAME.fullmatch(name):
            raise ValueError(f"step name {name!r} is taken or not allowed")
        if cache not in ("auto", "refresh", "off"):
            raise ValueError(f"unknown cache policy {cache!r}")
        if extra := set(view) - set(deps):
            raise ValueError(f"consumes names steps that aren't dependencies: {sorted(extra)}")
        if unknown := set(options) - {f.name for f in fields(Step)}:
            raise TypeError(f"unknown options of a step: {sorted(unknown)}")
        if kind != "map" and any(options.get(x) for x in ("files_fn", "errors", "aggregate")):
            raise ValueError("files_fn, errors and aggregate are options of a map")
        if options.get("files_fn") and not options.get("files"):
            raise ValueError("files_fn chooses among declared files")
        if options.get("chain") and not (options.get("by") and options.get("out")):
            raise ValueError("a scan over chains needs by and out")
        held = {k: tuple(v) if k in ("files", "by", "uses") else v for k, v in options.items()}

        def register(fn):
            self.steps[name] = Step(name, fn, deps, kind, view, cache=cache, **held)
            return fn

        return register

    def map(self, name: str, *, items_from: str, deps: Iterable[str] = (), **options):
        """A step whose function gets the rows of `items_from` as its first argument, each row an item on its own."""
        return self.node(name, (items_from, *deps), kind="map", items_from=items_from, **options)

    def scan(self, name: str, *, items_from: str, deps: Iterable[str] = (), **options):
        return self.node(name, (items_from, *deps), kind="scan", items_from=items_from, **options)

    def foreach(self, template: str, items: Iterable[Mapping], deps: Iterable[str] = ()):
        """One step for each item; the name is the template formatted with the item and its index."""

        def register(fn):
            for i, item in enumerate(items):
                self.node(template.format(i=i, **item), deps)(lambda inputs, fn=fn, item=item: fn(inputs, **item))
            return fn

        return register

    def mount(self, template: Template, namespace: str, inputs: Mapping[str, str]) -> dict[str, str]:
        if set(inputs) != set(template.inputs):
            raise ValueError(f"ports are {sorted(template.inputs)}, not {sorted(inputs)}")
        template.frozen = True
        named = {n: f"{namespace}.{n}" for n, *_ in template.steps} | dict(inputs)
        for name, fn, deps, options in template.steps:
            held = dict(options)
            if held.get("items_from"):
                held["items_from"] = named[held["items_from"]]
            if held.get("consumes"):
                held["consumes"] = {named[d]: c for d, c in held["consumes"].items()}
            if held.get("chain"):
                self.node(named[name], [named[d] for d in deps], **held)(fn)
                continue
            self.node(named[name], [named[d] for d in deps], **held)(_renamed(fn, {d: named[d] for d in deps}))
        return {o: named[o] for o in template.outputs}

    def order(self, targets: Iterable[str] | None = None) -> list[str]:
        """The targets and all they need, dependencies first, otherwise as registered."""
        done, path, out = set(), set(), []

        def visit(name: str) -> None:
            if name in done:
                return
            if name not in self.steps:
                raise KeyError(f"unknown step {name!r}")
            if name in path:
                raise ValueError(f"a cycle passes through {name!r}")
            path.add(name)
            for dep in self.steps[name].deps:
                visit(dep)
            path.discard(name)
            done.add(name)
            out.append(name)

        for name in targets if targets is not None else self.steps:
            visit(name)
        return out

    def run(self, targets: Iterable[str] | None = None, *, seal: Callable[[str, DataFrame], DataFrame] | None = None, workers: int = 1) -> RunResult:
        """Build the targets. seal(name, df) may write a step's rows and return what is read back; then independent steps overlap
        on `workers` threads. After a failure no step that needs it runs, and the failure that comes first in the order is raised."""
        order = self.order(targets)
        made: dict[str, DataFrame] = {}
        errors: dict[str, BaseException] = {}

        def build(name: str) -> DataFrame:
            step = self.steps[name]
            df = step.fn({d: viewed(step, d, made[d]) for d in step.deps})
            return seal(name, df) if seal else df

        waiting = list(order)
        with ThreadPoolExecutor(max(1, workers)) as pool:
            while waiting and not errors:
                ready = [n for n in waiting if all(d in made for d in self.steps[n].deps)]
                for name, job in [(n, pool.submit(build, n)) for n in ready]:
                    try:
                        made[name] = job.result()
                    except Exception as e:  # noqa: BLE001 - kept, and raised below in order
                        errors[name] = e
                waiting = [n for n in waiting if n not in ready]
        if errors:
            first = min(errors, key=order.index)
            for other in sorted(set(errors) - {first}, key=order.index):
                errors[first].add_note(f"{other} failed too: {errors[other]}")
            raise errors[first]
        return RunResult(made, tuple(order))

    def edges(self, spark: SparkSession) -> DataFrame:
        """(src, dst, role)"""
        rows = [(d, s.name, "items" if d == s.items_from else "dep") for s in self.steps.values() for d in s.deps]
        return spark.createDataFrame(rows, "src string, dst string, role string")


def _below(edges: DataFrame) -> dict[str, list[str]]:
    """What follows each step directly."""
    held = edges.select("src", "dst").distinct().limit(MOST_EDGES + 1).collect()
    if len(held) > MOST_EDGES:
        raise ValueError(f"a graph of steps has at most {MOST_EDGES} edges")
    out: dict[str, list[str]] = {}
    for r in held:
        out.setdefault(r.src, []).append(r.dst)
    return out


def closure(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, name): everything downstream of each root, itself not included. A graph of declared steps is small: at most MOST_EDGES edges."""
    below = _below(edges)
    rows = []
    for root in sorted(r.name for r in roots.select("name").distinct().collect()):
        seen, todo = {root}, [root]
        while todo:
            for name in below.get(todo.pop(), ()):
                if name not in seen:
                    seen.add(name)
                    todo.append(name)
        rows += [(root, name) for name in sorted(seen - {root})]
    return spark.createDataFrame(rows, "root string, name string")


def waves(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, wave): the length of the longest path that leads to each node, each edge looked at once."""
    below = _below(edges)
    wave = {r.name: 0 for r in nodes.select("name").collect()}
    waiting = {name: 0 for name in wave}
    for names in below.values():
        for name in names:
            waiting[name] += 1
    ready = [name for name, n in waiting.items() if not n]
    done = 0
    while ready:
        name, done = ready.pop(), done + 1
        for after in below.get(name, ()):
            wave[after] = max(wave[after], wave[name] + 1)
            waiting[after] -= 1
            if not waiting[after]:
                ready.append(after)
    if done < len(wave):
        raise ValueError("the steps have a cycle")
    return spark.createDataFrame(sorted(wave.items()), "name string, wave int")


def skips(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, state) of steps (name, state): everything below a pending or skipped step is skipped; a waiting step that has only
    successful dependencies is ready."""
    bad = closure(spark, edges, nodes.where(F.col("state").isin("pending", "retry_pending", "skipped")).select("name")).select("name").distinct().withColumn("__skip", F.lit(True))
    held = edges.join(nodes.select(F.col("name").alias("src"), F.col("state").alias("__up")), "src").groupBy(F.col("dst").alias("name")).agg(F.bool_and(F.col("__up") == "success").alias("__fed"))
    out = nodes.join(bad, "name", "left").join(held, "name", "left")
    state = F.when(F.col("__skip"), "skipped").when((F.col("state") == "waiting") & F.coalesce("__fed", F.lit(True)), "ready").otherwise(F.col("state"))
    return out.select("name", state.alias("state"))


def run_status(status):
    """Status of a run of the statuses of its attempts: ambiguous, then pending_retry, then checkpoint_pending, else completed."""
    has = lambda x: F.count_if(status == x) > 0
    return F.when(has("ambiguous"), "ambiguous").when(has("retry_scheduled"), "pending_retry").when(has("checkpoint_pending"), "checkpoint_pending").otherwise("completed")
