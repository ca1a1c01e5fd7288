"""Steps whose rows are done by an agent: a capsule that says what it is, an adapter that runs a task, and limits that hold.

An adapter is any picklable object with run(task) -> result dict (output, trajectory, files). Rows are handed out in Arrow batches, and
results should be written before they are used again, since an agent's work is not repeatable; `run.execute` does that for a map step.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import digest

RESULT = "output string, trajectory array<string>, files map<string,string>, error string"


@dataclass(frozen=True)
class Limits:
    timeout_seconds: float = 300.0
    max_turns: int = 24
    max_files: int = 100
    max_bytes: int = 10 * 1024 * 1024
    max_events: int = 200

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0 or (name == "timeout_seconds" and not value):
                raise ValueError(f"{name} must be a positive number")


@dataclass(frozen=True)
class Capsule:
    """An agent from a folder: agent.json (provider, model, tools, limits), system.md, and files below skills/. Its digest is of all of it."""

    provider: str
    model: str
    system: str
    tools: tuple[str, ...] = ()
    files: tuple[tuple[str, str], ...] = ()
    limits: Limits = field(default_factory=Limits)

    @classmethod
    def load(cls, path: str) -> Capsule:
        root = Path(path)
        if root.is_symlink() or not root.is_dir():
            raise ValueError("a capsule is a folder, not a link")
        found = sorted(p for p in root.rglob("*") if not p.is_dir())
        if any(p.is_symlink() for p in root.rglob("*")):
            raise ValueError("a capsule has no links")
        spec = json.loads((root / "agent.json").read_text(encoding="utf-8"))
        if unknown := set(spec) - {"provider", "model", "tools", "limits"}:
            raise ValueError(f"unknown entries {sorted(unknown)}")
        limits = Limits(**spec.get("limits", {}))
        files = tuple((p.relative_to(root).as_posix(), p.read_text(encoding="utf-8")) for p in found if p.relative_to(root).parts[0] == "skills")
        if len(files) > limits.max_files or sum(len(t.encode()) for _, t in files) > limits.max_bytes:
            raise ValueError("the capsule's files are beyond its limits")
        return cls(spec["provider"], spec["model"], (root / "system.md").read_text(encoding="utf-8"), tuple(spec.get("tools", ())), files, limits)

    @property
    def identity(self) -> str:
        return digest(asdict(self))


class Adapter(Protocol):
    def run(self, task: dict) -> dict: ...


def _bounded(result: dict, limits: Limits) -> dict:
    files = {str(k): str(v) for k, v in (result.get("files") or {}).items()}
    if len(files) > limits.max_files or sum(len(v.encode()) for v in files.values()) > limits.max_bytes:
        raise ValueError("the agent's files are beyond its limits")
    return {"output": result.get("output"), "trajectory": [str(e) for e in (result.get("trajectory") or [])][: limits.max_events], "files": files}


def _done(adapter: Adapter, capsule: Capsule, row: dict, session: str | None) -> dict:
    try:
        task = {"row": row, "system": capsule.system, "model": capsule.model, "tools": capsule.tools, "session": session, "limits": asdict(capsule.limits)}
        result = adapter.run(task)
        return {**_bounded(result, capsule.limits), "error": None, "session": result.get("session")}
    except Exception as e:  # noqa: BLE001 - becomes the row's error
        return {"output": None, "trajectory": [], "files": {}, "error": f"{type(e).__name__}: {e}", "session": session}


def _columns(done: list[dict]) -> list[pa.Array]:
    return [pa.array([d["output"] for d in done], pa.string()), pa.array([d["trajectory"] for d in done], pa.list_(pa.string())), pa.array([list(d["files"].items()) for d in done], pa.map_(pa.string(), pa.string())), pa.array([d["error"] for d in done], pa.string())]


def agent_map(items: DataFrame, capsule: Capsule, adapter: Adapter, item: str = "id") -> DataFrame:
    """(item, output, trajectory, files, error) of each item, on its own."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches):
        for batch in batches:
            done = [_done(adapter, capsule, row, None) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(item)), *_columns(done)], names=["item", "output", "trajectory", "files", "error"])

    return items.mapInArrow(run, f"item {kind}, {RESULT}").withColumnRenamed("item", item)


def agent_scan(items: DataFrame, capsule: Capsule, adapter: Adapter, chain: str, order: list[str]) -> DataFrame:
    """(chain, order..., output, trajectory, files, error): the items of a chain one after the other, each with the session that the one before left.
    After an error the rest of the chain is not run. Chains run side by side, a chain as a stream in one task."""
    dealt = items.repartition(chain).sortWithinPartitions(chain, *order)
    names = [chain, *order]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*names).schema)

    def run(batches):
        current, session, stopped = object(), None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row[chain] != current:
                    current, session, stopped = row[chain], None, None
                if stopped:
                    done.append({"output": None, "trajectory": [], "files": {}, "error": f"skipped after: {stopped}"})
                    continue
                done.append(_done(adapter, capsule, row, session))
                session, stopped = done[-1]["session"], done[-1]["error"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *_columns(done)], names=[*names, "output", "trajectory", "files", "error"])

    return dealt.mapInArrow(run, f"{fields}, {RESULT}")


class ScriptedAgent:
    """An adapter for tests: answers by a function of the task, and passes on how many tasks the session has had."""

    def __init__(self, answer: Callable[[dict], str]) -> None:
        self.answer = answer

    def run(self, task: dict) -> dict:
        n = int(task["session"] or 0) + 1
        return {"output": self.answer(task["row"] | {"n": n}), "trajectory": [f"turn {n}"], "files": {}, "session": str(n)}


def capsule_digest(files: DataFrame) -> DataFrame:
    """One digest of capsule files (path, content) that are rows."""
    each = F.array_sort(F.collect_list(F.struct("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha"))))
    return files.agg(F.sha2(F.to_json(each), 256).alias("digest"))


def staged_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
