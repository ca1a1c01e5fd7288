"""Command line over a store: python -m flowledger COMMAND --store DIR [...]

runs            list runs with their number of steps
show RUN        sidecar rows of a run
diff A B        steps whose artifacts differ between two runs
trace RUN NODE  sidecar rows of a step and its items
approve RUN NODE  let a later run go on behind a step
resolve RUN TARGET ATTEMPT ACTION REASON  decide on an ambiguous attempt
recover RUN     take up the attempts of a run that crashed
plan MODULE:CALLABLE | describe MODULE:CALLABLE | graph MODULE:CALLABLE  states, steps or a diagram of the pipeline that a function makes
init DIR        a new project: pyproject table, folders and a first pipeline
guard FILE...   static findings"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from .sources.config import entry_point, load_config, project_root

INIT = {
    "pyproject.toml": '[tool.flowledger]\nstore = "runs"\nentry = "pipeline:make"\n',
    "pipeline.py": 'from flowledger.operators.graph import Pipeline\n\n\ndef make(spark):\n    p = Pipeline()\n    p.node("numbers")(lambda _: spark.range(10))\n    return p\n',
    "prompts/.keep": "",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="flowledger", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("command", choices="runs show diff trace approve resolve recover plan describe graph init guard".split())
    top.add_argument("args", nargs="*")
    top.add_argument("--store")
    return top


def diagram(pipeline) -> str:
    """Mermaid text of a pipeline."""
    name = lambda n: "n_" + hashlib.sha256(n.encode()).hexdigest()[:12]
    label = lambda n: n.replace("&", "&amp;").replace('"', "&quot;").replace("\n", "<br/>")
    lines = ["flowchart TD", *(f'  {name(s.name)}["{label(s.name)} ({s.kind})"]' for s in pipeline.steps.values())]
    lines += [f"  {name(d)} {'-->|items|' if d == s.items_from else '-->'} {name(s.name)}" for s in pipeline.steps.values() for d in s.deps]
    return "\n".join(lines)


def shown(rows) -> str:
    return "\n".join(json.dumps(r.asDict(), ensure_ascii=False, sort_keys=True, default=str) for r in rows)


def main(argv: list[str], spark=None) -> int:
    asked = parser().parse_args(argv)
    command, args = asked.command, asked.args
    if command == "guard":
        from .guard import main as guard

        return guard(args)
    if command == "init":
        root = Path(args[0])
        for path, content in INIT.items():
            if (root / path).exists():
                raise SystemExit(f"{root / path} is there already")
        for path, content in INIT.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(content, encoding="utf-8")
        print(f"made {root}")
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import cache, run
    from .sources.ledger import Ledger
    from .sources.store import Store

    spark = spark or SparkSession.builder.getOrCreate()
    root = project_root(".")
    config = load_config(root) if root else None
    place = asked.store or (str(Path(config.root) / config.store) if config else None)
    store = Store(spark, place) if place else None
    if command in ("describe", "graph", "plan"):
        pipeline = entry_point(args[0] if args else config.entry if config else "")(spark)
        if command == "graph":
            print(diagram(pipeline))
        elif command == "describe":
            print("\n".join(f"{s.name}: {s.kind}, cache {s.cache}, needs {', '.join(s.deps) or 'nothing'}" for s in pipeline.steps.values()))
        else:
            print("\n".join(f"{n}: {state}" for n, state in run.plan(pipeline, store).items()))
        return 0
    if store is None:
        raise SystemExit("no store: give --store, or a project with a configuration")
    sidecars = lambda *runs: store.read("sidecars", run.SIDECARS, list(runs) or None)
    if command == "runs":
        print(shown(sidecars().groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("cache") == "hit").alias("hits")).orderBy("run_id").collect()))
    elif command == "show":
        print(shown(sidecars(args[0]).orderBy("created_at").collect()))
    elif command == "diff":
        print(shown(cache.diff(sidecars(args[0]), sidecars(args[1]), "node", "artifact_sha256").orderBy("node").collect()))
    elif command == "trace":
        print(shown(sidecars(args[0]).where((F.col("node") == args[1]) | F.col("node").startswith(args[1] + "@")).collect()))
    elif command == "approve":
        from .operators.graph import RunResult

        run.approve(store, RunResult({}, (), run_id=args[0]), args[1])
    elif command == "resolve":
        print(Ledger(store, args[0]).resolve(args[1], attempt=int(args[2]), action=args[3], reason=" ".join(args[4:])))
    elif command == "recover":
        print(json.dumps(Ledger(store, args[0]).recover(), sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
