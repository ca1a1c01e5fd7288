"""Static checks of pipeline code: driver-side loops over collected rows, and files read behind the engine's back.

`python -m flowledger.guard FILE...` prints findings; a line that ends with `# guard: ok <reason>` is waived."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator
from pathlib import Path

GATHER = ("collect", "toPandas", "toLocalIterator")


def findings(source: str, name: str = "<source>") -> Iterator[str]:
    lines = source.splitlines()

    def waived(line: int) -> bool:
        _, mark, reason = lines[line - 1].partition("# guard: ok")
        return bool(mark and reason.strip())

    def calls(node: ast.AST) -> Iterator[ast.Call]:
        return (x for x in ast.walk(node) if isinstance(x, ast.Call))

    for node in ast.walk(ast.parse(source, name)):
        if isinstance(node, (ast.For, ast.While)):
            for call in (c for part in node.body for c in calls(part)):
                if isinstance(call.func, ast.Attribute) and call.func.attr in GATHER and not waived(call.lineno):
                    yield f"{name}:{call.lineno}: {call.func.attr}() in a loop runs a job each time"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "open" and not waived(node.lineno):
            yield f"{name}:{node.lineno}: open() reads a file that no step declares; use spark.read"


def main(paths: list[str]) -> int:
    found = [x for p in paths for x in findings(Path(p).read_text(encoding="utf-8"), p)]
    print("\n".join(found) or "no findings")
    return bool(found)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
