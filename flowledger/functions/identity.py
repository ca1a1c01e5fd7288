"""What a step's code is, as digests: of a function without its comments and docstrings, and of the source files around it."""

from __future__ import annotations

import ast
import enum
import functools
import hashlib
import inspect
import json
import re
import textwrap
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path


def digest(value) -> str:
    """SHA-256 of a JSON value in canonical form."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _without_docstrings(tree: ast.AST) -> ast.AST:
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and body and ast.get_docstring(node, clean=False) is not None:
            node.body = body[1:] or [ast.Pass()]
    return tree


def source_digest(source: str) -> str:
    """Equal for sources that differ in comments, blank space or docstrings only."""
    return hashlib.sha256(ast.dump(_without_docstrings(ast.parse(textwrap.dedent(source)))).encode()).hexdigest()


def fingerprint(fn: Callable) -> str:
    """A function's digest: of its source (of its code and constants, for a lambda), its default values, the values that it closes over, and the
    functions and plain values of its own module that it names. What has no value of its own to digest is refused."""
    return digest(_described(fn, {}))


def _code_of(fn) -> str:
    try:
        if fn.__name__ == "<lambda>":
            raise TypeError("the line of a lambda has more than the lambda")
        return source_digest(inspect.getsource(fn))
    except (OSError, TypeError, SyntaxError):
        return digest(_code(fn.__code__))


_PLAIN = (type(None), bool, int, float, complex, str, bytes)


def _described(value, seen: dict):
    """A JSON value that differs where the value differs."""
    kind = type(value).__name__
    if isinstance(value, _PLAIN):
        return [kind, repr(value)]
    if id(value) in seen:
        return ["seen", seen[id(value)]]
    seen[id(value)] = len(seen)
    inner = lambda x: _described(x, seen)
    if isinstance(value, functools.partial):
        return [kind, inner(value.func), [inner(x) for x in value.args], {k: inner(x) for k, x in sorted(value.keywords.items())}]
    if inspect.isfunction(value):
        names = sorted(set(value.__code__.co_names))
        near = {n: value.__globals__[n] for n in names if n in value.__globals__ and _is_near(value.__globals__[n], value.__module__)}
        cells = [inner(c.cell_contents) for c in value.__closure__ or ()]
        return ["function", _code_of(value), [inner(x) for x in value.__defaults__ or ()], {k: inner(x) for k, x in sorted((value.__kwdefaults__ or {}).items())}, cells, {n: inner(x) for n, x in near.items()}]
    if inspect.ismethod(value):
        return ["method", inner(value.__func__), inner(value.__self__)]
    if isinstance(value, (list, tuple)):
        return [kind, [inner(x) for x in value]]
    if isinstance(value, (set, frozenset)):
        return [kind, sorted((json.dumps(inner(x), default=str) for x in value))]
    if isinstance(value, Mapping):
        return [kind, sorted(([inner(k), inner(v)] for k, v in value.items()), key=lambda kv: json.dumps(kv[0], default=str))]
    if inspect.ismodule(value) or inspect.isbuiltin(value):
        return [kind, value.__name__]
    if inspect.isclass(value):
        try:
            return [kind, value.__qualname__, source_digest(inspect.getsource(value))]
        except (OSError, TypeError, SyntaxError):
            return [kind, value.__module__, value.__qualname__]
    if isinstance(value, (Path, re.Pattern, enum.Enum)) or kind in ("date", "datetime", "timedelta", "Decimal", "UUID"):
        return [kind, str(value)]
    if kind == "ndarray":
        return [kind, str(value.dtype), list(value.shape), hashlib.sha256(value.tobytes()).hexdigest()]
    if hasattr(value, "sparkSession") and hasattr(value, "toDF"):
        from .frames import content_digest

        return ["table", content_digest(value)]
    if kind == "SparkSession":
        return [kind]
    if type(value).__module__.startswith("pyspark."):
        return [kind, value.json() if hasattr(value, "json") else str(value)]
    if hasattr(value, "__wrapped__"):
        return [kind, inner(value.__wrapped__)]
    held = getattr(value, "__dict__", None)
    if held is None or type(value).__module__ == "builtins":
        raise ValueError(f"{value!r} has no digest, so results of a function that uses it can't be stored")
    return [kind, inner(type(value)), {k: inner(v) for k, v in sorted(held.items())}]


def _is_near(value, module: str) -> bool:
    return isinstance(value, _PLAIN) or (inspect.isfunction(value) and value.__module__ == module) or (isinstance(value, (tuple, frozenset)) and all(isinstance(x, _PLAIN) for x in value))


def _code(code) -> list:
    return [code.co_code.hex(), list(code.co_names), [_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]]


def libs_digest(roots: Iterable[str], modules: Iterable[str] | None = None) -> tuple[str, bool]:
    """(digest, precise) of the Python files below the source folders that the modules import, also through each other.

    An import that can't be followed (a star, __import__ or importlib) makes it the digest of all files, which is not precise."""
    files = {p.relative_to(root).as_posix(): p for root in map(Path, roots) for p in sorted(root.rglob("*.py"))}
    named = {name.removesuffix(".py").removesuffix("/__init__").replace("/", "."): name for name in files}
    sources = {name: path.read_text(encoding="utf-8") for name, path in files.items()}

    def all_of_them() -> tuple[str, bool]:
        return digest({name: source_digest(s) for name, s in sources.items()}), False

    if modules is None:
        return all_of_them()
    seen, todo = set(), [m for m in modules if m in named]
    while todo:
        module = todo.pop()
        if module in seen:
            continue
        seen.add(module)
        package = module if named[module].endswith("__init__.py") else module.rpartition(".")[0]
        for node in ast.walk(ast.parse(sources[named[module]])):
            wanted: list[str] = []
            if isinstance(node, ast.Import):
                wanted = [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                if any(a.name == "*" for a in node.names):
                    return all_of_them()
                base = node.module or ""
                if node.level:
                    parts = package.split(".")
                    base = ".".join([*parts[: len(parts) - node.level + 1], *([base] if base else [])])
                wanted = [base, *(f"{base}.{a.name}" for a in node.names)]
            elif isinstance(node, ast.Call) and getattr(node.func, "id", getattr(node.func, "attr", "")) in ("__import__", "import_module"):
                return all_of_them()
            todo += [n for w in wanted for n in _prefixes(w) if n in named]
    return digest({named[m]: source_digest(sources[named[m]]) for m in sorted(seen)}), True


def _prefixes(module: str) -> list[str]:
    parts = module.split(".")
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


def run_identity(steps: Mapping[str, dict], targets: Iterable[str], force: Iterable[str], libs: str = "") -> str:
    """What a run is: its declarations, targets, forced steps and libraries."""
    return digest({"steps": dict(steps), "targets": sorted(targets), "force": sorted(force), "libs": libs})
