"""Configuration of a project (a table of pyproject.toml and an env file) and template files."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

TABLE = "flowledger"


@dataclass(frozen=True)
class Config:
    root: str
    store: str = "runs"
    prompts: str = "prompts"
    sources: tuple[str, ...] = ()
    entry: str = ""
    env_file: str = ".env"
    keep_runs: int = 20


def project_root(start: str) -> Path | None:
    """The nearest folder from `start` upwards that has a pyproject.toml."""
    at = Path(start).resolve()
    return next((p for p in ([at] if at.is_dir() else []) + list(at.parents) if (p / "pyproject.toml").is_file()), None)


def load_config(root: str | Path) -> Config | None:
    """The project's table, or None without one. An unknown key is an error."""
    path = Path(root) / "pyproject.toml"
    if not path.is_file():
        return None
    held = tomllib.loads(path.read_text(encoding="utf-8")).get("tool", {}).get(TABLE)
    if held is None:
        return None
    known = {f.name for f in fields(Config)} - {"root"}
    if not isinstance(held, dict) or (unknown := set(held) - known):
        raise ValueError(f"unknown configuration: {sorted(unknown) if isinstance(held, dict) else 'not a table'}")
    return Config(str(Path(root).resolve()), **{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})


def load_env(path: str | Path, environ: dict | None = None) -> dict[str, str]:
    """NAME=value lines of a file, set where the environment doesn't have them."""
    target = os.environ if environ is None else environ
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).is_file() else []:
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name.strip() and not name.startswith("#"):
            found[name.strip()] = value.strip().strip("\"'")
    for name, value in found.items():
        target.setdefault(name, value)
    return found


def load_template(path: str | Path) -> str:
    return Path(path).read_text(encoding="utf-8")


def entry_point(name: str):
    """What `module:callable` names."""
    from importlib import import_module

    module, sign, attribute = name.partition(":")
    if not sign:
        raise ValueError("an entry is module:callable")
    found = getattr(import_module(module), attribute)
    if not callable(found):
        raise ValueError(f"{name} can't be called")
    return found
