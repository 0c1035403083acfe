"""Settings from the environment, and project files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}")


def interpolate(text: str, env: Mapping[str, str] | None = None) -> str:
    """``${NAME}``, ``${NAME:-default}`` and a leading ``~`` replaced; an unset name without a default is empty."""
    env = os.environ if env is None else env
    out = _VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)
    if out == "~" or out.startswith("~/"):
        out = env.get("HOME", os.path.expanduser("~")) + out[1:]
    return out


@dataclass(frozen=True)
class Config:
    """Settings; each is read from ``QUILLSTONE_<NAME>``."""

    data_dir: str = "~/.quillstone"
    projects_dir: str = "~/.quillstone/projects"
    embedding_dim: int = 64
    embedding_batch: int = 32
    memory_min_bytes: int = 0
    memory_provider: str = "cascade"
    debounce_seconds: int = 2
    sync_minutes: int = 5

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(f"QUILLSTONE_{f.name.upper()}", f.default)
            values[f.name] = int(raw) if isinstance(f.default, int) else interpolate(str(raw), env)
        for name in ("embedding_dim", "embedding_batch", "debounce_seconds", "sync_minutes"):
            if values[name] <= 0:
                raise ValueError(f"{name} must be above 0")
        return cls(**values)


def project_path(folder: str, name: str) -> str:
    return os.path.join(folder, re.sub(r"[/\\]", "_", name) + ".json")


def save_project(folder: str, rule) -> str:
    """Writes a project's rule as JSON, by way of a temporary file; returns the path."""
    os.makedirs(folder, exist_ok=True)
    path = project_path(folder, rule.name)
    body = {k: v for k, v in asdict(rule).items() if v}
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(body, f, indent=2)
    os.replace(path + ".tmp", path)
    return path


def delete_project(folder: str, name: str) -> None:
    """Removes a project's file; one that is not there is fine."""
    try:
        os.remove(project_path(folder, name))
    except FileNotFoundError:
        pass


def unique_name(name: str, taken: set[str]) -> str:
    """``name``, or the first free of ``name-1``, ``name-2`` and so on."""
    if name not in taken:
        return name
    n = 1
    while f"{name}-{n}" in taken:
        n += 1
    return f"{name}-{n}"
