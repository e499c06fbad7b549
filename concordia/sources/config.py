"""Settings of a job: a file with ``${NAME:default}`` and an environment (SRC13, HSH4)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from concordia.plans.rules import read

DEFAULTS = {"rows_per_chunk": 1_000_000, "table_parallelism": 4, "chunks_per_table": 2, "batch_size": 100_000, "rows_per_bucket": 50_000, "status_seconds": 10, "pause_seconds": 0, "include": [], "exclude": [], "rules": None, "catalog": None, "changes": None, "log": None, "jdbc": None}
REQUIRED = ("source", "state", "job")
_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")


class ConfigError(ValueError):
    pass


def env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines; blank lines and comments are skipped, quotes around a value go."""
    out = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def resolved(value, env: dict[str, str]):
    if isinstance(value, dict):
        return {k: resolved(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolved(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ConfigError(f"{m[1]} is not set")
        return m[2]

    return _VARIABLE.sub(one, value)


def load(path: str | Path) -> dict:
    """The environment comes before the ``.env`` file beside the settings."""
    env = env_file(Path(path).parent / ".env") | dict(os.environ)
    raw = resolved(read(path), env)
    unknown = set(raw) - set(DEFAULTS) - set(REQUIRED)
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    missing = [k for k in REQUIRED if not raw.get(k)]
    if missing:
        raise ConfigError(f"missing settings: {', '.join(missing)}")
    out = DEFAULTS | raw
    for k in ("rows_per_chunk", "table_parallelism", "chunks_per_table", "batch_size", "rows_per_bucket"):
        if not isinstance(out[k], int) or out[k] < 1:
            raise ConfigError(f"{k} must be a whole number of at least 1")
    return out


def fingerprint(config: dict, rules: dict) -> str:
    return hashlib.sha256(json.dumps([config, rules], sort_keys=True, default=str).encode()).hexdigest()
