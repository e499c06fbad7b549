"""Conversion rules: built-in defaults under a job's own file (SRC14).

Mappings merge by key, anything else replaces.  An unknown key or value stops the run before it
starts, and a cut precision must say how to round.
"""

from __future__ import annotations

import copy
import json
from pathlib import Path

from concordia.functions.values import SENTINELS, ValueRule

#: Target type of each source type; {n} characters, {p} precision, {s} scale.
TYPES = {
    "bigint": {"to": "bigint"},
    "int": {"to": "integer"},
    "smallint": {"to": "smallint"},
    "tinyint": {"to": "smallint", "check": "BETWEEN 0 AND 255"},
    "bit": {"to": "boolean"},
    "decimal": {"to": "numeric({p},{s})"},
    "numeric": {"to": "numeric({p},{s})"},
    "money": {"to": "numeric(19,4)"},
    "smallmoney": {"to": "numeric(10,4)"},
    "float": {"to": "double precision"},
    "real": {"to": "real"},
    "date": {"to": "date"},
    "time": {"to": "time({p})", "max_precision": 6, "round": "half_up"},
    "datetime": {"to": "timestamp(3)"},
    "smalldatetime": {"to": "timestamp(0)"},
    "datetime2": {"to": "timestamp({p})", "max_precision": 6, "round": "half_up"},
    "datetimeoffset": {"to": "timestamptz({p})", "max_precision": 6, "round": "half_up", "warn": "the offset is dropped; the UTC instant is kept"},
    "char": {"to": "char({n})"},
    "nchar": {"to": "char({n})"},
    "varchar": {"to": "varchar({n})", "max": "text"},
    "nvarchar": {"to": "varchar({n})", "max": "text"},
    "sysname": {"to": "varchar(128)"},
    "text": {"to": "text"},
    "ntext": {"to": "text"},
    "binary": {"to": "bytea"},
    "varbinary": {"to": "bytea"},
    "image": {"to": "bytea"},
    "uniqueidentifier": {"to": "uuid", "warn": "sorts in another order"},
    "rowversion": {"to": "bytea", "warn": "keeps the value of the copy; optimistic locking needs another design"},
    "xml": {"to": "xml"},
}
_CLOCK = "equals the source only if both servers are in one time zone"
#: Target expression of each default function without arguments.
FUNCTIONS = {
    "getdate": {"to": "LOCALTIMESTAMP", "warn": _CLOCK},
    "sysdatetime": {"to": "LOCALTIMESTAMP", "warn": _CLOCK},
    "current_timestamp": {"to": "LOCALTIMESTAMP", "warn": _CLOCK},
    "getutcdate": {"to": "(now() AT TIME ZONE 'UTC')"},
    "sysutcdatetime": {"to": "(now() AT TIME ZONE 'UTC')"},
    "sysdatetimeoffset": {"to": "now()"},
    "newid": {"to": "gen_random_uuid()"},
    "newsequentialid": {"to": "gen_random_uuid()", "warn": "random, not sequential"},
    "suser_sname": {"to": "session_user", "warn": "the role's name, not the login's"},
    "suser_name": {"to": "session_user", "warn": "the role's name, not the login's"},
    "user_name": {"to": "current_user", "warn": "the role's name, not the user's"},
    "host_name": {"to": "inet_client_addr()::text", "warn": "the client's address, not its name"},
    "app_name": {"to": "current_setting('application_name')"},
    "db_name": {"to": "current_database()"},
}
DEFAULTS = {
    "version": 1,
    "types": TYPES,
    "identity": {"to": "generated by default as identity", "setval": "from_ident_current"},
    "sequence": {"setval": "from_current_value"},
    "text": {"trailing_space": "keep", "nul_char": "fail", "nul_replacement": "�", "case": "keep"},
    "collation": {"target": "C", "ci_unique": "lower_index"},
    "sentinel_dates": {"values": list(SENTINELS), "action": "keep"},
    "identifiers": {"case": "lower", "map": {}, "schemas": {}},
    "computed_columns": {"action": "generated_stored"},
    "defaults": {"functions": FUNCTIONS},
    "tables": {},
}
_CHOICES = {
    "text.trailing_space": ("keep", "rtrim"), "text.nul_char": ("fail", "strip", "replace"), "text.case": ("keep", "upper", "lower"),
    "collation.target": ("C", "ko-KR-x-icu", "ci"), "collation.ci_unique": ("none", "lower_index", "ci_collation"), "sentinel_dates.action": ("keep", "null", "infinity"),
    "identifiers.case": ("lower", "keep"), "computed_columns.action": ("generated_stored", "value_with_warning"),
    "identity.setval": ("from_ident_current", "from_max", "none"), "sequence.setval": ("from_current_value", "none"),
}
_OPEN = ("types", "identifiers.map", "identifiers.schemas", "defaults.functions", "tables")
_TYPE_KEYS = {"to", "max", "max_precision", "round", "check", "warn"}
_COLUMN_KEYS = {"name", "type", "default", "generated", "computed", "trailing_space", "nul_char", "nul_replacement", "case", "sentinel"}


class RuleError(ValueError):
    pass


def merged(base: dict, over: dict, at: str = "") -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        path = f"{at}.{k}" if at else str(k)
        if k not in out and at not in _OPEN and not any(at.startswith(f"{o}.") for o in _OPEN):
            raise RuleError(f"unknown rule {path}")
        out[k] = merged(out[k], v, path) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def read(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise RuleError("reading YAML needs PyYAML; JSON works without") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(over: dict | str | Path | None = None) -> dict:
    """The defaults with a job's rules on top, checked."""
    rules = merged(DEFAULTS, read(over) if isinstance(over, str | Path) else over or {})
    for path, choices in _CHOICES.items():
        a, b = path.split(".")
        if rules[a][b] not in choices:
            raise RuleError(f"{path} is {rules[a][b]!r}, not one of {', '.join(choices)}")
    for name, t in rules["types"].items():
        if set(t) - _TYPE_KEYS or "to" not in t:
            raise RuleError(f"types.{name}: needs 'to' and knows only {', '.join(sorted(_TYPE_KEYS))}")
        if "max_precision" in t and t.get("round") not in ("half_up", "truncate"):
            raise RuleError(f"types.{name}: max_precision needs round half_up or truncate")
    for name, t in rules["tables"].items():
        if set(t or {}) - {"exclude", "columns"}:
            raise RuleError(f"tables.{name}: only exclude and columns are known")
        for c, keys in ((t or {}).get("columns") or {}).items():
            if set(keys) - _COLUMN_KEYS:
                raise RuleError(f"tables.{name}.columns.{c}: unknown {', '.join(sorted(set(keys) - _COLUMN_KEYS))}")
    return rules


def table_rule(rules: dict, full: str) -> dict:
    return next((v or {} for k, v in rules["tables"].items() if k.lower() == full.lower()), {})


def column_rule(rules: dict, full: str, column: str) -> dict:
    return next((v for k, v in (table_rule(rules, full).get("columns") or {}).items() if k.lower() == column.lower()), {})


def base_value_rule(rules: dict, source_type: str) -> ValueRule:
    t, s = rules["text"], rules["sentinel_dates"]
    how = rules["types"].get(source_type, {}).get("round", "half_up")
    return ValueRule(t["nul_char"], t["nul_replacement"], t["trailing_space"], t["case"], s["action"], tuple(s["values"]), how)
