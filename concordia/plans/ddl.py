"""Target definitions as text, in three phases, and the plan's report (PLN12, SNK5, MSC9, AGG15)."""

from __future__ import annotations

import unicodedata
from itertools import groupby
from pathlib import Path

from concordia.plans.model import ERROR, NOTE, WARN, SchemaPlan, TablePlan
from concordia.plans.names import quoted

PRE_LOAD, POST_LOAD, CUTOVER = "PRE_LOAD", "POST_LOAD", "CUTOVER"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _table(t: TablePlan) -> list[str]:
    lines = []
    for c in t.columns:
        parts = [quoted(c.name), c.type]
        if c.collation:
            parts.append(f"COLLATE {c.collation}")
        if c.generated:
            parts.append(f"GENERATED ALWAYS AS ({c.generated}) STORED")
        elif c.identity:
            parts.append(c.identity)
        elif c.default:
            parts.append(f"DEFAULT {c.default}")
        if not c.source.nullable and not c.generated:
            parts.append("NOT NULL")
        if c.check:
            parts.append(f"CHECK ({c.check})")
        lines.append("    " + " ".join(parts))
    if t.key_name:
        lines.append(f"    CONSTRAINT {quoted(t.key_name)} PRIMARY KEY ({', '.join(quoted(k) for k in t.key)})")
    name = quoted(t.schema, t.name)
    out = [f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"]
    return out + [f"COMMENT ON COLUMN {name}.{quoted(c.name)} IS {_literal(c.comment)}" for c in t.columns if c.comment]


def statements(plan: SchemaPlan, phase: str) -> list[str]:
    if phase == POST_LOAD:
        return [s for t in plan.tables for s in t.after_load]
    if phase == CUTOVER:
        return [s for t in plan.tables for s in t.at_switch]
    schemas = dict.fromkeys([s for _, s, _ in plan.sequences] + [t.schema for t in plan.tables])
    out = [f"CREATE SCHEMA IF NOT EXISTS {quoted(s)}" for s in schemas]
    out += [f"CREATE COLLATION IF NOT EXISTS {c} (provider = icu, locale = 'und-u-ks-level2', deterministic = false)" for c in plan.collations]
    for s, schema, name in plan.sequences:
        cycle = "CYCLE" if s.cycling else "NO CYCLE"
        out.append(f"CREATE SEQUENCE {quoted(schema, name)} AS {s.type} START WITH {s.start} INCREMENT BY {s.increment} MINVALUE {s.minimum} MAXVALUE {s.maximum} {cycle}")
    return out + [x for t in plan.tables for x in _table(t)]


def text(plan: SchemaPlan, phase: str) -> str:
    return "".join(f"{s};\n" for s in statements(plan, phase))


def padded(value: str, width: int) -> str:
    """MSC9: wide characters take two columns."""
    return value + " " * max(0, width - sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in value))


def report(plan: SchemaPlan, head: list[str] | tuple[str, ...] = ()) -> str:
    no_key = sum(not t.key for t in plan.tables)
    columns = sum(len(t.columns) for t in plan.tables)
    out = [*head, f"tables {len(plan.tables)} (without key {no_key}, excluded {len(plan.excluded)}), columns {columns}"]
    out.append(", ".join(f"{level.lower()} {plan.count(level)}" for level in (ERROR, WARN, NOTE)))
    out += ["result: " + ("blocked" if plan.blocked else "passed"), ""]
    for level in (ERROR, WARN, NOTE):
        out += [f"{padded(level, 6)}{i.where}: {i.message}" for i in plan.issues if i.level == level]
    for t in plan.tables:
        out += ["", f"{t.source.full} -> {t.schema}.{t.name}"]
        wide = max([len(c.source.name) for c in t.columns], default=0) + 2
        out += [f"  {padded(c.source.name, wide)}{c.source.type} -> {c.name} {c.type}" for c in t.columns]
        out += [f"  [after load] {s}" for s in t.after_load] + [f"  [at switch] {s}" for s in t.at_switch]
    for kind, names in groupby(plan.manual, key=lambda x: x[0]):
        out += ["", f"not converted, {kind}: " + ", ".join(n for _, n in names)]
    return "\n".join(out) + "\n"


def write(plan: SchemaPlan, folder: str | Path, head: tuple[str, ...] = ()) -> list[Path]:
    """The three phases' files and the report."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    files = {"1_pre_load.sql": text(plan, PRE_LOAD), "2_post_load.sql": text(plan, POST_LOAD), "3_cutover.sql": text(plan, CUTOVER), "plan.txt": report(plan, head)}
    for name, body in files.items():
        (folder / name).write_text(body, encoding="utf-8")
    return [folder / n for n in files]
