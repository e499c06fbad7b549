"""From a source catalog and rules to a schema plan (PLN1, PLN4-PLN9, PLN11, PLN13-PLN15, FIL2, FIL4)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.functions.values import resolve
from concordia.operators.catalog import like
from concordia.plans import rules as R
from concordia.plans.defaults import translate
from concordia.plans.model import ERROR, NOTE, TEXT, WARN, Catalog, Column, ColumnPlan, Index, Issue, SchemaPlan, Table, TablePlan
from concordia.plans.names import LIMIT, Namespace, quoted, size

#: Bytes that a key entry of an ordered index may take.
MOST_KEY_BYTES = 2700
CI_COLLATION = "ci_text"


def shown_type(c: Column) -> str:
    """PLN15: a source type as people write it."""
    if c.type in ("char", "varchar", "nchar", "nvarchar", "binary", "varbinary"):
        return f"{c.type}({'max' if c.max_length < 0 else c.length})"
    if c.type in ("decimal", "numeric"):
        return f"{c.type}({c.precision},{c.scale})"
    return f"{c.type}({c.scale})" if c.type in ("time", "datetime2", "datetimeoffset") else c.type


def target_type(c: Column, rule: dict, override: str | None = None) -> tuple[str, bool]:
    """PLN1: the template filled in, and whether precision was cut."""
    if override:
        return override, False
    if c.max_length < 0 and "max" in rule:
        return rule["max"], False
    p = c.scale if c.type in ("time", "datetime2", "datetimeoffset") else c.precision
    most = rule.get("max_precision")
    cut = most is not None and p > most
    return rule["to"].replace("{n}", str(c.length)).replace("{p}", str(most if cut else p)).replace("{s}", str(c.scale)), cut


def spark_type(target: str) -> T.DataType:
    """The Spark type that holds a target type's values."""
    name, _, args = target.lower().partition("(")
    numbers = [int(x) for x in re.findall(r"\d+", args)]
    if name == "numeric":
        return T.DecimalType(*numbers) if numbers else T.DecimalType(38, 10)
    plain = {
        "bigint": T.LongType(), "integer": T.IntegerType(), "smallint": T.ShortType(), "boolean": T.BooleanType(), "double precision": T.DoubleType(), "real": T.FloatType(),
        "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "bytea": T.BinaryType(),
    }
    return plain.get(name, T.StringType())


def spark_collation(c: ColumnPlan) -> str | None:
    """PLN11: the Spark collation of a column's target collation; None where texts compare byte by byte."""
    name = (c.collation or "").rsplit(".", 1)[-1].strip('"')
    if name == CI_COLLATION:
        return "UNICODE_CI"  # letters without case, accents with
    return name.removesuffix("-x-icu").split("-")[0] if name.endswith("-x-icu") else None


def collated(df: DataFrame, t: TablePlan) -> DataFrame:
    """A table's rows with texts that compare, group and join as the plan's collations say."""
    named = {c.name: spark_collation(c) for c in t.columns}
    return df.withColumns({n: F.collate(n, c) for n, c in named.items() if c and n in df.columns})


def struct_type(t: TablePlan) -> T.StructType:
    """A planned table's schema; the source type stays in the metadata, since it selects the canonical text."""
    meta = lambda c: {"source_type": c.source.type, "target_type": c.type}
    return T.StructType([T.StructField(c.name, spark_type(c.type), c.source.nullable, meta(c)) for c in t.columns])


_FILTER = re.compile(r"\s*(?:(\[(?:[^\]]|\]\])*\])|(N?'(?:[^']|'')*')|(-?\d+(?:\.\d+)?)|(<>|<=|>=|!=|=|<|>)|([()])|([A-Za-z_]+))", re.I)


def translate_filter(text: str, names: dict[str, str]) -> str | None:
    """FIL4: a filtered index's condition, if it is made of columns, constants, comparisons, IS [NOT] NULL, AND, OR and NOT.

    Tokens are translated one by one, so a national prefix goes only where a literal begins.
    """
    out, at, numbers = [], 0, 0
    while at < len(text.rstrip()):
        m = _FILTER.match(text, at)
        if not m:
            return None
        column, literal, number, comparison, paren, word = m.groups()
        gap = text[at : m.end() - len(m.group().strip())]
        if column:
            name = names.get(column[1:-1].replace("]]", "]"))
            if name is None:
                return None
            piece = quoted(name)
        elif word:
            if word.upper() not in ("IS", "NOT", "NULL", "AND", "OR"):
                return None
            piece = word.upper()
        else:
            piece = literal[1:] if literal and literal[0] in "Nn" else literal or number or comparison or paren
        out.append(gap + piece)
        at, numbers = m.end(), numbers + 1
    return re.sub(r"\((-?\d+(?:\.\d+)?)\)", r"\1", "".join(out)) if numbers else None


def most_bytes(c: Column) -> int:
    """PLN7: bytes of a text column's longest value in UTF-8, -1 if unlimited: half again as many as in its code page or UTF-16."""
    return -1 if c.max_length < 0 else c.max_length * 3 // 2


class _Planner:
    def __init__(self, catalog: Catalog, rules: dict, include: Iterable[str], exclude: Iterable[str], scan: dict | None) -> None:
        self.catalog, self.rules, self.scan = catalog, rules, scan or {}
        self.include, self.exclude = list(include), list(exclude)
        self.plan = SchemaPlan()
        self.spaces: dict[str, Namespace] = {}

    def issue(self, level: str, where: str, message: str) -> None:
        self.plan.issues.append(Issue(level, where, message))

    # -------------------------------------------------------------- names

    def schema_name(self, schema: str) -> str:
        known = self.rules["identifiers"]["schemas"]
        return next((v for k, v in known.items() if k.lower() == schema.lower()), self.cased(schema))

    def cased(self, name: str) -> str:
        return name.lower() if self.rules["identifiers"]["case"] == "lower" else name

    def table_name(self, full: str, name: str) -> str:
        return next((v for k, v in self.rules["identifiers"]["map"].items() if k.lower() == full.lower()), self.cased(name))

    def space(self, schema: str) -> Namespace:
        return self.spaces.setdefault(schema, Namespace())

    def fits(self, name: str, where: str) -> str:
        if size(name) > LIMIT:
            self.issue(ERROR, where, f"the name is longer than {LIMIT} bytes; map it: {name}")
        return name

    # -------------------------------------------------------------- all

    def run(self) -> SchemaPlan:
        chosen = []
        for t in sorted(self.catalog.tables, key=lambda t: t.full):
            hit = lambda patterns, full=t.full: any(re.match(like(p), full) for p in patterns)
            if self.include and not hit(self.include):
                continue
            if hit(self.exclude) or R.table_rule(self.rules, t.full).get("exclude"):
                self.plan.excluded.append((t.full, "excluded"))
            else:
                chosen.append(t)
        self.chosen = {t.full.lower(): t for t in chosen}
        for s in self.catalog.sequences:
            schema, name = self.schema_name(s.schema), self.cased(s.name)
            self.plan.sequences.append((self.clamped(s), schema, self.space(schema).claim(name, name)))
        for t in chosen:
            self.space(self.schema_name(t.schema)).claim(self.table_name(t.full, t.name), t.name)
        self.columns = {t.full.lower(): self.column_plans(t) for t in chosen}
        for t in chosen:
            self.plan.tables.append(self.table(t))
        self.plan.manual = sorted(self.catalog.other_objects)
        if self.plan.manual:
            self.issue(WARN, "objects", f"{len(self.plan.manual)} objects are listed but not converted")
        self.typos()
        self.behaviour(chosen)
        return self.plan

    def clamped(self, s):
        """PLN9: bounds that the target's sequences can hold."""
        low, high = -(1 << 63), (1 << 63) - 1
        if s.minimum < low or s.maximum > high:
            self.issue(WARN, f"{s.schema}.{s.name}", "sequence bounds are cut to 64 bits")
        return replace(s, minimum=max(s.minimum, low), maximum=min(s.maximum, high))

    def sequence_target(self, schema: str, name: str) -> str | None:
        for s, target, new in self.plan.sequences:
            if (s.schema.lower(), s.name.lower()) == (schema.lower(), name.lower()):
                return quoted(target, new)
        return None

    # -------------------------------------------------------------- columns

    def column_plans(self, t: Table) -> list[ColumnPlan]:
        return [p for c in t.columns if (p := self.column(t, c))]

    def column(self, t: Table, c: Column) -> ColumnPlan | None:
        where, own = f"{t.full}.{c.name}", R.column_rule(self.rules, t.full, c.name)
        name = self.fits(own.get("name") or self.cased(c.name), where)
        rule = self.rules["types"].get(c.type)
        if rule is None and "type" not in own:
            self.issue(ERROR, where, f"no rule for type {c.type}")
            return None
        rule = rule or {"to": own["type"]}
        kind, cut = target_type(c, rule, own.get("type"))
        if cut:
            self.issue(NOTE, where, f"{shown_type(c)} keeps {rule['max_precision']} digits ({rule['round']})")
        if rule.get("warn"):
            self.issue(WARN, where, f"{c.type} to {kind}: {rule['warn']}")
        if c.alias_type:
            self.issue(WARN, where, f"the alias type {c.alias_type} is resolved to {c.type}")
        value = resolve(c.type, R.base_value_rule(self.rules, c.type), own)
        self.judge_scan(t, c, where, value)
        plan = ColumnPlan(c, name, kind, value, check=f"{quoted(name)} {rule['check']}" if rule.get("check") else None, collation=self.collation(t, c, kind, value.case))
        if c.computed is not None:
            return self.computed(plan, own, where)
        if c.identity is not None:
            seed, step, _ = c.identity
            options = [f"START WITH {seed}"] * (seed != 1) + [f"INCREMENT BY {step}"] * (step != 1)
            text = self.rules["identity"]["to"].upper()
            plan = replace(plan, identity=f"{text} ({' '.join(options)})" if options else text)
        return replace(plan, default=self.default(t, c, kind, own, where))

    def judge_scan(self, t: Table, c: Column, where: str, value) -> None:
        """PLN14."""
        nul, sentinel = self.scan.get(t.full, {}).get(c.name, (0, 0))
        if nul:
            self.issue(ERROR if value.nul_char == "fail" else WARN, where, f"{nul} rows with a NUL character ({value.nul_char})")
        if sentinel:
            self.issue(NOTE, where, f"{sentinel} rows with a sentinel date ({value.sentinel})")

    def computed(self, plan: ColumnPlan, own: dict, where: str) -> ColumnPlan:
        """PLN4."""
        if own.get("generated"):
            return replace(plan, generated=" ".join(own["generated"].split()), comment=f"computed in the source as: {plan.source.computed}")
        if (own.get("computed") or self.rules["computed_columns"]["action"]) == "value_with_warning":
            self.issue(WARN, where, "the computed column becomes a plain one; its values are copied")
            return replace(plan, comment=f"computed in the source (values only) as: {plan.source.computed}")
        self.issue(ERROR, where, "a computed column needs a target expression in its rule (generated)")
        return plan

    def default(self, t: Table, c: Column, kind: str, own: dict, where: str) -> str | None:
        if "default" in own:
            return None if own["default"] == "none" else own["default"]
        if c.default is None:
            return None
        got = translate(c.default[1], kind, self.rules["defaults"]["functions"], t.schema, self.sequence_target)
        if got.error:
            self.issue(ERROR, where, f"default {got.error}")
        if got.warn:
            self.issue(WARN, where, f"default {c.default[1]}: {got.warn}")
        return got.expr

    def collation(self, t: Table, c: Column, kind: str, case: str) -> str | None:
        """PLN11: without case where the source compares so and the values keep their case: everywhere, or in unique keys only."""
        if c.type not in TEXT or not kind.startswith(("char", "varchar", "text")):
            return None
        rule, schema = self.rules["collation"], self.schema_name(t.schema)
        unique = any(c.name in [k for k, _ in i.keys] for i in t.indexes if i.kind != "INDEX")
        wanted = rule["target"] == "ci" or rule["ci_unique"] == "ci_collation" and unique
        if wanted and c.case_insensitive and case == "keep":
            name = quoted(schema, CI_COLLATION)
            if name not in self.plan.collations:
                self.plan.collations.append(name)
            return name
        return quoted("C" if rule["target"] == "ci" else rule["target"])

    # -------------------------------------------------------------- tables

    def table(self, t: Table) -> TablePlan:
        schema, name = self.schema_name(t.schema), self.fits(self.table_name(t.full, t.name), t.full)
        cols = self.columns[t.full.lower()]
        new = {p.source.name: p.name for p in cols}
        pk = t.primary_key
        plan = TablePlan(t, schema, name, tuple(cols), None, ())
        if pk is None:
            self.issue(WARN, t.full, "no primary key: changes are not applied, the table is copied again at the switch")
        else:
            plan = replace(plan, key_name=self.space(schema).claim(self.cased(pk.name), name), key=tuple(new[k] for k, _ in pk.keys if k in new))
        for trigger in t.triggers:
            self.issue(WARN, t.full, f"trigger {trigger} is not converted")
        for check, _ in t.checks:
            self.issue(WARN, t.full, f"check {check} is not converted")
        after = [s for i in t.indexes for s in self.index(t, plan, i, new)]
        at_switch = [s for f in t.foreign_keys if (s := self.foreign_key(t, plan, f, new))]
        return replace(plan, after_load=tuple(after), at_switch=tuple(at_switch))

    def index(self, t: Table, plan: TablePlan, i: Index, new: dict[str, str]) -> list[str]:
        """PLN6."""
        target, fold = quoted(plan.schema, plan.name), self.rules["collation"]["ci_unique"] == "lower_index"
        by_name = {c.name: c for c in t.columns}
        cols = [(by_name[k], new[k], desc) for k, desc in i.keys if k in new]
        ci = fold and i.kind != "INDEX" and any(c.case_insensitive and c.type in TEXT for c, _, _ in cols)
        part = lambda c, n: f"lower({quoted(n)})" if ci and c.case_insensitive and c.type in TEXT else quoted(n)
        keys = ", ".join(part(c, n) + (" DESC" if desc else "") for c, n, desc in cols)
        self.key_size(t, i, cols)
        if i.kind == "PRIMARY_KEY":
            if not ci:
                return []
            name = self.space(plan.schema).claim(f"{self.cased(i.name)}_ci", plan.name)
            return [f"CREATE UNIQUE INDEX {quoted(name)} ON {target} ({keys})"]
        name = quoted(self.space(plan.schema).claim(self.cased(i.name), plan.name))
        where = ""
        if i.filter:
            condition = translate_filter(i.filter, new)
            if condition is None:
                self.issue(WARN, f"{t.full}.{i.name}", f"filter is not translated, the index is left out: {i.filter}")
                return []
            where = f" WHERE {condition}"
        include = f" INCLUDE ({', '.join(quoted(new[c]) for c in i.includes if c in new)})" if i.includes else ""
        if i.kind == "INDEX":
            return [f"CREATE INDEX {name} ON {target} ({keys}){include}{where}"]
        nulls = " NULLS NOT DISTINCT" if any(c.nullable for c, _, _ in cols) and not where else ""
        if i.kind == "UNIQUE_CONSTRAINT" and not ci:
            return [f"ALTER TABLE {target} ADD CONSTRAINT {name} UNIQUE{nulls} ({', '.join(quoted(n) for _, n, _ in cols)})"]
        out = [f"CREATE UNIQUE INDEX {name} ON {target} ({keys}){include}{nulls}{where}"]
        wanted = {n for _, n, _ in cols}
        if ci and any({r for r in f.ref_columns} == {c.name for c, _, _ in cols} for o in self.chosen.values() for f in o.foreign_keys if f.ref_table.lower() == t.full.lower()):
            extra = self.space(plan.schema).claim(f"{self.cased(i.name)}_ref", plan.name)
            out.append(f"ALTER TABLE {target} ADD CONSTRAINT {quoted(extra)} UNIQUE ({', '.join(quoted(n) for n in sorted(wanted))})")
        return out

    def key_size(self, t: Table, i: Index, cols: list) -> None:
        """PLN7."""
        sizes = [most_bytes(c) if c.type in TEXT else 16 for c, _, _ in cols]
        if -1 in sizes or sum(sizes) > MOST_KEY_BYTES:
            self.issue(WARN, f"{t.full}.{i.name}", f"keys may take more than {MOST_KEY_BYTES} bytes")

    def foreign_key(self, t: Table, plan: TablePlan, f, new: dict[str, str]) -> str | None:
        """PLN8."""
        where, parent = f"{t.full}.{f.name}", self.chosen.get(f.ref_table.lower())
        if parent is None:
            self.issue(WARN, where, f"left out: {f.ref_table} is not moved")
            return None
        if f.disabled:
            self.issue(WARN, where, "left out: disabled in the source")
            return None
        if not f.trusted:
            self.issue(WARN, where, "not trusted in the source: rows may violate it")
        ref = {p.source.name: p.name for p in self.columns[parent.full.lower()]}
        name = self.space(plan.schema).claim(self.cased(f.name), plan.name)
        actions = "".join(f" ON {kind} {a}" for kind, a in (("DELETE", f.on_delete), ("UPDATE", f.on_update)) if a != "NO ACTION")
        to = quoted(self.schema_name(parent.schema), self.table_name(parent.full, parent.name))
        return (
            f"ALTER TABLE {quoted(plan.schema, plan.name)} ADD CONSTRAINT {quoted(name)} FOREIGN KEY ({', '.join(quoted(new[c]) for c in f.columns)}) "
            f"REFERENCES {to} ({', '.join(quoted(ref[c]) for c in f.ref_columns)}){actions}"
        )

    # -------------------------------------------------------------- notes

    def typos(self) -> None:
        """PLN13: rules for tables and columns that don't exist."""
        known = {t.full.lower(): t for t in self.catalog.tables}
        for full, rule in self.rules["tables"].items():
            t = known.get(full.lower())
            if t is None:
                self.issue(WARN, f"rule tables.{full}", "no such table")
                continue
            for c in (rule or {}).get("columns") or {}:
                if t.column(c) is None:
                    self.issue(WARN, f"rule tables.{full}.columns.{c}", "no such column")

    def behaviour(self, chosen: list[Table]) -> None:
        text = [c for t in chosen for c in t.columns if c.type in TEXT]
        for n, what in (
            (sum(c.case_insensitive for c in text), "text columns compare without case in the source but with case in the target"),
            (sum(c.type in ("varchar", "nvarchar") for c in text), "text columns whose trailing spaces the source ignores in comparisons"),
            (sum(c.type in ("char", "varchar", "text") and (c.code_page or 65001) != 65001 for c in text), "text columns in a code page take more bytes in UTF-8"),
        ):
            if n:
                self.issue(NOTE, "behaviour", f"{n} {what}")


def plan(catalog: Catalog, rules: dict, include: Iterable[str] = (), exclude: Iterable[str] = (), scan: dict | None = None) -> SchemaPlan:
    """``scan`` maps table to column to (NUL rows, sentinel rows)."""
    return _Planner(catalog, rules, include, exclude, scan).run()
