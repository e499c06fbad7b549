"""Source catalog and conversion plan as frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field

from concordia.functions.values import ValueRule

ERROR, WARN, NOTE = "ERROR", "WARN", "NOTE"
TEXT = frozenset("char nchar varchar nvarchar sysname text ntext".split())
NATIONAL = frozenset("nchar nvarchar ntext sysname".split())


@dataclass(frozen=True)
class Column:
    ordinal: int
    name: str
    type: str
    max_length: int = 0  # bytes; -1 is unlimited
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    collation: str | None = None
    code_page: int | None = None
    alias_type: str | None = None
    identity: tuple[int, int, int | None] | None = None  # seed, increment, last
    computed: str | None = None
    default: tuple[str, str] | None = None  # constraint name, definition

    @property
    def case_insensitive(self) -> bool:
        return "_CI_" in (self.collation or "")

    @property
    def length(self) -> int:
        """In characters; -1 is unlimited."""
        return self.max_length // 2 if self.type in NATIONAL and self.max_length > 0 else self.max_length


@dataclass(frozen=True)
class Index:
    name: str
    kind: str  # PRIMARY_KEY | UNIQUE_CONSTRAINT | UNIQUE_INDEX | INDEX
    keys: tuple[tuple[str, bool], ...]  # name, descending
    includes: tuple[str, ...] = ()
    filter: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    ref_table: str  # schema.table
    ref_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    disabled: bool = False
    trusted: bool = True


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...]
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    triggers: tuple[str, ...] = ()
    rows_estimate: int = 0

    @property
    def full(self) -> str:
        return f"{self.schema}.{self.name}"

    @property
    def primary_key(self) -> Index | None:
        return next((i for i in self.indexes if i.kind == "PRIMARY_KEY"), None)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Sequence:
    schema: str
    name: str
    type: str
    start: int
    increment: int
    minimum: int
    maximum: int
    cycling: bool = False
    current: int | None = None


@dataclass(frozen=True)
class Catalog:
    database: str
    tables: tuple[Table, ...]
    sequences: tuple[Sequence, ...] = ()
    other_objects: tuple[tuple[str, str], ...] = ()  # type, name
    collation: str = ""


@dataclass(frozen=True)
class Issue:
    level: str
    where: str
    message: str


@dataclass(frozen=True)
class ColumnPlan:
    source: Column
    name: str
    type: str
    rule: ValueRule
    check: str | None = None
    default: str | None = None
    generated: str | None = None
    identity: str | None = None
    collation: str | None = None
    comment: str | None = None

    @property
    def loaded(self) -> bool:
        return self.generated is None


@dataclass(frozen=True)
class TablePlan:
    source: Table
    schema: str
    name: str
    columns: tuple[ColumnPlan, ...]
    key_name: str | None
    key: tuple[str, ...]
    after_load: tuple[str, ...] = ()
    at_switch: tuple[str, ...] = ()

    @property
    def load_columns(self) -> list[ColumnPlan]:
        return [c for c in self.columns if c.loaded]


@dataclass
class SchemaPlan:
    tables: list[TablePlan] = field(default_factory=list)
    sequences: list[tuple[Sequence, str, str]] = field(default_factory=list)  # source, schema, name
    excluded: list[tuple[str, str]] = field(default_factory=list)
    manual: list[tuple[str, str]] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    collations: list[str] = field(default_factory=list)

    @property
    def blocked(self) -> bool:
        return any(i.level == ERROR for i in self.issues)

    def count(self, level: str) -> int:
        return sum(i.level == level for i in self.issues)
