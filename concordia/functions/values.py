"""Value rules of a copy (VAL1-VAL11), all built-in expressions.

Text rules apply in the order NUL, trailing space, case.  Sub-microsecond rounding works on the
text of a value, before any cast, since a cast would truncate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates that stand for "none" in sources.
SENTINELS = ("1753-01-01", "1900-01-01", "9999-12-31")
TEXT_TYPES = frozenset("char nchar varchar nvarchar sysname text ntext xml".split())
DATE_TYPES = frozenset("date datetime smalldatetime datetime2 datetimeoffset".split())


@dataclass(frozen=True)
class ValueRule:
    """What happens to one column's values on the way (VAL11 resolves it)."""

    nul_char: str = "fail"  # fail | strip | replace
    nul_replacement: str = "�"
    trailing_space: str = "keep"  # keep | rtrim
    case: str = "keep"  # keep | upper | lower
    sentinel: str = "keep"  # keep | null | infinity
    sentinels: tuple[str, ...] = SENTINELS
    round: str = "half_up"  # half_up | truncate


def has_nul(c: Column) -> Column:
    """VAL1: a value that a ``fail`` rule refuses."""
    return F.coalesce(F.contains(c, F.lit("\x00")), F.lit(False))


def text_rules(c: Column, rule: ValueRule) -> Column:
    """VAL2-VAL4."""
    if rule.nul_char == "strip":
        c = F.replace(c, F.lit("\x00"), F.lit(""))
    elif rule.nul_char == "replace":
        c = F.replace(c, F.lit("\x00"), F.lit(rule.nul_replacement))
    if rule.trailing_space == "rtrim":
        c = F.rtrim(c)  # U+0020 only
    return {"upper": F.upper, "lower": F.lower}.get(rule.case, lambda x: x)(c)


def is_sentinel(c: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    return F.coalesce(F.to_date(c).isin(*[F.lit(s).cast("date") for s in sentinels]), F.lit(False))


def sentinel_value(c: Column, rule: ValueRule) -> Column:
    """VAL5 for ``keep`` and ``null``; the type stays."""
    return F.when(~is_sentinel(c, rule.sentinels), c) if rule.sentinel == "null" else c


def sentinel_text(c: Column, text: Column, rule: ValueRule) -> Column:
    """VAL5 on the text of a value; infinity has no timestamp in Spark, so it is carried as text."""
    if rule.sentinel == "keep":
        return text
    if rule.sentinel == "null":
        return F.when(~is_sentinel(c, rule.sentinels), text)
    far = F.when(F.to_date(c) < F.lit("1970-01-01").cast("date"), "-infinity").otherwise("infinity")
    return F.when(is_sentinel(c, rule.sentinels), far).otherwise(text)


def _micros(fraction: Column, how: str) -> Column:
    """Microseconds of up to seven decimals of a second, as text without the point."""
    ticks = F.rpad(fraction, 7, "0").cast("long")
    return F.floor((ticks + (5 if how == "half_up" else 0)) / 10).cast("long")


def timestamp_of(text: Column, how: str = "half_up") -> Column:
    """VAL6: ``yyyy-MM-dd HH:mm:ss[.fffffff]`` to TIMESTAMP_NTZ, rounded to microseconds with carry."""
    base = F.to_timestamp_ntz(F.substr(text, F.lit(1), F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.timestamp_add("MICROSECOND", _micros(F.substr(text, F.lit(21)), how), base)


def time_of(text: Column, how: str = "half_up") -> Column:
    """VAL7: ``HH:mm:ss[.fffffff]`` to text with six decimals; past the last microsecond it is ``24:00:00``."""
    part = lambda a: F.substr(text, F.lit(a), F.lit(2)).cast("long")
    total = (part(1) * 3600 + part(4) * 60 + part(7)) * 1_000_000 + _micros(F.substr(text, F.lit(10)), how)
    second = F.floor(total / 1_000_000)
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60, total % 1_000_000)
    return F.when(total >= 86_400_000_000, "24:00:00").otherwise(clock)


def bit_text(c: Column, target: str = "boolean") -> Column:
    """VAL8."""
    yes, no = ("t", "f") if target == "boolean" else ("1", "0")
    return F.when(c, yes).when(~c, no)


def copy_text(c: Column) -> Column:
    """VAL9: one field of a tab-separated copy line; the backslash goes first."""
    out = c
    for plain, marked in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(marked))
    return F.coalesce(out, F.lit("\\N"))


def bytes_text(c: Column) -> Column:
    """VAL10."""
    return F.concat(F.lit("\\x"), F.lower(F.hex(c)))


def resolve(source_type: str, base: ValueRule, override: dict | None = None) -> ValueRule:
    """VAL11: a column's own keys before the global ones; only text types get text rules, only dates sentinels."""
    from dataclasses import replace

    keys = {"text": ("nul_char", "nul_replacement", "trailing_space", "case"), "date": ("sentinel", "sentinels", "round")}
    wanted = [k for kind, names in keys.items() for k in names if source_type in (TEXT_TYPES if kind == "text" else DATE_TYPES | {"time"})]
    plain = ValueRule(**{k: getattr(base, k) for k in wanted})
    return replace(plain, **{k: v for k, v in (override or {}).items() if k in wanted})
