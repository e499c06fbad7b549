"""Canonical text of a value by source type (NRM1-NRM17); NULL stays NULL.

The source side applies the copy's value rules first, the target side holds their results already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.values import ValueRule, sentinel_text, text_rules

_INTS = ("bigint", "int", "smallint", "tinyint")
_FORMATS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm:ss.SSS", "smalldatetime": "yyyy-MM-dd HH:mm:ss", "datetime2": "yyyy-MM-dd HH:mm:ss.SSSSSS", "datetimeoffset": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
_MONEY = {"money": "decimal(19,4)", "smallmoney": "decimal(10,4)"}

#: The types that have a canonical text.
TYPES = (
    "bigint int smallint tinyint bit decimal numeric money smallmoney float real date time datetime smalldatetime datetime2 datetimeoffset "
    "char nchar varchar nvarchar sysname text ntext binary varbinary image rowversion uniqueidentifier xml"
).split()


def canonical(c: Column, source_type: str, rule: ValueRule | None = None, source_side: bool = True) -> Column:
    kind = source_type.lower()
    own = rule if rule is not None and source_side else None
    if kind in ("char", "nchar"):
        return F.rtrim(text_rules(c, own) if own else c)
    if kind in ("varchar", "nvarchar", "sysname", "text", "ntext", "xml"):
        return text_rules(c, own) if own else c
    if kind in _INTS:
        return c.cast("string")
    if kind == "bit":
        return F.when(c.cast("boolean"), "1").when(~c.cast("boolean"), "0")
    if kind in ("decimal", "numeric"):
        return c.cast("string")
    if kind in _MONEY:
        return c.cast(_MONEY[kind]).cast("string")
    if kind in ("float", "real"):
        return c.try_cast("decimal(38,10)").cast("string")
    if kind in _FORMATS:
        moment = F.to_utc_timestamp(c, F.current_timezone()) if kind == "datetimeoffset" else c  # NRM12: in any session's zone
        text = F.date_format(moment, _FORMATS[kind])
        return sentinel_text(c, text, own) if own else text
    if kind == "time":
        return c.cast("string")
    if kind == "uniqueidentifier":
        return F.lower(c.cast("string"))
    if kind in ("binary", "varbinary", "image", "rowversion"):
        return F.hex(c)
    raise ValueError(f"no canonical text for {source_type}")


def note(source_type: str) -> str | None:
    """NRM16: what a reader of a mismatch should know."""
    return "xml text may differ though the documents are equal" if source_type == "xml" else None


def sum_scale(source_type: str, scale: int = 0) -> int | None:
    """AGG2: the scale a column is summed with; None if it is not summed."""
    kind = source_type.lower()
    if kind in _INTS:
        return 0
    if kind in _MONEY:
        return 4
    return scale if kind in ("decimal", "numeric") else None
