"""Row fingerprints (HSH1-HSH3): order-free sums of them compare two copies without moving rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TEXT = "\\N"


def row_text(parts: list[Column], exact: bool = False) -> Column:
    """HSH1.  Neither the separator nor the null text is escaped, so ``('a|b','c')`` and ``('a','b|c')`` agree;
    ``exact`` puts each part's length before it instead, which no two rows share."""
    if exact:
        return F.concat_ws("|", *[F.when(p.isNull(), "-").otherwise(F.concat(F.length(p).cast("string"), F.lit(":"), p)) for p in parts])
    return F.concat_ws("|", *[F.coalesce(p, F.lit(NULL_TEXT)) for p in parts])


def row_hash(text: Column) -> Column:
    """HSH2: the first 8 bytes of MD5 as a signed bigint."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(16)), 16, -10).cast("bigint")


def bucket(key_text: Column) -> Column:
    """HSH3: 0 to 65535 from the first 2 bytes of MD5."""
    return F.conv(F.substr(F.md5(key_text), F.lit(1), F.lit(4)), 16, 10).cast("int")


def wide_sum(c: Column) -> Column:
    """The exact sum of a bigint column as decimal(38,0); null over no rows.

    Adding decimals of that size row by row is what costs in a summary.  A value is split into
    20 and twice 22 bits instead, whose sums stay within bigint for 2**41 rows, and the three sums are put
    together once.
    """
    low = (1 << 22) - 1
    parts = (F.shiftright(c, 44), F.shiftright(c, 22).bitwiseAND(F.lit(low).cast("bigint")), c.bitwiseAND(F.lit(low).cast("bigint")))
    a, b, z = (F.sum(p).cast("decimal(20,0)") for p in parts)
    return (a * F.lit(1 << 44).cast("decimal(14,0)") + b * F.lit(1 << 22).cast("decimal(7,0)") + z).cast("decimal(38,0)")


def hash_sum(h: Column) -> Column:
    """Sums of bigints overflow; this one doesn't."""
    return wide_sum(h)
