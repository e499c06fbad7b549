"""Constraints as queries for what violates them (PLN6-PLN8, FIL7, JOIN11, MUT9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(df: DataFrame, c: str) -> Column:
    """A text column byte by byte, whatever its collation."""
    return F.collate(c, "UTF8_BINARY") if collation_of(df, c) else F.col(c)


def collation_of(df: DataFrame, c: str) -> str | None:
    kind = df.schema[c].dataType
    name = getattr(kind, "collation", None)
    return None if name in (None, "UTF8_BINARY") else name


def duplicates(df: DataFrame, key: Sequence[str], fold: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """PLN6: keys held by several rows; texts compare by their columns' collations, parts in ``fold`` in lower case, nulls are one value, ``where`` is a filtered index.

    Of texts that are one key, the first byte by byte is shown.
    """
    rows = df if where is None else df.where(where)
    parts = [(F.lower(k) if k in fold else F.col(k)).alias(f"_k{i}") for i, k in enumerate(key)]
    shown = [F.min(_plain(df, k)).alias(k) if collation_of(df, k) else F.first(f"_k{i}").alias(k) for i, k in enumerate(key)]
    return rows.select("*", *parts).groupBy(*[f"_k{i}" for i in range(len(key))]).agg(*shown, F.count("*").alias("n")).where("n > 1").select(*key, "n")


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """JOIN11, PLN8: child rows with a complete key that no parent has; where one side's text has a collation, both compare by it."""
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(on)])

    def same(i: int, c: str, p: str) -> Column:
        name = collation_of(child, c) or collation_of(parent, p)
        return F.collate(c, name) == F.collate(f"_p{i}", name) if name else F.col(c) == F.col(f"_p{i}")

    cond = [same(i, c, p) for i, (c, p) in enumerate(on)]
    complete = F.lit(True)
    for c, _ in on:
        complete = complete & F.col(c).isNotNull()
    return child.where(complete).join(keys, cond, "left_anti")


def outside(df: DataFrame, column: str, low: int = 0, high: int = 255) -> DataFrame:
    """FIL7: rows that a range check refuses; null passes."""
    return df.where(~F.col(column).between(low, high))


def wide_keys(df: DataFrame, key: Sequence[str], most: int = 2700) -> DataFrame:
    """PLN7 on data: keys whose text takes more bytes than an index entry may."""
    size = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in key), F.lit(0))
    return df.select(*key, size.alias("key_bytes")).where(F.col("key_bytes") > most)


def probe(target: DataFrame, changes: dict[str, Column], key: str, step: int = 1_000_000) -> DataFrame:
    """MUT9: the row that a test insert would add: a copy of one row with a fresh key and ``changes``; nothing is written."""
    one = target.orderBy(key).limit(1)
    fresh = target.agg(F.max(key).alias("_m"))
    row = one.withColumn("_one", F.lit(1)).join(fresh.withColumn("_one", F.lit(1)), "_one")
    row = row.withColumn(key, (F.col("_m") + step).cast(target.schema[key].dataType))
    return row.withColumns(changes).select(*target.columns) if changes else row.select(*target.columns)
