"""Ordered, idempotent application of change events, as DataFrames (JOIN3-5, SRT1, WIN3-4, MUT1-6, AGG14, STR2-3).

An event has a position (commit_lsn, change_lsn, event_serial_no), an ``op`` (c, u, d), the images
``before`` and ``after`` as maps from column to struct<v:string, unavailable:boolean>, and the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordia.functions import lsn

POSITION = ("commit_lsn", "change_lsn", "event_serial_no")


def distinct_events(events: DataFrame, by: Sequence[str] = POSITION) -> DataFrame:
    """STR2: a re-delivered event is the same event."""
    return events.dropDuplicates(list(by))


def not_applied(events: DataFrame, applied: DataFrame, table: str = "table_name") -> DataFrame:
    """JOIN4, STR7: events after their table's applied position; a table that is not known yet keeps all.

    ``applied`` has one row per table: (table, commit_lsn, change_lsn, event_serial_no).  It is
    broadcast, since joined by the table's name all events of a table would meet in one task.
    """
    done = applied.select(F.lower(table).alias("_t"), lsn.position().alias("_at"))
    rows = events.join(F.broadcast(done), F.lower(F.col(table)) == F.col("_t"), "left")
    return rows.where(F.col("_at").isNull() | (lsn.position() > F.col("_at"))).drop("_t", "_at")


def loaded_only(events: DataFrame, tables: DataFrame, table: str = "table_name") -> DataFrame:
    """JOIN3, FIL5, FIL6: events of loaded tables with a key; names compare without case."""
    ready = tables.where("status = 'LOADED' AND has_pk").select(F.lower("src_table").alias("_t"))
    return events.join(ready, F.lower(F.col(table)) == F.col("_t"), "left_semi")


def waiting(events: DataFrame, tables: DataFrame, table: str = "table_name") -> DataFrame:
    """JOIN5: events whose table is not loaded."""
    ready = tables.where("status = 'LOADED'").select(F.lower("src_table").alias("_t"))
    return events.join(ready, F.lower(F.col(table)) == F.col("_t"), "left_anti")


def batch_head(events: DataFrame, size: int = 1000) -> DataFrame:
    """SRT1: the first events in log order; a top-k, so no full sort."""
    return events.orderBy(*POSITION).limit(size)


def batch_positions(batch: DataFrame, table: str = "table_name", at: str | None = None) -> DataFrame:
    """AGG14: last position and number of events per table, and with ``at`` the last commit time as text."""
    more = [F.max(at).cast("string").alias("at")] if at else []
    last = batch.groupBy(table).agg(F.max(lsn.position()).alias("p"), F.count("*").alias("n"), *more)
    return last.select(table, "p.*", "n", *(["at"] if at else []))


def split_key_changes(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """MUT3: an update that changes the key deletes the old key first, then adds the new one.

    Adds ``sub`` (order within the event) and the columns ``key_<k>``; ``op`` is d or u afterwards.
    """
    image = lambda which, k: F.col(which)[F.lit(k)]["v"]
    moved = F.lit(False)
    for k in key:
        moved = moved | ~image("before", k).eqNullSafe(image("after", k))
    moved = (F.col("op") == "u") & F.col("before").isNotNull() & moved
    delete, put = F.struct(F.lit(0).alias("sub"), F.lit("d").alias("op2"), F.lit("before").alias("side")), F.struct(F.lit(1).alias("sub"), F.lit("u").alias("op2"), F.lit("after").alias("side"))
    steps = F.when(moved, F.array(delete, put)).when(F.col("op") == "d", F.array(delete)).otherwise(F.array(put))
    rows = events.withColumn("_s", F.explode(steps))
    keys = {f"key_{k}": F.when(F.col("_s.side") == "before", image("before", k)).otherwise(image("after", k)) for k in key}
    return rows.withColumns(keys | {"sub": F.col("_s.sub"), "op": F.col("_s.op2")}).drop("_s")


def faults(events: DataFrame, key: Sequence[str], nul_columns: Sequence[str] = ()) -> DataFrame:
    """MUT2, MUT6, SRC9: events that must fail their whole batch, with the reason; judged before any netting."""
    image = lambda which, k: F.col(which)[F.lit(k)]["v"]
    missing = lambda which: F.col(which).isNull() | F.array_contains(F.array(*[image(which, k).isNull() for k in key]), True)
    nul = F.lit(False)
    for c in nul_columns:
        nul = nul | F.coalesce(F.contains(image("after", c), F.lit("\x00")), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("op").isin("c", "u", "d"), F.lit(False)), "unknown op")
        .when((F.col("op") == "d") & missing("before"), "delete without key")
        .when((F.col("op") != "d") & missing("after"), "change without key")
        .when(nul, "NUL character")
    )
    return events.withColumn("reason", reason).where("reason IS NOT NULL")


def with_epochs(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Numbers the lives of a key: an image must not take values from before a delete."""
    order = W.partitionBy(*key).orderBy(*POSITION, "sub").rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("epoch", F.sum(F.when(F.col("op") == "d", 1).otherwise(0)).over(order))


def carried(events: DataFrame, key: Sequence[str], column: str) -> Column:
    """WIN3, MUT4: the last available value of a column in the key's present life, as struct<v> (null: none in the batch)."""
    order = W.partitionBy(*key, "epoch").orderBy(*POSITION, "sub").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = F.col("after")[F.lit(column)]
    there = (F.col("op") != "d") & got.isNotNull() & ~F.coalesce(got["unavailable"], F.lit(False))
    return F.last(F.when(there, F.struct(got["v"].alias("v"))), ignorenulls=True).over(order)


def net_effect(events: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """WIN4: the last step per key: key columns, ``op``, ``epoch`` and each column as struct<v> or null if unavailable throughout.

    Values are taken out of the images first, so that one exchange and one sort of short rows do.  A
    delete counts as a step that takes each value away, which ends what a life carries (``carried``).
    """
    keys = [f"key_{k}" for k in key]
    steps, gone = split_key_changes(events, key), F.col("op") == "d"

    def value(c: str) -> Column:
        got = F.col("after")[F.lit(c)]
        there = got.isNotNull() & ~F.coalesce(got["unavailable"], F.lit(False))
        none = F.lit(None).cast("string")
        return F.when(gone, F.struct(none.alias("v"), F.lit(False).alias("there"))).when(there, F.struct(got["v"].alias("v"), F.lit(True).alias("there")))

    steps = steps.select(*keys, *POSITION, "sub", "op", *[value(c).alias(f"c_{c}") for c in columns])
    order = W.partitionBy(*keys).orderBy(*POSITION, "sub")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = {"epoch": F.sum(F.when(gone, 1).otherwise(0)).over(so_far), "_last": F.lead(F.lit(1)).over(order).isNull()}
    steps = steps.withColumns(seen | {f"c_{c}": F.last(f"c_{c}", ignorenulls=True).over(so_far) for c in columns}).where("_last")
    held = lambda c: F.when(F.col(c)["there"], F.struct(F.col(c)["v"].alias("v")))
    return steps.select(*[F.col(a).alias(k) for a, k in zip(keys, key, strict=True)], "op", "epoch", *[held(f"c_{c}").alias(c) for c in columns])


def applied_to(target: DataFrame, net: DataFrame, key: Sequence[str]) -> DataFrame:
    """MUT1, MUT2, MUT4: the target after the batch, by copy on write: untouched rows and the new images.

    An image without a value for a column takes it from the target's row, in a key's first life
    only; where there is none, the batch fails and names the column.
    """
    rest = [c for c in target.columns if c not in key]
    new = net.select(*[F.col(k).cast(target.schema[k].dataType).alias(f"_key_{k}") for k in key], F.col("op").alias("_op"), F.col("epoch").alias("_epoch"), *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_changed"))
    old = target.select("*", F.lit(True).alias("_there"))
    same = [F.col(k) == F.col(f"_key_{k}") for k in key]
    rows = old.join(new, same, "full").where("_changed IS NULL OR _op <> 'd'")  # in one join, so that each side is read and moved once
    value = {k: F.when(F.col("_changed").isNull(), F.col(k)).otherwise(F.col(f"_key_{k}")) for k in key}
    for c in rest:
        got, kind = F.col(f"_new_{c}"), target.schema[c].dataType
        none = F.raise_error(F.concat(F.lit(f"no value for column {c} of a changed row")))
        value[c] = F.when(F.col("_changed").isNull(), F.col(c)).when(got.isNotNull(), got["v"].cast(kind)).when((F.col("_epoch") == 0) & F.col("_there"), F.col(c)).otherwise(none.cast(kind))
    return rows.select(*[value[c].alias(c) for c in target.columns])
