"""Catalog tables put together and counted (SRC1-SRC6, JOIN10, JOIN12, SET1, SET4, FIL2, AGG11, AGG13, AGG15, PRJ1, PRJ2)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like(pattern: str) -> str:
    """A wildcard pattern (``*``, ``?``) as a regular expression for the whole name, without case."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in pattern) + "$"


def selected(name: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """FIL2: matched by any of ``include`` (none given: all), then by none of ``exclude``."""
    cond = F.lit(not include)
    for p in include:
        cond = cond | name.rlike(like(p))
    for p in exclude:
        cond = cond & ~name.rlike(like(p))
    return cond


def indexes(index: DataFrame, index_columns: DataFrame) -> DataFrame:
    """SRC3, SRC6: one row per index with its ordered keys and includes."""
    cols = index_columns.groupBy("object_id", "index_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("key_ordinal") > 0, F.struct("key_ordinal", "column", "descending")))).alias("k"),
        F.sort_array(F.collect_list(F.when(F.col("key_ordinal") == 0, F.struct("ordinal", "column")))).alias("i"),
    )
    rows = index.join(cols, ["object_id", "index_id"], "left")
    key = F.transform("k", lambda x: F.concat(x["column"], F.when(x["descending"], " DESC").otherwise("")))
    return rows.select(*index.columns, F.array_join(key, ",").alias("keys"), F.array_join(F.transform("i", lambda x: x["column"]), ",").alias("includes"))


def columns(cols: DataFrame, types: DataFrame, identity: DataFrame, computed: DataFrame, defaults: DataFrame) -> DataFrame:
    """SRC2, JOIN10: columns with type, identity, computed text and default."""
    rows = cols.join(types, "type_id").join(identity, ["object_id", "column_id"], "left").join(computed, ["object_id", "column_id"], "left")
    return rows.join(defaults, ["object_id", "column_id"], "left")


def foreign_keys(fk: DataFrame, fk_columns: DataFrame) -> DataFrame:
    """SRC4: one row per foreign key with both column lists in order."""
    cols = fk_columns.groupBy("fk_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column", "ref_column"))).alias("c"))
    rows = fk.join(cols, "fk_id")
    return rows.select(*fk.columns, F.array_join(F.transform("c", lambda x: x["column"]), ",").alias("columns"), F.array_join(F.transform("c", lambda x: x["ref_column"]), ",").alias("ref_columns"))


def other_objects(objects: DataFrame, table_types: DataFrame) -> DataFrame:
    """SRC5, SET1, AGG15: objects that are only listed, by type."""
    every = objects.select("type", "name").unionByName(table_types.select(F.lit("TABLE_TYPE").alias("type"), "name"))
    return every.groupBy("type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


def row_estimates(tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """SRC1, AGG11: tables with the sum of their heap or clustered partitions' rows."""
    n = partitions.where("index_id IN (0, 1)").groupBy("object_id").agg(F.sum("rows").alias("rows_estimate"))
    return tables.join(n, "object_id", "left")


def not_captured(planned: DataFrame, captured: DataFrame) -> DataFrame:
    """SET4: planned tables that the log does not cover."""
    return planned.select("name").join(captured.select(F.lower("name").alias("_n")), F.lower("name") == F.col("_n"), "left_anti")


def captured_tables(changes: DataFrame) -> DataFrame:
    """SRC11: tables that the log covers, with the newest of their capture instances."""
    return changes.groupBy(F.concat_ws(".", "schema", "table").alias("name")).agg(F.max_by("instance", "start_lsn").alias("instance"), F.max("start_lsn").alias("start_lsn"))


def blocking_objects(objects: DataFrame, planned: DataFrame) -> DataFrame:
    """FIL8, SET1: enabled triggers and foreign keys on planned targets; changes must not be applied while there are any."""
    return objects.where("enabled").join(planned.select(F.lower("tgt").alias("_t")), F.lower("table_name") == F.col("_t"), "left_semi").select("kind", "table_name", "name")


def mismatched_tables(planned: DataFrame, registered: DataFrame) -> DataFrame:
    """JOIN12: tables that the plan and the job know differently."""
    p, r = planned.select("src", F.col("tgt").alias("planned")), registered.select("src", F.col("tgt").alias("registered"))
    return p.join(r, "src", "full_outer").where("planned IS DISTINCT FROM registered")


def behaviour_notes(cols: DataFrame) -> DataFrame:
    """AGG13: columns whose queries will behave differently on the target, counted."""
    ci = F.col("collation").contains("_CI_")
    is_text = F.col("type").isin("char", "varchar", "nchar", "nvarchar", "text", "ntext", "sysname")
    return cols.agg(
        F.count_if(ci).alias("case_insensitive"), F.count_if(F.col("type").isin("varchar", "nvarchar")).alias("trailing_space_kept"),
        F.count_if(F.col("type").isin("char", "varchar", "text") & ~F.coalesce(F.col("code_page"), F.lit(65001)).isin(65001)).alias("other_code_page"), F.count_if(is_text).alias("text_columns"),
    )


def load_columns(cols: DataFrame) -> DataFrame:
    """PRJ1: columns that are copied, in source order."""
    return cols.where("NOT generated").orderBy("ordinal")


def renamed(df: DataFrame, names: dict[str, str], lower: bool = True) -> DataFrame:
    """PRJ2: an explicit name wins over the case rule."""
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c.lower() if lower else c)) for c in df.columns])


def short_names(name: Column, limit: int = 63) -> Column:
    """HSH5 over a catalog's rows: names of at most ``limit`` bytes, longer ones cut between characters and ended by eight digits of their hash."""
    room = limit - 9

    def more(had: Column, ch: Column) -> Column:
        fits = ~had["full"] & (F.octet_length(F.concat(had["text"], ch)) <= room)
        return F.struct(F.when(fits, F.concat(had["text"], ch)).otherwise(had["text"]).alias("text"), (~fits).alias("full"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    cut = F.aggregate(F.split(name, ""), start, more)["text"]
    return F.when(F.octet_length(name) <= limit, name).otherwise(F.concat(cut, F.lit("_"), F.substr(F.sha2(name, 256), F.lit(1), F.lit(8))))


def safe_messages(message: Column) -> Column:
    """MSC7 over a log of errors: the first line without literals, which may be values of rows."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    line = F.substring_index(F.trim(message, blank), "\n", 1)
    return F.substr(F.regexp_replace(F.when(line == "", "failed").otherwise(line), r"""'[^']*'|"[^"]*"|=\s*\([^)]*\)""", "?"), F.lit(1), F.lit(300))


def sequence_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """PLN9 over a catalog's sequences: bounds cut to what 64 bits hold."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.greatest(wide(low), F.lit(-(1 << 63)).cast("decimal(38,0)")), F.least(wide(high), F.lit((1 << 63) - 1).cast("decimal(38,0)"))


def data_scan(df: DataFrame, text: Sequence[str], dates: Sequence[str]) -> DataFrame:
    """AGG6: NUL rows of text columns and sentinel rows of date columns, all in one pass: ``(column, nul_rows, sentinel_rows)``."""
    from concordia.functions.values import has_nul, is_sentinel

    counts = {c: F.count_if(has_nul(F.col(c))) for c in text} | {c: F.count_if(is_sentinel(F.col(c))) for c in dates}
    one = df.agg(*[v.alias(k) for k, v in counts.items()])
    each = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) if c in text else F.lit(0)).cast("bigint").alias("nul_rows"), (F.col(c) if c in dates else F.lit(0)).cast("bigint").alias("sentinel_rows")) for c in counts])
    return one.select(F.inline(each))
