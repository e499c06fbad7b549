"""A source catalog out of its system tables (SRC1-SRC6), and probes of both ends (SRC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.plans.model import Catalog, Column, ForeignKey, Index, Sequence, Table


def assemble(database: str, columns: DataFrame, indexes: DataFrame | None = None, foreign_keys: DataFrame | None = None, sequences: DataFrame | None = None, others: DataFrame | None = None) -> Catalog:
    """SRC6: catalog rows, a few per table, grouped by Spark and read into records.

    ``columns``: schema, table and the fields of Column; ``indexes``: schema, table, name, kind,
    filter, column, descending, ordinal, included; ``foreign_keys``: schema, table, name, column,
    ref_table, ref_column, ordinal, on_delete, on_update, disabled, trusted.
    """
    fields = [c for c in columns.columns if c in Column.__dataclass_fields__]
    of_table = {}
    for r in columns.groupBy("schema", "table").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in fields if c != "ordinal"]))).alias("c")).collect():
        of_table[r["schema"], r["table"]] = tuple(Column(**{k: tuple(v) if k in ("identity", "default") and v is not None else v for k, v in x.asDict().items() if v is not None or k not in ("nullable",)}) for x in r["c"])
    idx: dict = {}
    if indexes is not None:
        grouped = indexes.groupBy("schema", "table", "name", "kind", "filter").agg(F.sort_array(F.collect_list(F.struct("included", "ordinal", "column", "descending"))).alias("c"))
        for r in grouped.orderBy("schema", "table", "name").collect():
            keys = tuple((x["column"], x["descending"]) for x in r["c"] if not x["included"])
            idx.setdefault((r["schema"], r["table"]), []).append(Index(r["name"], r["kind"], keys, tuple(x["column"] for x in r["c"] if x["included"]), r["filter"]))
    fks: dict = {}
    if foreign_keys is not None:
        grouped = foreign_keys.groupBy("schema", "table", "name", "ref_table", "on_delete", "on_update", "disabled", "trusted").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column", "ref_column"))).alias("c"))
        for r in grouped.orderBy("schema", "table", "name").collect():
            fks.setdefault((r["schema"], r["table"]), []).append(ForeignKey(r["name"], tuple(x["column"] for x in r["c"]), r["ref_table"], tuple(x["ref_column"] for x in r["c"]), r["on_delete"], r["on_update"], r["disabled"], r["trusted"]))
    tables = tuple(Table(s, t, cols, tuple(idx.get((s, t), ())), tuple(fks.get((s, t), ()))) for (s, t), cols in sorted(of_table.items()))
    seqs = tuple(Sequence(**r.asDict()) for r in sequences.collect()) if sequences is not None else ()
    other = tuple((r["type"], r["name"]) for r in others.collect()) if others is not None else ()
    return Catalog(database, tables, seqs, other)


def probe(spark: SparkSession, root: str) -> dict:
    """SRC12: what a run depends on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    warnings = []
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        warnings.append("the session's time zone is not UTC")
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        warnings.append("ANSI mode is off: casts that should fail give null")
    return {"version": spark.version, "root": root, "exists": there, "warnings": warnings}
