"""Tables of a source: Parquet folders, or a database read by JDBC (SRC7)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from concordia.operators.chunks import range_sql
from concordia.plans.model import TablePlan


def driver_there(spark: SparkSession, name: str) -> bool:
    """Whether the JVM has a JDBC driver's class."""
    try:
        spark._jvm.java.lang.Class.forName(name)
        return True
    except Exception:
        return False


#: Settings of ours among the options of a JDBC source; the others go to Spark.
_OWN = ("quote", "isolation")


def jdbc_options(url: str, options: dict | None = None) -> dict[str, str]:
    """Spark's options for reading the database: batches of rows, predicates pushed down, and the session's isolation level.

    Spark's own ``isolationLevel`` is for writing; a level for reading is set by a statement that each
    connection begins with.  ``isolation`` is READ COMMITTED unless given.
    """
    given = options or {}
    level = given.get("isolation", "READ COMMITTED").upper()
    if not re.fullmatch("[A-Z ]+", level):
        raise ValueError("an isolation level is words")
    words = "SET ISOLATION" if url.startswith("jdbc:derby:") else "SET TRANSACTION ISOLATION LEVEL"
    return {"fetchsize": "1000", "pushDownPredicate": "true", "sessionInitStatement": f"{words} {level}"} | {k: v for k, v in given.items() if k not in _OWN}


def _checked(spark: SparkSession, options: dict) -> dict:
    if "driver" in options and not driver_there(spark, options["driver"]):
        raise ValueError(f"the JDBC driver {options['driver']} is not on the class path")
    return options


def reader(spark: SparkSession, source: str, options: dict | None = None) -> Callable[[TablePlan], DataFrame]:
    """The function from a table's plan to its rows.

    For ``jdbc:`` sources the ranges that a load asks for reach the database as predicates of its
    queries.
    """
    if not source.startswith("jdbc:"):
        return lambda t: spark.read.parquet(f"{source}/{t.source.full}")
    more = _checked(spark, jdbc_options(source, options))

    def read(t: TablePlan) -> DataFrame:
        return spark.read.format("jdbc").option("url", source).option("dbtable", _name(t.source.schema, t.source.name, options)).options(**more).load()

    return read


def _name(schema: str, table: str, options: dict | None) -> str:
    quote = (options or {}).get("quote", '"')
    return f"{quote}{schema}{quote}.{quote}{table}{quote}"


def in_ranges(spark: SparkSession, url: str, schema: str, table: str, key: Sequence[str], kinds: Sequence[str], ranges: Sequence[tuple], options: dict | None = None) -> DataFrame:
    """SRC7: a table in one read, of which each key range is a partition: as many queries at a time as there are cores.

    Each partition's query has a connection and so a snapshot of its own, at whatever level the options
    set: rows that move between ranges while others are read are set right by the changes captured
    since before the load, not by the read.
    """
    given = _checked(spark, jdbc_options(url, options))
    where = [range_sql(key, kinds, lo, hi, (options or {}).get("quote", '"')) for lo, hi in ranges]
    return spark.read.jdbc(url, _name(schema, table, options), predicates=where, properties=given)
