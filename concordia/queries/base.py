"""Test tables that the queries share, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.operators.verify import ColumnSpec, TableSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ a copy of orders that went wrong

ORDERS = TableSpec("orders", (ColumnSpec("o_orderkey", "bigint"), ColumnSpec("o_custkey", "bigint"), ColumnSpec("o_totalprice", "float")), ("o_orderkey",))
ORDERS_ALL = TableSpec(
    "orders",
    (ColumnSpec("o_orderkey", "bigint"), ColumnSpec("o_custkey", "bigint"), ColumnSpec("o_orderstatus", "char"), ColumnSpec("o_totalprice", "float"), ColumnSpec("o_orderdate", "datetime2"), ColumnSpec("o_orderpriority", "varchar")),
    ("o_orderkey",),
)


def copy_of_orders(orders: DataFrame) -> DataFrame:
    """Keys dropped where k % 97 = 0, prices raised where k % 89 = 0, rows added where k % 101 = 0."""
    k = F.col("o_orderkey")
    kept = orders.where(k % 97 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 89 == 0, 1.0).otherwise(0.0))
    return kept.unionByName(orders.where(k % 101 == 0).withColumn("o_orderkey", k + 10_000_000))


COPY_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 89 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
 UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0)"""


def hash_sql(text: str) -> str:
    u = f"CAST('0x' || md5({text})[1:16] AS UBIGINT)"
    return f"CASE WHEN {u} >= 9223372036854775808 THEN CAST({u} AS HUGEINT) - 18446744073709551616 ELSE CAST({u} AS HUGEINT) END"


def text_sql(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce({p}, '\\N')" for p in parts) + ")"


ORDERS_TEXT = text_sql("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_totalprice::VARCHAR::DECIMAL(38,10)::VARCHAR")
BUCKET_SQL = "CAST('0x' || md5(o_orderkey::VARCHAR)[1:4] AS INTEGER)"

# ------------------------------------------------------------------ a change log made of events


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per row of ``events``: key user_id, op by event_type, props unavailable in views, table by the id's parity."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    value = lambda v, gone: F.struct(v.cast("string").alias("v"), gone.alias("unavailable"))
    user = value(F.col("user_id"), F.lit(False))
    gone = F.col("event_type") == "view"
    after = F.create_map(F.lit("user_id"), user, F.lit("value"), value(F.col("value").cast("decimal(38,10)"), F.lit(False)), F.lit("props"), value(F.when(~gone, F.col("props")), gone))
    at = lsn.of_number(F.col("event_id"))
    return e.select(
        at.alias("commit_lsn"), at.alias("change_lsn"), F.lit(1).cast("bigint").alias("event_serial_no"), op.alias("op"), F.when(F.col("event_id") % 2 == 0, "dbo.users").otherwise("dbo.People").alias("table_name"),
        F.when(op != "c", F.create_map(F.lit("user_id"), user)).alias("before"), F.when(op != "d", after).alias("after"), F.col("ts").alias("src_commit_at"), F.col("event_id"),
    )


LSN_SQL = "lower(lpad(to_hex(event_id), 8, '0')) || ':00000000:0001'"
LOG_SQL = f"""(SELECT {LSN_SQL} AS commit_lsn, {LSN_SQL} AS change_lsn, 1::BIGINT AS event_serial_no,
 CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, CASE WHEN event_id % 2 = 0 THEN 'dbo.users' ELSE 'dbo.People' END AS table_name,
 user_id, value, CASE WHEN event_type <> 'view' THEN props END AS props, event_type = 'view' AS gone, ts AS src_commit_at, event_id FROM events)"""


def rows(spark: SparkSession, names: str, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def rows_sql(names: str, values: str) -> str:
    return f"(SELECT * FROM (VALUES {values}) AS t({names}))"
