"""Job state, verification results, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.operators import sequences, views
from concordia.queries.base import LOG_SQL, change_log, rows, rows_sql, table

_JOBS = "(1, 'SYNCING'), (2, 'PLANNED')"
_JOB_TABLES = "(1, 10, 'dbo.Users', 'LOADED'), (1, 11, 'dbo.people', 'LOADING'), (1, 12, 'dbo.empty', 'LOADED')"
_CHUNKS = "(10, 0, 'DONE', 500), (10, 1, 'DONE', 300), (11, 0, 'DONE', 10), (11, 1, 'FAILED', NULL), (11, 2, 'PENDING', NULL)"
def _progress(spark, sf_dir):
    tables = rows(spark, "job_id, job_table_id, src_table, table_status", _JOB_TABLES)
    return views.job_progress(rows(spark, "job_id, job_status", _JOBS), tables, rows(spark, "job_table_id, chunk_no, status, row_count", _CHUNKS), change_log(spark, sf_dir))


def _rollup(spark, sf_dir):
    """Lines as checks: a line number is a run, a supplier a table; returned lines are mismatches, and row differences too."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    error = F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.09), "timeout")
    results = lines.select(F.col("l_linenumber").alias("run_id"), F.col("l_suppkey").alias("job_table_id"), F.col("l_linestatus").alias("check_kind"), (F.col("l_returnflag") != "R").alias("matched"), error.alias("error"))
    tables = supplier.select(F.col("s_suppkey").alias("job_table_id"), F.col("s_name").alias("src_table"))
    gone = lines.where("l_returnflag = 'R'").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return views.verify_rollup(results, tables, gone.select(F.col("l_linenumber").alias("run_id"), F.col("s_name").alias("table_name"), F.col("l_orderkey").alias("pk"), F.lit("diff").alias("side")))


def _runs(spark, sf_dir):
    return views.latest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status")), ["job_id"], "run_id")


def _sequences(spark, sf_dir):
    """A sequence per customer: some never used, some falling; its column's values are the keys of the customer's orders."""
    k = F.col("c_custkey")
    step = F.when(k % 5 == 0, -1).otherwise(F.col("c_nationkey") % 3 + 1).cast("bigint")
    ends = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("hi"), F.min("o_orderkey").alias("lo"))
    rows_ = table(spark, sf_dir, "customer").join(ends, k == F.col("o_custkey"), "left")
    return rows_.select(F.col("c_name").alias("sequence"), F.when(k % 3 != 0, k * 8).alias("last"), (F.col("c_nationkey") + 1).cast("bigint").alias("seed"), step.alias("increment"), F.when(step > 0, F.col("hi")).otherwise(F.col("lo")).alias("target_end"))


def _next(spark, sf_dir):
    return _sequences(spark, sf_dir).select("sequence", sequences.next_value(F.col("last"), F.col("seed"), F.col("increment"), F.col("target_end")).cast("bigint").alias("next_value"))


def _set(spark, sf_dir):
    """The chosen values of customers of even nations, set over a state of the first half of all."""
    customer = table(spark, sf_dir, "customer")
    state = customer.where("c_nationkey < 13").select(F.col("c_name").alias("sequence"), F.col("c_custkey").alias("value"), F.lit(True).alias("is_called"))
    even = customer.where("c_nationkey % 2 = 0").select(F.col("c_name").alias("sequence"))
    return sequences.set_values(state, _next(spark, sf_dir).join(even, "sequence", "left_semi"))


_NEXT = """(SELECT *, CASE WHEN te IS NOT NULL AND (CASE WHEN step > 0 THEN te >= base ELSE te <= base END) THEN te + step ELSE base END AS next_value FROM
 (SELECT *, CASE WHEN step > 0 THEN hi ELSE lo END AS te, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_custkey * 8 + step END AS base FROM
 (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey % 3 + 1 END AS step FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS hi, min(o_orderkey) AS lo FROM orders GROUP BY 1) ON c_custkey = o_custkey)))"""

QUERIES = {
    "join9_job_progress": (
        _progress,
        f"""WITH c AS (SELECT job_table_id, count(*) AS chunks, count(*) FILTER (status = 'DONE') AS done, count(*) FILTER (status = 'FAILED') AS failed, sum(row_count) FILTER (status = 'DONE') AS rows
          FROM {rows_sql("job_table_id, chunk_no, status, row_count", _CHUNKS)} GROUP BY 1),
        p AS (SELECT lower(table_name) AS t, count(*) AS pending, min(commit_lsn) AS first_pending FROM {LOG_SQL} GROUP BY 1)
        SELECT j.job_id, t.job_table_id, src_table, table_status AS status, coalesce(chunks, 0) AS chunks, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, CAST(coalesce(rows, 0) AS BIGINT) AS rows,
          coalesce(pending, 0) AS pending, first_pending
        FROM {rows_sql("job_id, job_status", _JOBS)} j LEFT JOIN {rows_sql("job_id, job_table_id, src_table, table_status", _JOB_TABLES)} t ON j.job_id = t.job_id
        LEFT JOIN c ON c.job_table_id = t.job_table_id LEFT JOIN p ON p.t = lower(src_table)""",
    ),
    "join8_verify_rollup": (
        _rollup,
        """SELECT l_linenumber AS run_id, s_name AS src_table, count(*) AS checks, CAST(count(*) FILTER (l_returnflag = 'R') + max(CASE WHEN l_linestatus = 'F' AND l_discount > 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS mismatches,
        count(*) FILTER (l_returnflag = 'R') AS row_diffs FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    ),
    "srt2_latest_run": (_runs, "SELECT o_custkey AS job_id, max(o_orderkey) AS run_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1"),
    "srt3_recent_events": (lambda s, d: views.recent(table(s, d, "events")).select("event_id", "event_type"), "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 15"),
    "msc6_next_values": (_next, f"SELECT c_name AS sequence, CAST(next_value AS BIGINT) AS next_value FROM {_NEXT}"),
    "agg10_target_end_orders": (
        lambda s, d: sequences.target_ends(table(s, d, "orders"), "o_orderkey").unionByName(sequences.target_ends(table(s, d, "orders"), "o_orderkey", -1)),
        "SELECT max(o_orderkey) AS target_end FROM orders UNION ALL SELECT min(o_orderkey) FROM orders",
    ),
    "mut10_set_values": (
        _set,
        f"""SELECT c_name AS sequence, CAST(CASE WHEN c_nationkey % 2 = 0 THEN next_value ELSE c_custkey END AS BIGINT) AS value, c_nationkey % 2 <> 0 AS is_called FROM {_NEXT} WHERE c_nationkey % 2 = 0 OR c_nationkey < 13""",
    ),
}
