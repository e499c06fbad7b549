"""The change log: deduplication, order, netting, application."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.operators import changes as ch
from concordia.operators import views
from concordia.queries.base import LOG_SQL, LSN_SQL, change_log, rows, rows_sql, table

_TABLES = "('DBO.Users', 'LOADED', true), ('dbo.people', 'PLANNED', true), ('dbo.nokey', 'LOADED', false)"
_TABLE_NAMES = "src_table, status, has_pk"
_POSITION = "commit_lsn, change_lsn, event_serial_no"


def _tables(spark):
    return rows(spark, _TABLE_NAMES, _TABLES)


def _twice(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return ch.distinct_events(log.unionByName(log.where("event_id % 3 = 0"))).select("commit_lsn", "op", "table_name")


def _applied(spark, sf_dir):
    log = change_log(spark, sf_dir)
    applied = ch.batch_positions(log.where("event_id < 4000 AND table_name = 'dbo.users'")).withColumn("table_name", F.upper("table_name"))
    return ch.not_applied(log, applied).select("commit_lsn", "table_name")


def _head(spark, sf_dir):
    return ch.batch_head(ch.loaded_only(change_log(spark, sf_dir), _tables(spark))).select("commit_lsn", "op")


def _unpacked(net):
    return net.select(F.col("user_id").cast("bigint").alias("user_id"), "op", F.col("epoch").cast("bigint").alias("epoch"), F.col("value.v").alias("value"), F.col("props.v").alias("props"))


def _net(spark, sf_dir):
    return _unpacked(ch.net_effect(change_log(spark, sf_dir), ["user_id"], ["value", "props"]))


def _carry(spark, sf_dir):
    steps = ch.with_epochs(ch.split_key_changes(change_log(spark, sf_dir), ["user_id"]), ["key_user_id"])
    return steps.select("event_id", F.col("key_user_id").cast("bigint").alias("user_id"), F.col("epoch").cast("bigint").alias("epoch"), ch.carried(steps, ["key_user_id"], "props")["v"].alias("props"))


def _moves(spark, sf_dir):
    """Events whose views give a user the next number: the old key goes, the new one comes."""
    e = table(spark, sf_dir, "events")
    kind, cell = F.col("event_type"), lambda c: F.struct(c.cast("string").alias("v"), F.lit(False).alias("unavailable"))
    now = F.when(kind == "view", F.col("user_id") + 1).otherwise(F.col("user_id"))
    at = lsn.of_number(F.col("event_id"))
    events = e.select(
        at.alias("commit_lsn"), at.alias("change_lsn"), F.lit(1).cast("bigint").alias("event_serial_no"), F.when(kind == "signup", "c").when(kind == "error", "d").otherwise("u").alias("op"),
        F.when(kind != "signup", F.create_map(F.lit("k"), cell(F.col("user_id")))).alias("before"), F.when(kind != "error", F.create_map(F.lit("k"), cell(now), F.lit("v"), cell(F.col("props")))).alias("after"),
    )
    return ch.net_effect(events, ["k"], ["v"]).select("k", "op", F.col("v.v").alias("v"))


_MOVED = """(SELECT event_id, 0 AS sub, user_id AS k, 'd' AS op, NULL AS v FROM events WHERE event_type IN ('view', 'error')
 UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'view' THEN user_id + 1 ELSE user_id END, 'u', props FROM events WHERE event_type <> 'error')"""


def _snapshot(spark, sf_dir):
    """A target that holds some users, after the whole log."""
    log = change_log(spark, sf_dir)
    old = log.select(F.element_at("before", "user_id")["v"].cast("bigint").alias("user_id")).where("user_id IS NOT NULL").distinct().where("user_id % 2 = 0")
    target = old.select("user_id", F.lit("0.5000000000").alias("value"), F.lit("old").alias("props"))
    whole = F.when(F.col("op") != "d", F.transform_values("after", lambda k, x: F.struct(F.coalesce(x["v"], F.when(x["unavailable"], "none")).alias("v"), F.lit(False).alias("unavailable"))))
    return ch.applied_to(target, ch.net_effect(log.withColumn("after", whole), ["user_id"], ["value", "props"]), ["user_id"])


def _faults(spark, sf_dir):
    log = change_log(spark, sf_dir)
    bad = log.withColumn("op", F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("op"))).withColumn("before", F.when(F.col("event_id") % 3 != 0, F.col("before")))
    return ch.faults(bad, ["user_id"], ["props"]).select("event_id", "reason")


def _as_of(spark, sf_dir):
    """The commit time that held at the position of every order."""
    times = change_log(spark, sf_dir).select(F.col("commit_lsn").alias("lsn"), F.col("src_commit_at").alias("commit_at"))
    return views.as_of(table(spark, sf_dir, "orders").select(lsn.of_number(F.col("o_orderkey")).alias("probe")), times, "probe")


def _lag(spark, sf_dir):
    """Users as jobs: the source's newest event, the last applied one, pending errors, the last scan."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    of = e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.max("ts").alias("src_max_at"), F.max(F.when(kind == "signup", F.col("ts"))).alias("applied_at"), F.count_if(kind == "error").alias("pending"), F.max(F.when(kind == "view", F.col("ts"))).alias("last_scan")
    )
    now = e.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1))  # a row
    return views.lag_view(of.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one"))


_JOBS_SQL = """(SELECT user_id AS job_id, max(ts) AS src_max_at, max(ts) FILTER (event_type = 'signup') AS applied_at, count(*) FILTER (event_type = 'error') AS pending, max(ts) FILTER (event_type = 'view') AS last_scan,
 (SELECT max(ts) FROM events) AS now FROM events GROUP BY 1)"""

_EPOCHS = f"(SELECT *, sum(CASE WHEN op = 'd' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {_POSITION}) AS epoch FROM {LOG_SQL})"
_CARRIED = f"""(SELECT *, last_value(CASE WHEN op <> 'd' AND NOT gone THEN {{v: props}} END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY {_POSITION}) AS p,
 last_value(CASE WHEN op <> 'd' THEN {{v: value}} END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY {_POSITION}) AS val FROM {_EPOCHS})"""
_NET = f"(SELECT user_id, CASE WHEN op = 'd' THEN 'd' ELSE 'u' END AS op, epoch, val, p, row_number() OVER (PARTITION BY user_id ORDER BY commit_lsn DESC) AS r FROM {_CARRIED})"
_VALUE = "CAST(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,10)) AS VARCHAR)"

QUERIES = {
    "str2_distinct_events": (_twice, f"SELECT commit_lsn, op, table_name FROM {LOG_SQL}"),
    "join4_not_applied": (
        _applied,
        f"""SELECT commit_lsn, table_name FROM {LOG_SQL} WHERE table_name <> 'dbo.users' OR commit_lsn > (SELECT max({LSN_SQL}) FROM events WHERE event_id < 4000 AND event_id % 2 = 0)""",
    ),
    "join3_loaded_only": (lambda s, d: ch.loaded_only(change_log(s, d), _tables(s)).select("commit_lsn", "op"), f"SELECT commit_lsn, op FROM {LOG_SQL} WHERE lower(table_name) = 'dbo.users'"),
    "join5_waiting": (lambda s, d: ch.waiting(change_log(s, d), _tables(s)).select("commit_lsn", "op"), f"SELECT commit_lsn, op FROM {LOG_SQL} WHERE lower(table_name) NOT IN ('dbo.users', 'dbo.nokey')"),
    "srt1_batch_head": (_head, f"SELECT commit_lsn, op FROM {LOG_SQL} WHERE lower(table_name) = 'dbo.users' ORDER BY {_POSITION} LIMIT 1000"),
    "agg14_batch_positions": (
        lambda s, d: ch.batch_positions(change_log(s, d)),
        f"SELECT table_name, max(commit_lsn) AS commit_lsn, max(change_lsn) AS change_lsn, max(event_serial_no) AS event_serial_no, count(*) AS n FROM {LOG_SQL} GROUP BY table_name",
    ),
    "win3_carried_values": (_carry, f"SELECT event_id, user_id, CAST(epoch AS BIGINT) AS epoch, p.v AS props FROM {_CARRIED}"),
    "win4_net_effect": (
        _net,
        f"""SELECT user_id, op, CAST(epoch AS BIGINT) AS epoch, {_VALUE.replace("value", "val.v", 1)} AS value, p.v AS props FROM {_NET} WHERE r = 1""",
    ),
    "mut3_key_changes": (
        _moves,
        f"SELECT CAST(k AS VARCHAR) AS k, arg_max(op, 2 * event_id + sub) AS op, arg_max({{v: v}}, 2 * event_id + sub).v AS v FROM {_MOVED} GROUP BY k",
    ),
    "mut1_snapshot": (
        _snapshot,
        f"""WITH log AS {LOG_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_lsn DESC) AS r FROM log),
        old AS (SELECT DISTINCT user_id FROM log WHERE op <> 'c' AND user_id % 2 = 0)
        SELECT user_id, {_VALUE} AS value, CASE WHEN gone THEN 'none' ELSE props END AS props FROM last WHERE r = 1 AND op <> 'd'
        UNION ALL SELECT user_id, '0.5000000000', 'old' FROM old WHERE user_id NOT IN (SELECT user_id FROM log)""",
    ),
    "mut6_faults": (
        _faults,
        f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown op' ELSE 'delete without key' END AS reason FROM {LOG_SQL} WHERE event_id % 11 = 0 OR op = 'd' AND event_id % 3 = 0""",
    ),
    "join7_as_of": (
        _as_of,
        f"""WITH log AS {LOG_SQL} SELECT p.probe, t.src_commit_at AS commit_at FROM (SELECT lower(lpad(to_hex(o_orderkey), 8, '0')) || ':00000000:0001' AS probe FROM orders) p
        ASOF LEFT JOIN log t ON p.probe >= t.commit_lsn""",
    ),
    "msc4_lag": (
        _lag,
        f"""SELECT job_id, CAST(CASE WHEN lag IS NOT NULL AND still > 15 THEN greatest(lag, still) ELSE lag END AS DECIMAL(12,3)) AS lag_seconds FROM
        (SELECT job_id, CASE WHEN src_max_at IS NOT NULL AND b IS NOT NULL THEN CAST(greatest(epoch_us(src_max_at) - epoch_us(b), 0) / 1e6 AS DECIMAL(12,3)) END AS lag, CAST((epoch_us(now) - epoch_us(last_scan)) / 1e6 AS DECIMAL(12,3)) AS still FROM
        (SELECT *, CASE WHEN pending = 0 THEN src_max_at ELSE applied_at END AS b FROM {_JOBS_SQL}))""",
    ),
    "agg9_log_edges": (
        lambda s, d: change_log(s, d).agg(F.max("commit_lsn").alias("last"), F.min("commit_lsn").alias("first"), F.max("src_commit_at").alias("last_at")),
        f"SELECT max(commit_lsn) AS last, min(commit_lsn) AS first, max(src_commit_at) AS last_at FROM {LOG_SQL}",
    ),
}
