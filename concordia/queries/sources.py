"""Change envelopes, log status, and what planning makes of types, filters and defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.operators import constraints, views
from concordia.plans import defaults, planner, rules
from concordia.plans.model import Column
from concordia.queries.base import table
from concordia.sources import envelope

def _events(spark, sf_dir):
    """The events as envelopes: positions in three notations, values plain, encoded or left out; and by their number some that can't be taken."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    digits = F.concat(F.lpad(F.hex(n), 8, "0"), F.lit("000000000001"))
    colons = F.concat(F.lpad(F.hex(n), 8, "0"), F.lit(":00000000:0001"))
    at = F.when(n % 3 == 0, F.concat(F.lit("0x"), digits)).when(n % 3 == 1, F.lower(colons)).otherwise(F.concat(F.lit(" "), colons, F.lit(" ")))
    coded = F.concat(F.lit('{"b64":"'), F.base64(F.encode(F.concat("props", F.chr(F.lit(0))), "utf-8")), F.lit('"}'))
    value = F.when(kind == "view", coded).when(kind == "click", F.lit('{"unavailable":true}')).otherwise(F.col("props"))
    image = F.when(n % 29 == 0, F.create_map(F.lit("id"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("v"), value))
    sort = F.when(n % 19 == 0, "HEARTBEAT").when(n % 23 == 0, "SCHEMA_CHANGE").when(n % 31 == 0, "NEWS").otherwise("CHANGE")
    op = F.when(n % 37 == 0, "x").when(kind == "signup", "c").when(kind == "error", "d").otherwise("u")
    raw = e.select(
        sort.alias("kind"), at.alias("stream_lsn"), F.lit("dbo").alias("schema"), F.when(n % 41 == 0, "Q").otherwise("T").alias("table"), op.alias("op"), F.when(n % 43 != 0, at).alias("commit_lsn"), at.alias("change_lsn"),
        F.lit(1).cast("bigint").alias("event_serial_no"), F.when(kind != "signup", F.create_map(F.lit("id"), F.col("user_id").cast("string"))).alias("before"), F.when(op != "d", image).alias("after"), F.col("ts").cast("timestamp_ntz").alias("commit_at"),
    )
    return envelope.parsed(raw)


def _parsed(spark, sf_dir):
    e = _events(spark, sf_dir).where("kind = 'CHANGE'")
    v = F.col("after")["v"]
    return e.select("stream_lsn", "commit_lsn", "change_lsn", "op", "table_name", F.hex(v["v"]).alias("v"), v["unavailable"].alias("gone"), F.col("before")["id"]["v"].alias("was"))


_AT = "lower(lpad(to_hex(event_id), 8, '0')) || ':00000000:0001'"
_ENVELOPES = f"""(SELECT *, {_AT} AS stream_lsn, CASE WHEN event_id % 43 <> 0 THEN {_AT} END AS commit_lsn, CASE WHEN event_id % 19 = 0 THEN 'HEARTBEAT' WHEN event_id % 23 = 0 THEN 'SCHEMA_CHANGE' WHEN event_id % 31 = 0 THEN 'NEWS' ELSE 'CHANGE' END AS kind,
 CASE WHEN event_id % 37 = 0 THEN 'x' WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS op, CASE WHEN event_id % 41 = 0 THEN 'dbo.Q' ELSE 'dbo.T' END AS table_name, event_id % 29 <> 0 AS has_v FROM events)"""


_TYPES = (("varchar", -1, 0, 0), ("nvarchar", 100, 0, 0), ("decimal", 9, 12, 4), ("datetime2", 8, 27, 7), ("time", 5, 16, 3), ("tinyint", 1, 3, 0), ("bit", 1, 1, 0), ("uniqueidentifier", 16, 0, 0), ("money", 8, 19, 4), ("char", 6, 0, 0), ("datetimeoffset", 10, 34, 7), ("xml", -1, 0, 0))


def _types(spark, sf_dir):
    out = []
    for t, length, p, s in _TYPES:
        c = Column(1, "c", t, length, p, s)
        target, cut = planner.target_type(c, rules.TYPES[t])
        out.append((planner.shown_type(c), target, cut, planner.spark_type(target).simpleString()))
    return spark.createDataFrame(out, "source string, target string, cut boolean, spark_type string")


_DEFAULTS = ("((0))", "(-(1))", "(N'a''b')", "(getdate())", "(NULL)", "((1)+(2))", "(NEXT VALUE FOR [dbo].[s])")


def _defaults(spark, sf_dir):
    got = [(d, defaults.translate(d, "integer", rules.FUNCTIONS, "dbo", lambda s, n: '"dbo"."s"')) for d in _DEFAULTS]
    return spark.createDataFrame([(d, t.expr, t.error is not None, t.warn is not None) for d, t in got], "definition string, expr string, refused boolean, warned boolean")


def _filtered(spark, sf_dir):
    names = {c: c for c in ("o_orderstatus", "o_totalprice", "o_custkey")}
    condition = planner.translate_filter("([o_orderstatus]=N'F' AND [o_totalprice]>(100000.0) AND [o_custkey] IS NOT NULL)", names)
    return constraints.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"], where=F.expr(condition.replace('"', "`")))


def _payloads(spark, sf_dir):
    """Event times as a payload's numbers, most of them before 1970."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - 10**15 - 10**15
    day = F.pmod(us, F.lit(86_400_000_000))
    values = {"timestamp_millis": F.floor(us / 1000), "timestamp_micros": us, "timestamp_nanos": us * 1000 + F.col("event_id") % 1000}
    e = table(spark, sf_dir, "events").select("event_id", *[v.cast("string").alias(k) for k, v in values.items()], day.cast("string").alias("clock"), F.col("user_id").cast("string").alias("n"))
    return e.select("event_id", *[F.date_format(lsn.decode(F.col(k), k), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(k) for k in values], lsn.decode(F.col("clock"), "time_micros").alias("clock"), lsn.decode(F.col("n"), "long").alias("n"))


QUERIES = {
    "src9_parsed_events": (
        _parsed,
        f"""SELECT stream_lsn, commit_lsn, stream_lsn AS change_lsn, op, table_name, CASE WHEN op <> 'd' AND has_v AND event_type <> 'click' THEN hex(encode(props || CASE WHEN event_type = 'view' THEN chr(0) ELSE '' END)) END AS v,
        CASE WHEN op <> 'd' AND has_v THEN event_type = 'click' END AS gone, CASE WHEN event_type <> 'signup' THEN user_id::VARCHAR END AS was FROM {_ENVELOPES} WHERE kind = 'CHANGE'""",
    ),
    "src9_invalid_events": (
        lambda s, d: envelope.invalid(_events(s, d), {"dbo.T": ["id", "v"]}).select("stream_lsn", "reason"),
        f"""SELECT * FROM (SELECT stream_lsn, CASE WHEN kind = 'NEWS' THEN 'unknown kind' WHEN kind = 'SCHEMA_CHANGE' THEN 'the source''s schema changed' WHEN kind = 'HEARTBEAT' THEN NULL WHEN commit_lsn IS NULL THEN 'no position'
        WHEN op = 'x' THEN 'unknown op' WHEN table_name = 'dbo.Q' THEN 'not in the plan' WHEN op <> 'd' AND NOT has_v THEN 'a planned column is absent' END AS reason FROM {_ENVELOPES}) WHERE reason IS NOT NULL""",
    ),
    "src10_log_status": (
        lambda s, d: views.log_status(table(s, d, "events").select(lsn.of_number(F.col("event_id")).alias("lsn"), F.col("ts").alias("commit_at")), table(s, d, "events").where("event_type = 'error'").select(F.col("ts").alias("ended_at"))),
        "SELECT lower(lpad(to_hex(max(event_id)), 8, '0')) || ':00000000:0001' AS max_lsn, arg_max(ts, event_id) AS max_commit_at, max(ts) FILTER (event_type = 'error') AS last_scan_at FROM events",
    ),
    "fil4_filtered_unique_orders": (_filtered, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0 GROUP BY 1 HAVING count(*) > 1"),
    "pln1_target_types": (
        _types,
        """SELECT * FROM (VALUES ('varchar(max)', 'text', false, 'string'), ('nvarchar(50)', 'varchar(50)', false, 'string'), ('decimal(12,4)', 'numeric(12,4)', false, 'decimal(12,4)'), ('datetime2(7)', 'timestamp(6)', true, 'timestamp_ntz'),
        ('time(3)', 'time(3)', false, 'string'), ('tinyint', 'smallint', false, 'smallint'), ('bit', 'boolean', false, 'boolean'), ('uniqueidentifier', 'uuid', false, 'string'), ('money', 'numeric(19,4)', false, 'decimal(19,4)'),
        ('char(6)', 'char(6)', false, 'string'), ('datetimeoffset(7)', 'timestamptz(6)', true, 'timestamp'), ('xml', 'xml', false, 'string')) AS t(source, target, cut, spark_type)""",
    ),
    "pln2_defaults": (
        _defaults,
        """SELECT * FROM (VALUES ('((0))', '0', false, false), ('(-(1))', '-1', false, false), ('(N''a''''b'')', '''a''''b''', false, false), ('(getdate())', 'LOCALTIMESTAMP', false, true), ('(NULL)', NULL, false, false),
        ('((1)+(2))', NULL, true, false), ('(NEXT VALUE FOR [dbo].[s])', 'nextval(''"dbo"."s"''::regclass)', false, false)) AS t(definition, expr, refused, warned)""",
    ),
    "msc3_payload_values": (
        _payloads,
        """SELECT event_id, strftime(make_timestamp((us - us % 1000 - CASE WHEN us % 1000 < 0 THEN 1000 ELSE 0 END)), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_millis, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_micros,
        strftime(make_timestamp(us + CASE WHEN event_id % 1000 >= 500 THEN 1 ELSE 0 END), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_nanos, strftime(make_timestamp(us), '%H:%M:%S.%f') AS clock, user_id AS n
        FROM (SELECT *, epoch_us(ts) - 2000000000000000 AS us FROM events)""",
    ),
}
