"""Value rules and canonical texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import normalize, values
from concordia.functions.values import ValueRule
from concordia.operators import catalog
from concordia.queries.base import table


def _nation(spark, sf_dir):
    c = F.concat(F.lower("n_name"), F.lit("+"), F.chr(F.lit(0)), F.lit(" "))
    strip = values.text_rules(c, ValueRule(nul_char="strip", trailing_space="rtrim", case="upper"))
    put = values.text_rules(c, ValueRule(nul_char="replace", nul_replacement="?", case="upper"))
    return table(spark, sf_dir, "nation").select("n_nationkey", strip.alias("stripped"), put.alias("replaced"))


def _ticks(spark, sf_dir):
    """Event times with a seventh decimal; every tenth is moved to the last ticks of its year."""
    end = F.concat(F.year("ts"), F.lit("-12-31 23:59:59.999999"))
    text = F.when(F.col("event_id") % 10 == 3, end).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(text, (F.col("event_id") * 7 % 10).cast("string")).alias("raw"))


def _stamps(spark, sf_dir):
    t = _ticks(spark, sf_dir).select("event_id", values.timestamp_of(F.col("raw")).alias("h"), values.timestamp_of(F.col("raw"), "truncate").alias("t"))
    return t.select("event_id", F.date_format("h", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("half_up"), F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("truncated"))


_TICKS_SQL = "(SELECT event_id, CASE WHEN event_id % 10 = 3 THEN year(ts) || '-12-31 23:59:59.999999' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END || (event_id * 7 % 10) AS raw FROM events)"
_MICRO = "make_timestamp(epoch_us(raw[1:19]::TIMESTAMP) + {})"
_STAMP_SQL = f"""SELECT event_id, strftime({_MICRO.format("(raw[21:]::BIGINT + 5) // 10")}, '%Y-%m-%d %H:%M:%S.%f') AS half_up,
 strftime({_MICRO.format("raw[21:]::BIGINT // 10")}, '%Y-%m-%d %H:%M:%S.%f') AS truncated FROM {_TICKS_SQL}"""
_TIME_SQL = f"""SELECT event_id, CASE WHEN us >= 86400000000 THEN '24:00:00' ELSE strftime(make_timestamp(us), '%H:%M:%S.%f') END AS rounded FROM
 (SELECT event_id, (raw[1:2]::BIGINT * 3600 + raw[4:5]::BIGINT * 60 + raw[7:8]::BIGINT) * 1000000 + (raw[10:]::BIGINT + 5) // 10 AS us FROM (SELECT event_id, raw[12:] AS raw FROM {_TICKS_SQL}))"""


def _sentinel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 50 == 0, F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")).when(F.col("o_orderkey") % 51 == 0, F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")))
    gone = values.sentinel_value(F.col("d"), ValueRule(sentinel="null"))
    far = normalize.canonical(F.col("d"), "datetime", ValueRule(sentinel="infinity"))
    return o.select("o_orderkey", F.date_format(gone, "yyyy-MM-dd").alias("as_null"), far.alias("as_infinity"))


_D = "CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '1900-01-01' WHEN o_orderkey % 51 = 0 THEN TIMESTAMP '9999-12-31 23:59:59' ELSE o_orderdate END"


def _scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 50 == 0, F.lit("1900-01-01").cast("timestamp_ntz")).otherwise(F.col("o_orderdate")))
    o = o.withColumn("s", F.when(F.col("o_orderkey") % 60 == 0, F.concat("o_orderpriority", F.chr(F.lit(0)))).otherwise(F.col("o_orderpriority")))
    return catalog.data_scan(o, ["s", "o_orderstatus"], ["d"])


def _hex(spark, sf_dir):
    b = F.encode("n_name", "utf-8")
    return table(spark, sf_dir, "nation").select("n_nationkey", values.bytes_text(b).alias("as_copy"), normalize.canonical(b, "varbinary").alias("canonical"), values.bit_text(F.col("n_regionkey") > 1).alias("bit"), values.bit_text(F.col("n_regionkey") > 1, "smallint").alias("bit_number"))


def _canonical(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate")
    kinds = {"date": ts, "datetime": ts, "smalldatetime": ts, "datetime2": ts, "bigint": F.col("o_custkey"), "money": F.col("o_totalprice"), "float": F.col("o_totalprice"), "char": F.concat("o_orderstatus", F.lit("  ")), "varchar": F.concat("o_orderstatus", F.lit(" ")), "bit": F.col("o_custkey") % 2 == 0, "uniqueidentifier": F.upper("o_orderpriority"), "decimal": F.col("o_totalprice").cast("decimal(15,2)")}
    return o.select("o_orderkey", *[normalize.canonical(c, k).alias(f"as_{k}") for k, c in kinds.items()])


_CANONICAL_SQL = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS as_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') AS as_datetime, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_smalldatetime,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS as_datetime2, o_custkey::VARCHAR AS as_bigint, o_totalprice::DECIMAL(19,4)::VARCHAR AS as_money, o_totalprice::VARCHAR::DECIMAL(38,10)::VARCHAR AS as_float,
 rtrim(o_orderstatus || '  ', ' ') AS as_char, o_orderstatus || ' ' AS as_varchar, CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE '0' END AS as_bit, lower(upper(o_orderpriority)) AS as_uniqueidentifier,
 o_totalprice::DECIMAL(15,2)::VARCHAR AS as_decimal FROM orders"""

QUERIES = {
    "val2_text_rules_nation": (_nation, "SELECT n_nationkey, upper(lower(n_name) || '+') AS stripped, upper(lower(n_name) || '+?') || ' ' AS replaced FROM nation"),
    "val6_timestamp_rounding": (_stamps, _STAMP_SQL),
    "val7_time_rounding": (lambda s, d: _ticks(s, d).select("event_id", values.time_of(F.substr("raw", F.lit(12))).alias("rounded")), _TIME_SQL),
    "val5_sentinels_orders": (
        _sentinel,
        f"""SELECT o_orderkey, CASE WHEN {_D}::DATE NOT IN (DATE '1753-01-01', DATE '1900-01-01', DATE '9999-12-31') THEN strftime({_D}, '%Y-%m-%d') END AS as_null,
        CASE WHEN {_D}::DATE IN (DATE '1753-01-01', DATE '1900-01-01') THEN '-infinity' WHEN {_D}::DATE = DATE '9999-12-31' THEN 'infinity' ELSE strftime({_D}, '%Y-%m-%d %H:%M:%S.%g') END AS as_infinity FROM orders""",
    ),
    "agg6_data_scan_orders": (
        _scan,
        """SELECT * FROM (SELECT 's' AS "column", count(*) FILTER (o_orderkey % 60 = 0) AS nul_rows, 0::BIGINT AS sentinel_rows FROM orders UNION ALL SELECT 'o_orderstatus', 0, 0
        UNION ALL SELECT 'd', 0, count(*) FILTER (o_orderkey % 50 = 0) FROM orders)""",
    ),
    "agg6_nul_scan_documents": (
        lambda s, d: catalog.data_scan(table(s, d, "documents"), ["text", "source"], []),
        """SELECT 'text' AS "column", count(*) FILTER (contains(text, chr(0))) AS nul_rows, 0::BIGINT AS sentinel_rows FROM documents UNION ALL SELECT 'source', count(*) FILTER (contains(source, chr(0))), 0 FROM documents""",
    ),
    "val9_copy_text_documents": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.md5(values.copy_text(F.when(F.col("doc_id") % 7 != 0, F.col("text")))).alias("m")),
        r"""SELECT doc_id, md5(coalesce(replace(replace(replace(replace(CASE WHEN doc_id % 7 <> 0 THEN text END, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '\N')) AS m FROM documents""",
    ),
    "val10_hex_nation": (
        _hex,
        r"""SELECT n_nationkey, '\x' || lower(hex(encode(n_name))) AS as_copy, hex(encode(n_name)) AS canonical, CASE WHEN n_regionkey > 1 THEN 't' ELSE 'f' END AS bit, CASE WHEN n_regionkey > 1 THEN '1' ELSE '0' END AS bit_number FROM nation""",
    ),
    "nrm_canonical_orders": (_canonical, _CANONICAL_SQL),
    "pln4_generated_orders": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("CASE upper(rtrim(o_orderstatus)) WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 99 END").alias("status_rank")),
        "SELECT o_orderkey, CASE upper(rtrim(o_orderstatus)) WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 99 END AS status_rank FROM orders",
    ),
    "pln4_file_ext_pages": (
        lambda s, d: table(s, d, "pages").select("page_id", F.expr(r"CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '\\.([^.]*)$', 1)) END").alias("ext")),
        r"SELECT page_id, CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '\.([^.]*)$', 1)) END AS ext FROM pages",
    ),
}
