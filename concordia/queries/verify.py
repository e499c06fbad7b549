"""Summaries, buckets and row differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.functions import fingerprint
from concordia.operators import verify as v
from concordia.queries.base import BUCKET_SQL, COPY_SQL, ORDERS, ORDERS_ALL, ORDERS_TEXT, copy_of_orders, hash_sql, table, text_sql

CUSTOMER = v.TableSpec("customer", (v.ColumnSpec("c_custkey", "bigint"), v.ColumnSpec("c_name", "varchar"), v.ColumnSpec("c_nationkey", "int"), v.ColumnSpec("c_acctbal", "float"), v.ColumnSpec("c_mktsegment", "char")), ("c_custkey",))
PART = v.TableSpec("part", (v.ColumnSpec("p_partkey", "bigint"), v.ColumnSpec("p_brand", "char"), v.ColumnSpec("p_size", "int"), v.ColumnSpec("p_retailprice", "money")), ("p_partkey",))
LINEITEM = v.TableSpec("lineitem", (v.ColumnSpec("l_orderkey", "bigint"), v.ColumnSpec("l_linenumber", "int"), v.ColumnSpec("l_quantity", "float"), v.ColumnSpec("l_extendedprice", "float"), v.ColumnSpec("l_shipdate", "datetime")))


LINES = v.TableSpec("lineitem", LINEITEM.columns, ("l_orderkey", "l_linenumber"))
PAIRS = v.TableSpec("pairs", (v.ColumnSpec("k1", "varchar"), v.ColumnSpec("k2", "varchar"), v.ColumnSpec("k3", "varchar"), v.ColumnSpec("c_acctbal", "money")), ("k1", "k2", "k3"))


def _summary(name: str, spec: v.TableSpec):
    def query(spark, sf_dir):
        s = v.summary(table(spark, sf_dir, name), spec)
        return s.select(*[F.col(c).cast("string").alias(c) if c != "row_count" else F.col(c) for c in s.columns])

    return query


def _lineitem_copy(lineitem):
    kept = lineitem.where("l_orderkey % 97 <> 0").withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_orderkey") % 89 == 0, 1.0).otherwise(0.0))
    return kept.unionByName(lineitem.where("l_orderkey % 101 = 0"))


def _pair(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders, copy_of_orders(orders)


def _buckets(spark, sf_dir):
    return v.buckets(table(spark, sf_dir, "orders"), ORDERS).select("bucket", "n", F.col("hash_sum").cast("string").alias("hash_sum"))


def _bucket_diff(spark, sf_dir):
    d = v.bucket_diff(*_pair(spark, sf_dir), ORDERS)
    return d.select("bucket", "src_n", F.col("src_hash").cast("string").alias("src_hash"), "tgt_n", F.col("tgt_hash").cast("string").alias("tgt_hash"))


def _checks(spark, sf_dir):
    orders, copy = _pair(spark, sf_dir)
    return v.checks(orders, copy, ORDERS).select("check_kind", "check_target", F.col("src_value").cast("string").alias("src_value"), F.col("tgt_value").cast("string").alias("tgt_value"), "matched")


def _lines_diff(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_shipdate")])
    k = F.col("l_orderkey") + F.col("l_linenumber")
    kept = one.where(k % 97 != 0).withColumn("l_quantity", F.col("l_quantity") + F.when(k % 89 == 0, 1.0).otherwise(0.0))
    copy = kept.unionByName(one.where(k % 101 == 0).withColumn("l_linenumber", F.col("l_linenumber") + 100))
    return v.row_diff(one, copy, LINES)


def _pairs_diff(spark, sf_dir):
    """Customers twice, under keys whose parts joined by a bar read alike; every third key has a null part."""
    c = table(spark, sf_dir, "customer")
    part = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string"))
    bal = F.col("c_acctbal").cast("decimal(19,4)").alias("c_acctbal")
    one = c.select(F.lit("a|b").alias("k1"), F.lit("c").alias("k2"), part.alias("k3"), bal, "c_custkey").unionByName(c.select(F.lit("a").alias("k1"), F.lit("b|c").alias("k2"), part.alias("k3"), bal, "c_custkey"))
    one = one.where("c_custkey % 3 <> 0 OR c_custkey = 3")
    copy = one.where("NOT (c_custkey % 7 = 0 AND k1 = 'a')").withColumn("c_acctbal", F.when((F.col("c_custkey") % 5 == 0) & (F.col("k1") == "a|b") | (F.col("c_custkey") == 3), F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return v.row_diff(one.drop("c_custkey"), copy.drop("c_custkey"), PAIRS)


def _nopk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return v.rows_diff(li, _lineitem_copy(li), LINEITEM)


_LI_TEXT = text_sql("l_orderkey::VARCHAR", "l_linenumber::VARCHAR", "l_quantity::DECIMAL(38,10)::VARCHAR", "l_extendedprice::DECIMAL(38,10)::VARCHAR", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%g')")
_LI_COPY = "(SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_orderkey % 89 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE l_orderkey % 97 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE l_orderkey % 101 = 0)"
_ALL_TEXT = text_sql("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "rtrim(o_orderstatus, ' ')", "o_totalprice::VARCHAR::DECIMAL(38,10)::VARCHAR", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderpriority")
_CUSTOMER_TEXT = text_sql("c_custkey::VARCHAR", "c_name", "c_nationkey::VARCHAR", "c_acctbal::DECIMAL(38,10)::VARCHAR", "rtrim(c_mktsegment, ' ')")
_PART_TEXT = text_sql("p_partkey::VARCHAR", "rtrim(p_brand, ' ')", "p_size::VARCHAR", "p_retailprice::DECIMAL(19,4)::VARCHAR")


def _summary_sql(name: str, text: str, sums: dict[str, str]) -> str:
    s = "".join(f", CAST(sum(CAST({e} AS DECIMAL(38,{0 if k != 'p_retailprice' else 4}))) AS VARCHAR) AS sum_{k}" for k, e in sums.items())
    return f"SELECT count(*) AS row_count, CAST(sum({hash_sql(text)}) AS VARCHAR) AS hash_sum{s} FROM {name}"


_SIDES = f"(SELECT {BUCKET_SQL} AS bucket, o_orderkey::VARCHAR AS key, {hash_sql(ORDERS_TEXT)} AS h FROM {{}})"
_DIFF = f"""(SELECT coalesce(s.key, t.key) AS key, CASE WHEN t.h IS NULL THEN 'missing' WHEN s.h IS NULL THEN 'extra' ELSE 'diff' END AS side
 FROM {_SIDES.format("orders")} s FULL JOIN {_SIDES.format(COPY_SQL)} t ON s.key = t.key WHERE s.h IS DISTINCT FROM t.h)"""
_B = f"(SELECT {BUCKET_SQL} AS bucket, count(*) AS n, sum({hash_sql(ORDERS_TEXT)}) AS h FROM {{}} GROUP BY 1)"


def _check_sql() -> str:
    side = lambda t: f"(SELECT count(*)::DECIMAL(38,10) AS c, sum({hash_sql(ORDERS_TEXT)})::DECIMAL(38,10) AS h, sum(o_orderkey)::DECIMAL(38,10) AS k, sum(o_custkey)::DECIMAL(38,10) AS u FROM {t})"
    each = [("count", "*", "c"), ("hash", "*", "h"), ("sum", "o_orderkey", "k"), ("sum", "o_custkey", "u")]
    return " UNION ALL ".join(f"SELECT '{a}' AS check_kind, '{b}' AS check_target, s.{c}::VARCHAR AS src_value, t.{c}::VARCHAR AS tgt_value, s.{c} IS NOT DISTINCT FROM t.{c} AS matched FROM {side('orders')} s, {side(COPY_SQL)} t" for a, b, c in each)


QUERIES = {
    "agg1_summary_orders": (_summary("orders", ORDERS_ALL), _summary_sql("orders", _ALL_TEXT, {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey"})),
    "agg1_summary_customer": (_summary("customer", CUSTOMER), _summary_sql("customer", _CUSTOMER_TEXT, {"c_custkey": "c_custkey", "c_nationkey": "c_nationkey"})),
    "agg2_summary_part": (_summary("part", PART), _summary_sql("part", _PART_TEXT, {"p_partkey": "p_partkey", "p_size": "p_size", "p_retailprice": "p_retailprice"})),
    "agg12_checks_orders": (_checks, _check_sql()),
    "hsh2_row_hash_orders": (lambda s, d: table(s, d, "orders").select("o_orderkey", ORDERS_ALL.hash().alias("h")), f"SELECT o_orderkey, CAST({hash_sql(_ALL_TEXT)} AS BIGINT) AS h FROM orders"),
    "hsh3_key_bucket_orders": (lambda s, d: table(s, d, "orders").select("o_orderkey", ORDERS.bucket().alias("bucket")), f"SELECT o_orderkey, {BUCKET_SQL} AS bucket FROM orders"),
    "agg3_buckets_orders": (_buckets, f"SELECT bucket, n, CAST(h AS VARCHAR) AS hash_sum FROM {_B.format('orders')}"),
    "join2_bucket_diff_orders": (
        _bucket_diff,
        f"""SELECT coalesce(s.bucket, t.bucket) AS bucket, s.n AS src_n, CAST(s.h AS VARCHAR) AS src_hash, t.n AS tgt_n, CAST(t.h AS VARCHAR) AS tgt_hash
        FROM {_B.format("orders")} s FULL JOIN {_B.format(COPY_SQL)} t ON s.bucket = t.bucket WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""",
    ),
    "join1_row_diff_orders": (lambda s, d: v.row_diff(*_pair(s, d), ORDERS), f"SELECT key, side FROM {_DIFF}"),
    "join1_row_diff_lineitem": (
        _lines_diff,
        """WITH one AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_extendedprice) AS p, min(l_shipdate) AS d FROM lineitem GROUP BY 1, 2),
        copy AS (SELECT l_orderkey, l_linenumber, q + CASE WHEN (l_orderkey + l_linenumber) % 89 = 0 THEN 1 ELSE 0 END AS q, p, d FROM one WHERE (l_orderkey + l_linenumber) % 97 <> 0
        UNION ALL SELECT l_orderkey, l_linenumber + 100, q, p, d FROM one WHERE (l_orderkey + l_linenumber) % 101 = 0)
        SELECT coalesce(s.l_orderkey, t.l_orderkey)::VARCHAR || '|' || coalesce(s.l_linenumber, t.l_linenumber)::VARCHAR AS key, CASE WHEN t.l_orderkey IS NULL THEN 'missing' WHEN s.l_orderkey IS NULL THEN 'extra' ELSE 'diff' END AS side
        FROM one s FULL JOIN copy t ON s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
        WHERE s.l_orderkey IS NULL OR t.l_orderkey IS NULL OR s.q IS DISTINCT FROM t.q OR s.p IS DISTINCT FROM t.p OR s.d IS DISTINCT FROM t.d""",
    ),
    "join1_row_diff_text_keys": (
        _pairs_diff,
        r"""WITH one AS (SELECT k1, k2, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR END AS k3, c_custkey, c_acctbal::DECIMAL(19,4) AS b
        FROM customer, (VALUES ('a|b', 'c'), ('a', 'b|c')) AS k(k1, k2) WHERE c_custkey % 3 <> 0 OR c_custkey = 3),
        copy AS (SELECT k1, k2, k3, CASE WHEN c_custkey % 5 = 0 AND k1 = 'a|b' OR c_custkey = 3 THEN b + 1 ELSE b END AS b FROM one WHERE NOT (c_custkey % 7 = 0 AND k1 = 'a'))
        SELECT 'a|b|c|' || coalesce(coalesce(s.k3, t.k3), '\N') AS key, CASE WHEN t.b IS NULL THEN 'missing' WHEN s.b IS NULL THEN 'extra' ELSE 'diff' END AS side
        FROM one s FULL JOIN copy t ON s.k1 = t.k1 AND s.k2 = t.k2 AND s.k3 IS NOT DISTINCT FROM t.k3 WHERE s.b IS DISTINCT FROM t.b""",
    ),
    "agg4_diff_sides_orders": (lambda s, d: v.side_counts(v.row_diff(*_pair(s, d), ORDERS)), f"SELECT side, count(*) AS n FROM {_DIFF} GROUP BY side"),
    "srt4_first_diffs_orders": (lambda s, d: v.first_diffs(v.row_diff(*_pair(s, d), ORDERS)), f"SELECT key, side FROM {_DIFF} ORDER BY key, side LIMIT 100"),
    "agg1_nopk_summary_lineitem": (_summary("lineitem", LINEITEM), _summary_sql("lineitem", _LI_TEXT, {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"})),
    "set3_nopk_diff_lineitem": (
        _nopk,
        f"""SELECT CAST(h AS BIGINT) AS h, CAST(sum(s) AS BIGINT) AS src_n, CAST(sum(1 - s) AS BIGINT) AS tgt_n FROM (SELECT {hash_sql(_LI_TEXT)} AS h, 1 AS s FROM lineitem
        UNION ALL SELECT {hash_sql(_LI_TEXT)}, 0 FROM {_LI_COPY}) GROUP BY h HAVING sum(s) <> sum(1 - s)""",
    ),
    "hsh1_exact_row_text_customer": (
        lambda s, d: table(s, d, "customer").select("c_custkey", F.md5(fingerprint.row_text(CUSTOMER.texts(True), exact=True)).alias("m")),
        "SELECT c_custkey, md5(concat_ws('|', " + ", ".join(f"coalesce(length({p})::VARCHAR || ':' || {p}, '-')" for p in ("c_custkey::VARCHAR", "c_name", "c_nationkey::VARCHAR", "c_acctbal::DECIMAL(38,10)::VARCHAR", "rtrim(c_mktsegment, ' ')")) + ")) AS m FROM customer",
    ),
}
