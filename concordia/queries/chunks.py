"""Key ranges, copies of them, and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.operators import chunks as c
from concordia.operators import constraints as k
from concordia.queries.base import COPY_SQL, copy_of_orders, table


def _ntile(name: str, key: list[str], n: int):
    return lambda s, d: c.ntile_starts(table(s, d, name), key, n)


def _ntile_sql(name: str, key: list[str], n: int) -> str:
    cols = ", ".join(key)
    return f"""SELECT CAST(nt AS INTEGER) AS nt, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY nt ORDER BY {cols}) AS rn FROM
    (SELECT {cols}, ntile({n}) OVER (ORDER BY {cols}) AS nt FROM {name})) WHERE rn = 1 AND nt > 1"""


_EVEN = """(SELECT row_number() OVER (ORDER BY start) - 1 AS chunk_no, CASE WHEN i > 0 THEN start END AS lower, lead(start) OVER (ORDER BY start) AS upper FROM
 (SELECT CAST(lo + (hi - lo + 1) * i // 8 AS BIGINT) AS start, i FROM (SELECT min(o_orderkey)::HUGEINT AS lo, max(o_orderkey)::HUGEINT AS hi FROM orders), range(8) AS r(i)))"""


def _scan(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(c.in_range(["conv_id", "turn"], [10, 2], [60, 1])).select("conv_id", "turn", "role")


def _counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return c.chunk_counts(orders, "o_orderkey", c.even_split(orders, "o_orderkey", 8))


def _orphans(spark, sf_dir):
    return k.orphans(table(spark, sf_dir, "lineitem"), copy_of_orders(table(spark, sf_dir, "orders")), [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber")


def _nulls_one_value(spark, sf_dir):
    seg = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    return k.duplicates(table(spark, sf_dir, "customer").withColumn("c_mktsegment", seg), ["c_nationkey", "c_mktsegment"])


def _probe(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    row = k.probe(customer, {"c_name": F.lower("c_name")}, "c_custkey")
    found = k.duplicates(customer.unionByName(row), ["c_name"], fold=["c_name"])
    return found.select(F.lit("unique").alias("kind"), F.col("c_name").alias("key"), "n").unionByName(
        k.orphans(k.probe(customer, {"c_nationkey": F.lit(-1)}, "c_custkey"), table(spark, sf_dir, "nation"), [("c_nationkey", "n_nationkey")]).select(F.lit("foreign key").alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))
    )


QUERIES = {
    "chk1_even_split_orders": (lambda s, d: c.even_split(table(s, d, "orders"), "o_orderkey", 8), f"SELECT chunk_no, lower, upper FROM {_EVEN}"),
    "win1_ntile_starts_orders": (_ntile("orders", ["o_orderkey"], 7), _ntile_sql("orders", ["o_orderkey"], 7)),
    "win2_ntile_starts_conversations": (_ntile("conversations", ["conv_id", "turn"], 5), _ntile_sql("conversations", ["conv_id", "turn"], 5)),
    "fil1_chunk_scan_conversations": (_scan, "SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 10 OR conv_id = 10 AND turn >= 2) AND (conv_id < 60 OR conv_id = 60 AND turn < 1)"),
    "src7_chunk_counts_orders": (
        _counts,
        f"SELECT chunk_no, count(o_orderkey) AS row_count FROM {_EVEN} b LEFT JOIN orders ON (lower IS NULL OR o_orderkey >= lower) AND (upper IS NULL OR o_orderkey < upper) GROUP BY chunk_no",
    ),
    "agg5_key_edges_orders": (lambda s, d: table(s, d, "orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")), "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders"),
    "pln6_ci_unique_part": (lambda s, d: k.duplicates(table(s, d, "part"), ["p_brand", "p_size"], fold=["p_brand"]), "SELECT lower(p_brand) AS p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1"),
    "pln6_filtered_unique_orders": (
        lambda s, d: k.duplicates(table(s, d, "orders"), ["o_custkey"], where=F.col("o_orderstatus") == "F"),
        "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1",
    ),
    "pln6_nulls_not_distinct_customer": (
        _nulls_one_value,
        "SELECT c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "pln7_wide_keys_documents": (
        lambda s, d: k.wide_keys(table(s, d, "documents"), ["source", "text"]).select("source", "key_bytes"),
        "SELECT source, CAST(octet_length(encode(source)) + octet_length(encode(text)) AS INTEGER) AS key_bytes FROM documents WHERE octet_length(encode(source)) + octet_length(encode(text)) > 2700",
    ),
    "join11_fk_orphans_lineitem": (_orphans, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {COPY_SQL})"),
    "fil7_check_violations_part": (lambda s, d: k.outside(table(s, d, "part"), "p_size", 0, 40).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 0 AND 40)"),
    "mut9_probe_customer": (
        _probe,
        """SELECT 'unique' AS kind, lower(c_name) AS key, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT lower(c_name) FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)) GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'foreign key', CAST(max(c_custkey) + 1000000 AS VARCHAR), 1 FROM customer""",
    ),
}
