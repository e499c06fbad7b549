"""Catalog operators over catalogs that Spark derives from the given tables.

Orders and their lines, parts and customers stand for a source's system tables: an order for an
index, a foreign key or a column of its customer's table, its lines for their columns, a part for
a table or a column with type and collation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from concordia.operators import catalog as c
from concordia.queries.base import table

_at = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")


def _indexes(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    index = orders.select(F.col("o_orderkey").alias("object_id"), F.lit(1).alias("index_id"), F.concat(F.lit("ix_"), "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", "PRIMARY").otherwise("INDEX").alias("kind"))
    of = lines.select(
        F.col("l_orderkey").alias("object_id"), F.lit(1).alias("index_id"), F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_linenumber")).alias("key_ordinal"), F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("p"), F.lpad("l_partkey", 9, "0")).alias("column"), (F.col("l_returnflag") == "R").alias("descending"),
    )
    return c.indexes(index, of)


def _columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = [F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("column_id")]
    level = F.substr("o_orderpriority", F.lit(1), F.lit(1))
    cols = o.select(*key, F.concat(F.lit("c"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("type_id"))
    types = o.select(F.col("o_orderstatus").alias("type_id")).distinct().withColumn("type", F.concat(F.lit("type_"), F.lower("type_id")))
    identity = o.where(level == "1").select(*key, F.col("o_custkey").alias("seed"))
    computed = o.where(level.isin("1", "2")).select(*key, F.concat(F.lit("("), "o_orderkey", F.lit(")")).alias("formula"))
    default = o.where(level == "5").select(*key, F.col("o_orderpriority").alias("definition"))
    return c.columns(cols, types, identity, computed, default).select("object_id", "column_id", "name", "type", "seed", "formula", "definition")


def _foreign_keys(spark, sf_dir):
    fk = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fk_id"), F.concat(F.lit("fk_"), "o_orderkey").alias("name"), F.col("o_custkey").alias("child"), F.col("o_orderstatus").alias("parent"))
    of = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fk_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("a"), F.lpad("l_partkey", 9, "0")).alias("column"), F.concat(F.lit("b"), F.lpad("l_suppkey", 9, "0")).alias("ref_column"))
    return c.foreign_keys(fk, of)


def _part_columns(spark, sf_dir):
    """Parts as columns of a table: type, collation and code page by size."""
    size = F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("varchar", "nvarchar", "char", "int", "text")]), size % 5 + 1)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"), kind.alias("type"), F.when(size % 2 == 0, "Latin1_General_CI_AS").otherwise("Latin1_General_CS_AS").alias("collation"),
        F.when(size % 3 == 0, 949).when(size % 3 == 1, 65001).alias("code_page"), (size > 25).alias("generated"),
    )


_PART_SQL = """(SELECT p_partkey AS ordinal, p_name AS name, ['varchar', 'nvarchar', 'char', 'int', 'text'][p_size % 5 + 1] AS type, CASE WHEN p_size % 2 = 0 THEN 'Latin1_General_CI_AS' ELSE 'Latin1_General_CS_AS' END AS coll,
 CASE p_size % 3 WHEN 0 THEN 949 WHEN 1 THEN 65001 END AS code_page, p_size > 25 AS generated FROM part)"""


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("dbo."), F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("name"))


_NAMES_SQL = "(SELECT 'dbo.' || replace(p_name, ' ', '_') || p_partkey AS name FROM part)"


def _mismatched(spark, sf_dir):
    k, t = F.col("c_custkey"), table(spark, sf_dir, "customer")
    planned = t.where(k % 7 != 0).select(F.col("c_name").alias("src"), F.col("c_mktsegment").alias("tgt"))
    registered = t.where(k % 11 != 0).select(F.col("c_name").alias("src"), F.when(k % 5 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("tgt"))
    return c.mismatched_tables(planned, registered)


def _captured(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return c.captured_tables(o.select(F.lower("o_orderstatus").alias("schema"), F.concat(F.lit("c"), "o_custkey").alias("table"), F.concat(F.lit("i"), "o_orderkey").alias("instance"), _at(F.col("o_orderkey")).alias("start_lsn")))


def _not_captured(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    covered = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.upper("c_name").alias("name"))
    return c.not_captured(customer.select(F.col("c_name").alias("name")), covered)


def _blocking(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    objects = o.select(F.when(F.col("o_orderpriority") < "3", "trigger").otherwise("foreign key").alias("kind"), F.concat(F.lit("DBO.C"), "o_custkey").alias("table_name"), F.concat(F.lit("o"), "o_orderkey").alias("name"), (F.col("o_orderstatus") == "F").alias("enabled"))
    return c.blocking_objects(objects, table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.concat(F.lit("dbo.c"), "c_custkey").alias("tgt")))


def _short_names(spark, sf_dir):
    """Index names made of a customer's segment and name, many of them too long, with letters of two bytes."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("ix_"), F.repeat(F.lit("\u00e9"), (k % 30).cast("int")), F.repeat("c_name", (k % 4).cast("int")))
    return table(spark, sf_dir, "customer").select(k, c.short_names(name).alias("short"))


def _safe_messages(spark, sf_dir):
    """Errors as a database tells them, with values of rows in three forms, over two lines."""
    text = F.format_string(" duplicate key value '%s' in \"%s\" of order %d: Key (o_custkey)=(%d)\nfor '%s'", "o_orderpriority", "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", c.safe_messages(text).alias("message"))


def _bounds(spark, sf_dir):
    p, digits = table(spark, sf_dir, "part"), F.rpad(F.lit("1"), F.col("p_size") % 37 + 1, F.lit("0")).cast("decimal(38,0)")
    low, high = c.sequence_bounds(-digits - F.col("p_partkey"), digits + F.col("p_partkey"))
    return p.select("p_partkey", low.cast("string").alias("low"), high.cast("string").alias("high"))


_DIGITS = "CAST(rpad('1', p_size % 37 + 1, '0') AS HUGEINT)"

QUERIES = {
    "hsh5_short_names_customer": (
        _short_names,
        """SELECT c_custkey, CASE WHEN strlen(name) <= 63 THEN name ELSE left(name, CASE WHEN k > 25 THEN 28 ELSE 54 - k END) || '_' || left(sha256(name), 8) END AS short
        FROM (SELECT c_custkey, c_custkey % 30 AS k, 'ix_' || repeat(chr(233), c_custkey % 30) || repeat(c_name, c_custkey % 4) AS name FROM customer)""",
    ),
    "msc7_safe_messages_orders": (_safe_messages, "SELECT o_orderkey, 'duplicate key value ? in ? of order ' || o_orderkey || ': Key (o_custkey)?' AS message FROM orders"),
    "pln9_sequence_bounds_part": (
        _bounds,
        f"SELECT p_partkey, greatest(-{_DIGITS} - p_partkey, -9223372036854775808)::VARCHAR AS low, least({_DIGITS} + p_partkey, 9223372036854775807)::VARCHAR AS high FROM part",
    ),
    "src3_indexes": (
        _indexes,
        """SELECT o_orderkey AS object_id, 1 AS index_id, 'ix_' || o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN 'PRIMARY' ELSE 'INDEX' END AS kind,
        CASE WHEN count(l_orderkey) > 0 THEN coalesce(string_agg(p || CASE WHEN l_returnflag = 'R' THEN ' DESC' ELSE '' END, ',' ORDER BY l_linenumber, p, l_returnflag = 'R') FILTER (l_returnflag <> 'N'), '') END AS keys,
        CASE WHEN count(l_orderkey) > 0 THEN coalesce(string_agg(p, ',' ORDER BY l_linenumber, p) FILTER (l_returnflag = 'N'), '') END AS includes
        FROM orders LEFT JOIN (SELECT *, 'p' || lpad(l_partkey::VARCHAR, 9, '0') AS p FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""",
    ),
    "src2_columns": (
        _columns,
        """SELECT o_custkey AS object_id, o_orderkey AS column_id, 'c' || o_orderkey AS name, 'type_' || lower(o_orderstatus) AS type, CASE WHEN o_orderpriority[1] = '1' THEN o_custkey END AS seed,
        CASE WHEN o_orderpriority[1] IN ('1', '2') THEN '(' || o_orderkey || ')' END AS formula, CASE WHEN o_orderpriority[1] = '5' THEN o_orderpriority END AS definition FROM orders""",
    ),
    "src4_foreign_keys": (
        _foreign_keys,
        """SELECT o_orderkey AS fk_id, 'fk_' || o_orderkey AS name, o_custkey AS child, o_orderstatus AS parent, string_agg(a, ',' ORDER BY l_linenumber, a, b) AS columns, string_agg(b, ',' ORDER BY l_linenumber, a, b) AS ref_columns
        FROM orders JOIN (SELECT *, 'a' || lpad(l_partkey::VARCHAR, 9, '0') AS a, 'b' || lpad(l_suppkey::VARCHAR, 9, '0') AS b FROM lineitem) ON o_orderkey = l_orderkey GROUP BY ALL""",
    ),
    "src5_other_objects": (
        lambda s, d: c.other_objects(table(s, d, "part").select(F.col("p_type").alias("type"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name")), table(s, d, "supplier").select(F.col("s_name").alias("name"))),
        """SELECT type, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT p_type AS type, p_name || ' ' || p_partkey AS name FROM part UNION ALL SELECT 'TABLE_TYPE', s_name FROM supplier) GROUP BY type""",
    ),
    "agg11_row_estimates": (
        lambda s, d: c.row_estimates(
            table(s, d, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_name").alias("name")),
            table(s, d, "lineitem").select(F.col("l_partkey").alias("object_id"), (F.col("l_linenumber") - 1).alias("index_id"), F.col("l_quantity").cast("bigint").alias("rows")),
        ),
        """SELECT p_partkey AS object_id, p_name AS name, (SELECT sum(l_quantity::BIGINT)::BIGINT FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber IN (1, 2)) AS rows_estimate FROM part""",
    ),
    "agg13_behaviour_notes": (
        lambda s, d: c.behaviour_notes(_part_columns(s, d)),
        f"""SELECT count(*) FILTER (contains(coll, '_CI_')) AS case_insensitive, count(*) FILTER (type IN ('varchar', 'nvarchar')) AS trailing_space_kept,
        count(*) FILTER (type IN ('char', 'varchar', 'text') AND coalesce(code_page, 65001) <> 65001) AS other_code_page, count(*) FILTER (type <> 'int') AS text_columns FROM {_PART_SQL}""",
    ),
    "prj1_load_columns": (lambda s, d: c.load_columns(_part_columns(s, d)).select("ordinal", "name"), f"SELECT ordinal, name FROM {_PART_SQL} WHERE NOT generated"),
    "prj2_renamed_nation": (lambda s, d: c.renamed(table(s, d, "nation").withColumnRenamed("n_name", "N_Name"), {"n_regionkey": "region"}), "SELECT n_nationkey, n_name, n_regionkey AS region FROM nation"),
    "fil2_table_selection": (
        lambda s, d: _names(s, d).select("name", c.selected(F.col("name"), ["dbo.cold*", "DBO.SMAL?_*", "dbo.*7?"], ["*9"]).alias("chosen")),
        f"SELECT name, (regexp_full_match(lower(name), 'dbo\\.cold.*|dbo\\.smal._.*|dbo\\..*7.') AND NOT regexp_full_match(lower(name), '.*9')) AS chosen FROM {_NAMES_SQL}",
    ),
    "set4_not_captured": (_not_captured, "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "join12_mismatched_tables": (
        _mismatched,
        """SELECT c_name AS src, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS planned, CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END END AS registered
        FROM customer WHERE (c_custkey % 7 <> 0 OR c_custkey % 11 <> 0) AND (c_custkey % 7 = 0 OR c_custkey % 11 = 0 OR c_custkey % 5 = 0 AND lower(c_mktsegment) <> c_mktsegment)""",
    ),
    "src11_captured_tables": (
        _captured,
        "SELECT lower(o_orderstatus) || '.c' || o_custkey AS name, 'i' || max(o_orderkey) AS instance, lpad(lower(to_hex(max(o_orderkey))), 8, '0') AS start_lsn FROM orders GROUP BY o_orderstatus, o_custkey",
    ),
    "fil8_blocking_objects": (
        _blocking,
        """SELECT CASE WHEN o_orderpriority < '3' THEN 'trigger' ELSE 'foreign key' END AS kind, 'DBO.C' || o_custkey AS table_name, 'o' || o_orderkey AS name
        FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)""",
    ),
}
