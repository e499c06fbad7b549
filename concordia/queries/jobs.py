"""A whole job over customers and nations, and what its state says afterwards.

The job copies both tables, captures and applies a change for every tenth, thirteenth and
seventeenth customer, verifies, and switches.  It runs once for a session and folder; its state
is a folder of its own under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import lsn, normalize
from concordia.functions.values import DATE_TYPES, TEXT_TYPES, ValueRule, resolve
from concordia.operators import chunks as C
from concordia.plans import cutover as co
from concordia.plans import names, planner
from concordia.plans import rules as R
from concordia.plans.load import Loader, chunk_states, create_tables, safe
from concordia.plans.model import Catalog, Column, ForeignKey, Index, Sequence, Table
from concordia.queries.base import table
from concordia.sources import catalog as system
from concordia.sources import config, envelope
from concordia.sources.log import SourceLog
from concordia.sources.store import Store
from concordia.streaming import sync


def _col(i: int, name: str, kind: str, length: int = 0, scale: int = 0, **more) -> Column:
    return Column(i, name, kind, length, 0, scale, nullable=i > 1, **more)


CATALOG = Catalog("shop", (
    Table("dbo", "customer", (
        _col(1, "c_custkey", "bigint"), _col(2, "c_name", "varchar", 40), _col(3, "c_nationkey", "int"), _col(4, "c_acctbal", "money", 8, 4), _col(5, "c_mktsegment", "char", 12), _col(6, "c_tag", "varchar", 12, computed="(lower([c_mktsegment]))"),
    ), (Index("pk_customer", "PRIMARY_KEY", (("c_custkey", False),)), Index("uq_customer", "UNIQUE_INDEX", (("c_name", False), ("c_nationkey", False), ("c_custkey", False)))), (ForeignKey("fk_nation", ("c_nationkey",), "dbo.nation", ("n_nationkey",)),)),
    Table("dbo", "nation", (_col(1, "n_nationkey", "int"), _col(2, "n_name", "varchar", 30), _col(3, "n_regionkey", "int"))),
))
RULES = {"tables": {"dbo.customer": {"columns": {"c_tag": {"generated": "lower(c_mktsegment)"}, "c_name": {"nul_char": "fail"}}}}}
_SHIFT = 10_000_000
_jobs: dict[tuple[str, str], SimpleNamespace] = {}


def _source(spark: SparkSession, sf_dir: str):
    def read(t) -> DataFrame:
        df = table(spark, sf_dir, t.source.name)
        return df.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(19,4)")) if t.source.name == "customer" else df

    return read


def _changes(customer: DataFrame) -> DataFrame:
    """Envelopes: balances raised for every tenth key, other multiples of 17 deleted, copies of multiples of 13 added."""
    k = F.col("c_custkey")
    names_ = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    raised = customer.where(k % 10 == 0).withColumn("c_acctbal", F.col("c_acctbal") + 1).select("*", F.lit("u").alias("op"), (k + 1).alias("at"))
    gone = customer.where((k % 17 == 0) & (k % 10 != 0)).select("*", F.lit("d").alias("op"), (k + 1).alias("at"))
    new = customer.where(k % 13 == 0).withColumn("c_custkey", k + _SHIFT).select("*", F.lit("c").alias("op"), F.col("c_custkey").alias("at"))
    return enveloped(raised.unionByName(gone).unionByName(new), names_)


def enveloped(rows: DataFrame, names_: tuple[str, ...]) -> DataFrame:
    """Customers with an operation and a number ``at`` as envelopes."""
    text = lambda c: F.col(c).cast("string")
    at = lsn.of_number(F.col("at"))
    key = F.create_map(F.lit("c_custkey"), text("c_custkey"))
    after = F.create_map(*[x for n in names_ for x in (F.lit(n), text(n))])
    return rows.select(
        F.lit("CHANGE").alias("kind"), at.alias("stream_lsn"), F.lit("dbo").alias("schema"), F.lit("customer").alias("table"), "op", at.alias("commit_lsn"), at.alias("change_lsn"), F.lit(1).alias("event_serial_no"),
        F.lit("2026-01-01T00:00:00").alias("commit_at"), F.when(F.col("op") != "c", key).alias("before"), F.when(F.col("op") != "d", after).alias("after"),
    )


def _write_source_log(changes: DataFrame, folder: str) -> None:
    """What the source says of its log: every commit, a clock, and a scan that began after the clock's time."""
    changes.select(F.col("commit_lsn").alias("lsn"), F.col("commit_at")).write.parquet(f"{folder}/log_times")
    spark = changes.sparkSession
    spark.createDataFrame([("2026-01-01 00:01:00", "2026-01-01 00:01:01"), ("2026-01-01 00:03:00", "2026-01-01 00:03:01")], "started_at string, ended_at string").write.parquet(f"{folder}/log_scans")
    spark.createDataFrame([("2026-01-01 00:02:00",)], "now string").write.parquet(f"{folder}/log_clock")


def _after_changes(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    kept = customer.where((k % 17 != 0) | (k % 10 == 0)).withColumn("c_acctbal", F.when(k % 10 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).cast("decimal(19,4)"))
    return kept.unionByName(customer.where(k % 13 == 0).withColumn("c_custkey", k + _SHIFT))


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="concordia-")
    return f"{base.rstrip('/')}/concordia-job-{uuid.uuid4().hex}"


@contextmanager
def scratch_store(spark: SparkSession, status: str | None = "SCHEMA_DONE"):
    """A new job's state, deleted at the end; so the results that leave it are rows, not plans."""
    folder = _folder(spark)
    store = Store(spark, f"{folder}/state")
    if status:
        store.commit(lambda s: s.update(job=status))
    try:
        yield store
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def job(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _jobs:
        return _jobs[known]
    root, plan, source = _folder(spark), planner.plan(CATALOG, R.load(RULES)), _source(spark, sf_dir)
    store = Store(spark, f"{root}/state")
    store.commit(lambda s: s.update(job="SCHEMA_DONE"))
    customer = source(plan.tables[0])
    Loader(store, plan.tables, source, rows_per_chunk=max(1, -(-customer.count() // 4)), chunks_at_once=4).run()
    applier = sync.Applier(store, plan.tables)
    target = lambda t: applier.read(t.name)
    loaded = store.manifest()
    _write_source_log(_changes(customer), f"{root}/log")
    log = SourceLog.folder(spark, f"{root}/log")
    first = co.verify_run(store, plan.tables, source, target)
    _changes(customer).write.json(f"{root}/changes")
    capture = sync.Capture(store, plan.tables, source=log)
    run = lambda: capture.run(f"{root}/changes", f"{root}/checkpoint").awaitTermination()
    with sync.ticking(applier, 3600):
        run()
        captured = store.manifest()
        drained = sync.drain(run, applier, 600, 0, log)
    second = co.verify_run(store, plan.tables, source, target)
    status = applier.status()
    now = lambda t: _after_changes(customer) if t.source.name == "customer" else source(t)
    code, steps = co.Cutover(store, plan.tables, now, target, lambda: True).run()
    _jobs[known] = SimpleNamespace(root=root, store=store, plan=plan, applier=applier, target=target, loaded=loaded, captured=captured, drained=drained, runs=(first, second), status=status, code=code, steps=steps, changes=f"{root}/changes", log=log)
    return _jobs[known]


def _bulk(spark, sf_dir):
    j = job(spark, sf_dir)
    return j.applier.read("customer", j.loaded).select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment", "c_tag")


def _ranges(spark, sf_dir):
    c = chunk_states(job(spark, sf_dir).store, "customer")
    return c.select("chunk_no", F.get("lower", 0).cast("long").alias("lower"), F.get("upper", 0).cast("long").alias("upper"), "status", "rows", F.col("attempts").cast("long").alias("attempts"))


def _log(spark, sf_dir):
    j = job(spark, sf_dir)
    return sync.log_frame(j.store, j.captured).select("commit_lsn", "event_serial_no", "op", "table_name", F.col("after")["c_acctbal"]["v"].alias("acctbal"))


def _applied(spark, sf_dir):
    return job(spark, sf_dir).applier.read("customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_tag")


def _one_row(spark, names_: str, *values) -> DataFrame:
    return spark.createDataFrame([values], names_)


def _positions(spark, sf_dir):
    j = job(spark, sf_dir)
    s, seen = j.store.manifest(), j.log.snapshot()
    names_ = "start_lsn string, stream_lsn string, applied_lsn string, drained boolean, left_in_log long, source_lsn string, source_at string, log_from string"
    return _one_row(spark, names_, s["start_lsn"], s["stream_lsn"], s["positions"]["customer"][0], j.drained, len(s["log"]), seen.max_lsn, seen.max_commit_at, j.log.oldest())


def _status(spark, sf_dir):
    s, mark = job(spark, sf_dir).status, job(spark, sf_dir).store.manifest()["watermark"]
    names_ = "pending long, waiting_for_load long, captured long, applied long, marked_pending long, marked_applied long, marked_lsn string, src_max_at string"
    return _one_row(spark, names_, s["pending"], s["waiting_for_load"], s["captured"], s["applied"], mark["pending"], mark["applied"], mark["stream_lsn"], mark["src_max_at"])


def _results(spark, sf_dir):
    j = job(spark, sf_dir)
    r = spark.read.parquet(*[f"{j.store.root}/{run['results']}" for run in j.runs])
    return r.where("check_kind = 'count' OR check_target IN ('c_custkey', 'n_nationkey')").select("run_id", "table_name", "check_kind", "check_target", "src_value", "tgt_value", "matched")


def _diffs(spark, sf_dir):
    j = job(spark, sf_dir)
    return spark.read.parquet(f"{j.store.root}/{j.runs[1]['diffs']}").select("key", "side")


def _steps(spark, sf_dir):
    j = job(spark, sf_dir)
    return spark.createDataFrame([(i + 1, s["step"], s["status"], j.code) for i, s in enumerate(j.steps)], "no long, step string, status string, code long")


def _constraints(spark, sf_dir):
    j = job(spark, sf_dir)
    return co.after_check(j.store, j.plan.tables, j.target).where("group IN ('constraint', 'generated', 'probe')").select("group", "what", "detail")


def _view(spark, sf_dir):
    return co.job_view(job(spark, sf_dir).store).select("table_name", "status", F.col("chunks").cast("long").alias("chunks"), F.col("done").cast("long").alias("done"), "rows")


def _whole_view(spark, sf_dir):
    return co.full_view(job(spark, sf_dir).store).where("section = 'sync' AND name IN ('captured', 'applied', 'start_lsn', 'stream_lsn') OR section = 'job' AND name = 'job'")


def _leases(spark, sf_dir):
    store = job(spark, sf_dir).store
    with store.lock("look"):
        inside = store.held()
    return spark.createDataFrame([("inside", x) for x in inside] + [("outside", x) for x in store.held()], "at string, name string")


def _refused(spark, sf_dir):
    """VAL1: a NUL in the name of every fiftieth customer, copied under a rule that refuses it."""
    source = _source(spark, sf_dir)
    bad = lambda t: source(t).withColumn("c_name", F.when(F.col("c_custkey") % 50 == 0, F.concat("c_name", F.lit("\x00"))).otherwise(F.col("c_name")))
    plan = planner.plan(CATALOG, R.load(RULES), include=["dbo.customer"])
    with scratch_store(spark) as store:
        n = source(plan.tables[0]).count()
        Loader(store, plan.tables, bad, rows_per_chunk=max(1, -(-n // 4)), chunks_at_once=4).run()
        found = [(r["chunk_no"], r["status"], r["error"]) for r in chunk_states(store, "customer").collect()]  # four ranges
    return spark.createDataFrame(found, "chunk_no long, status string, error string")


def _assembled(spark, sf_dir):
    """SRC6: the catalog put together from the rows of a column list."""
    rows = [("main", t, i + 1, f.name, f.dataType.simpleString()) for t in ("customer", "nation", "orders", "region") for i, f in enumerate(table(spark, sf_dir, t).schema)]
    found = system.assemble("shop", spark.createDataFrame(rows, "schema string, table string, ordinal int, name string, type string"))
    return spark.createDataFrame([(t.name, c.ordinal, c.name) for t in found.tables for c in t.columns], "table_name string, ordinal long, column_name string")


def _chunk_counts(spark, sf_dir):
    kinds = {"orders": ("bigint",), "customer": ("bigint",), "lineitem": ("bigint", "int"), "documents": ("xml",), "events": ()}
    return spark.createDataFrame([(t, C.chunk_count(table(spark, sf_dir, t).count(), 100, k)) for t, k in kinds.items()], "table_name string, chunks long")


def _bounds(spark, sf_dir):
    """CHK4: the least and greatest keys as texts and back."""
    lo, hi, first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey"), F.min(F.col("o_orderdate").cast("timestamp_ntz"))).first()
    back = lambda v, kind: C.bound_value(C.bound_text(v), kind)
    return spark.range(1).select(back(lo, "bigint").alias("lo"), back(hi, "bigint").alias("hi"), F.date_format(back(first, "datetime2"), "yyyy-MM-dd HH:mm:ss").alias("first"))


def _short_names(spark, sf_dir):
    long = [r["n"] for r in table(spark, sf_dir, "nation").select(F.concat(F.lit("index_of_"), F.repeat("n_name", F.col("n_nationkey") % 9 + 1)).alias("n")).collect()]
    return spark.createDataFrame([(n, names.shortened(n)) for n in long], "name string, short string")


def _resolved(spark, sf_dir):
    base = ValueRule(nul_char="strip", trailing_space="rtrim", sentinel="null")
    rows = [(t, r.nul_char, r.trailing_space, r.sentinel) for t in normalize.TYPES for r in [resolve(t, base, {"trailing_space": "keep"})]]
    return spark.createDataFrame(rows, "type string, nul_char string, trailing_space string, sentinel string")


def _refused_types(spark, sf_dir):
    """NRM17: what no canonical text is known for is refused when the plan is made."""
    def refused(t: str) -> bool:
        try:
            normalize.canonical(F.lit(None), t)
            return False
        except ValueError:
            return True

    names_ = [r["n"] for r in table(spark, sf_dir, "nation").select(F.lower("n_name").alias("n")).collect()]
    return spark.createDataFrame([(t, refused(t)) for t in (*normalize.TYPES, *names_, "sql_variant", "geography")], "type string, refused boolean")


def _messages(spark, sf_dir):
    """MSC7: no value of a row leaves by an error message."""
    rows = table(spark, sf_dir, "nation").collect()
    return spark.createDataFrame([(r["n_nationkey"], safe(f"duplicate key value '{r['n_name']}' in column \"{r['n_name']}\" Key (n_name)=({r['n_name']})\nat line 2")) for r in rows], "n_nationkey int, message string")


def _sequences(spark, sf_dir):
    """PLN9: bounds cut to 64 bits."""
    found = tuple(Sequence("dbo", f"s{r['n_nationkey']}", "numeric", 1, 1, -(10 ** r["n_nationkey"]), 10 ** r["n_nationkey"]) for r in table(spark, sf_dir, "nation").collect())
    plan = planner.plan(Catalog("x", (), found), R.load({}))
    return spark.createDataFrame([(name, str(s.minimum), str(s.maximum)) for s, _, name in plan.sequences], "name string, low string, high string")


def _claimed(spark, sf_dir):
    """PLN10: names of one schema; a second comer is named after its table."""
    space = names.Namespace()
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return spark.createDataFrame([(r["n_nationkey"], space.claim(f"ix_{r['n_regionkey']}", r["n_name"].lower())) for r in rows], "n_nationkey int, name string")


def _created(spark, sf_dir):
    """SNK4, SNK6, MUT8: registered tables of a new state, and what a reset leaves of a loaded one."""
    plan, source = planner.plan(CATALOG, R.load(RULES), include=["dbo.nation"]), _source(spark, sf_dir)
    with scratch_store(spark, None) as store:
        rows = [("created", n, store.manifest()["tables"]) for n in create_tables(store, plan.tables)]
        rows = [(what, n, store.manifest()["tables"][n]["status"], 0) for what, n, _ in rows]
        Loader(store, plan.tables, source).run()
        applier = sync.Applier(store, plan.tables)
        rows += [("loaded", n, s["status"], applier.read(n).count()) for n, s in store.manifest()["tables"].items()]
        sync.reset(store)
        rows += [("reset", n, s["status"], applier.read(n).count()) for n, s in store.manifest()["tables"].items()]
    return spark.createDataFrame(rows, "step string, table_name string, status string, rows long")


_TYPES = ", ".join(f"('{t}')" for t in normalize.TYPES)
_in = lambda kinds: "(" + ", ".join(f"'{t}'" for t in sorted(kinds)) + ")"
_plain = ValueRule()

_AT = "lower(lpad(to_hex({}), 8, '0')) || ':00000000:0001'"
_BALANCE = "CAST(c_acctbal AS DECIMAL(19,4))"
_EVENTS = f"""(SELECT {_AT.format("c_custkey + 1")} AS lsn, 'u' AS op, c_custkey AS k, CAST({_BALANCE} + 1 AS DECIMAL(19,4)) AS b FROM customer WHERE c_custkey % 10 = 0
 UNION ALL SELECT {_AT.format("c_custkey + 1")}, 'd', c_custkey, NULL FROM customer WHERE c_custkey % 17 = 0 AND c_custkey % 10 <> 0
 UNION ALL SELECT {_AT.format(f"c_custkey + {_SHIFT}")}, 'c', c_custkey + {_SHIFT}, {_BALANCE} FROM customer WHERE c_custkey % 13 = 0)"""
_TARGET = f"""(SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN CAST({_BALANCE} + 1 AS DECIMAL(19,4)) ELSE {_BALANCE} END AS b, lower(c_mktsegment) AS c_tag FROM customer WHERE c_custkey % 17 <> 0 OR c_custkey % 10 = 0
 UNION ALL SELECT c_custkey + {_SHIFT}, c_name, {_BALANCE}, lower(c_mktsegment) FROM customer WHERE c_custkey % 13 = 0)"""
_FOUR = """(SELECT row_number() OVER (ORDER BY start) - 1 AS chunk_no, CASE WHEN i > 0 THEN start END AS lower, lead(start) OVER (ORDER BY start) AS upper FROM
 (SELECT CAST(lo + (hi - lo + 1) * i // n AS BIGINT) AS start, i FROM (SELECT min(c_custkey)::HUGEINT AS lo, max(c_custkey)::HUGEINT AS hi, ceil(count(*) / ceil(count(*) / 4))::BIGINT AS n FROM customer), range(4) AS r(i) WHERE i < n))"""
_INSIDE = "(lower IS NULL OR c_custkey >= lower) AND (upper IS NULL OR c_custkey < upper)"

QUERIES = {
    "snk1_bulk_copy_customer": (_bulk, f"SELECT c_custkey, c_name, c_nationkey, {_BALANCE}::VARCHAR AS c_acctbal, c_mktsegment, lower(c_mktsegment) AS c_tag FROM customer"),
    "wfl3_ranges_customer": (_ranges, f"SELECT chunk_no, lower, upper, 'DONE' AS status, count(c_custkey) AS rows, 1::BIGINT AS attempts FROM {_FOUR} b LEFT JOIN customer ON {_INSIDE} GROUP BY chunk_no, lower, upper"),
    "snk2_captured_log": (_log, f"SELECT lsn AS commit_lsn, 1::BIGINT AS event_serial_no, op, 'customer' AS table_name, b::VARCHAR AS acctbal FROM {_EVENTS}"),
    "src8_envelopes": (
        lambda s, d: envelope.batch(s, job(s, d).changes).groupBy("op", "table_name").agg(F.count("*").alias("n"), F.min("commit_lsn").alias("first"), F.max("commit_lsn").alias("last")),
        f"SELECT op, 'dbo.customer' AS table_name, count(*) AS n, min(lsn) AS first, max(lsn) AS last FROM {_EVENTS} GROUP BY op",
    ),
    "snk3_applied_customer": (_applied, f"SELECT c_custkey, c_name, b::VARCHAR AS c_acctbal, c_tag FROM {_TARGET}"),
    "str5_positions": (_positions, f"SELECT min(lsn) AS start_lsn, max(lsn) AS stream_lsn, max(lsn) AS applied_lsn, true AS drained, 0::BIGINT AS left_in_log, max(lsn) AS source_lsn, '2026-01-01 00:00:00.000000' AS source_at, min(lsn) AS log_from FROM {_EVENTS}"),
    "str4_status": (_status, f"SELECT 0::BIGINT AS pending, 0::BIGINT AS waiting_for_load, count(*) AS captured, count(*) AS applied, 0::BIGINT AS marked_pending, count(*) AS marked_applied, max(lsn) AS marked_lsn, '2026-01-01 00:00:00' AS src_max_at FROM {_EVENTS}"),
    "snk7_verify_results": (
        _results,
        f"""WITH t AS (SELECT 1 AS run_id, 'customer' AS table_name, count(*) AS sn, count(*) AS tn, sum(c_custkey) AS ss, sum(c_custkey) AS ts FROM customer
        UNION ALL SELECT 2, 'customer', (SELECT count(*) FROM customer), count(*), (SELECT sum(c_custkey) FROM customer), sum(c_custkey) FROM {_TARGET}
        UNION ALL SELECT r, 'nation', count(*), count(*), sum(n_nationkey), sum(n_nationkey) FROM nation, (VALUES (1), (2)) AS v(r) GROUP BY r)
        SELECT run_id::BIGINT AS run_id, table_name, 'count' AS check_kind, '*' AS check_target, sn::VARCHAR AS src_value, tn::VARCHAR AS tgt_value, sn = tn AS matched FROM t
        UNION ALL SELECT run_id, table_name, 'sum', CASE table_name WHEN 'nation' THEN 'n_nationkey' ELSE 'c_custkey' END, ss::VARCHAR, ts::VARCHAR, ss = ts FROM t""",
    ),
    "snk7_verify_diffs": (
        _diffs,
        f"""SELECT coalesce(s.c_custkey, t.c_custkey)::VARCHAR AS key, CASE WHEN t.c_custkey IS NULL THEN 'missing' WHEN s.c_custkey IS NULL THEN 'extra' ELSE 'diff' END AS side
        FROM customer s FULL JOIN {_TARGET} t ON s.c_custkey = t.c_custkey WHERE CAST(s.c_acctbal AS DECIMAL(19,4)) IS DISTINCT FROM t.b OR s.c_custkey IS NULL OR t.c_custkey IS NULL ORDER BY key, side LIMIT 100""",
    ),
    "wfl6_switch_steps": (
        _steps,
        f"""SELECT no::BIGINT AS no, step, 'DONE' AS status, (SELECT CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 0 ELSE 5 END FROM {_TARGET})::BIGINT AS code
        FROM (VALUES (1, 'drain'), (2, 'reload'), (3, 'post_load'), (4, 'verify'), (5, 'setval'), (6, 'foreign_keys')) AS t(no, step)""",
    ),
    "wfl7_after_switch": (
        _constraints,
        f"""SELECT 'constraint' AS group, 'customer.pk_customer' AS what, count(*)::VARCHAR || ' violations' AS detail FROM (SELECT c_custkey FROM {_TARGET} GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'constraint', 'customer.uq_customer', count(*)::VARCHAR || ' violations' FROM (SELECT c_name, c_custkey FROM {_TARGET} GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'constraint', 'customer.fk_nation', count(*)::VARCHAR || ' violations' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
        UNION ALL SELECT 'generated', 'customer: c_tag', count(*)::VARCHAR || ' rows' FROM {_TARGET} t JOIN customer c USING (c_name) WHERE c_tag IS DISTINCT FROM lower(c_mktsegment)
        UNION ALL SELECT 'probe', 'customer', ''""",
    ),
    "wfl8_tables": (
        _view,
        f"SELECT 'customer' AS table_name, 'LOADED' AS status, (SELECT count(*) FROM {_FOUR}) AS chunks, (SELECT count(*) FROM {_FOUR}) AS done, count(*) AS rows FROM customer UNION ALL SELECT 'nation', 'LOADED', 1, 1, count(*) FROM nation",
    ),
    "wfl8_state": (
        _whole_view,
        f"""SELECT 'job' AS section, 'job' AS name, 'DONE' AS value UNION ALL SELECT 'sync', 'captured', count(*)::VARCHAR FROM {_EVENTS} UNION ALL SELECT 'sync', 'applied', count(*)::VARCHAR FROM {_EVENTS}
        UNION ALL SELECT 'sync', 'start_lsn', min(lsn) FROM {_EVENTS} UNION ALL SELECT 'sync', 'stream_lsn', max(lsn) FROM {_EVENTS}""",
    ),
    "str10_leases": (_leases, "SELECT 'inside' AS at, 'look' AS name"),
    "val1_refused_ranges": (
        _refused,
        f"""SELECT chunk_no, CASE WHEN n > 0 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN n > 0 THEN 'NUL characters in c_name (' || n || ' rows)' END AS error
        FROM (SELECT chunk_no, count(*) FILTER (c_custkey % 50 = 0) AS n FROM {_FOUR} b LEFT JOIN customer ON {_INSIDE} GROUP BY chunk_no)""",
    ),
    "src6_assembled_catalog": (_assembled, "SELECT table_name, ordinal_position::BIGINT AS ordinal, column_name FROM information_schema.columns WHERE table_name IN ('customer', 'nation', 'orders', 'region')"),
    "chk3_range_counts": (
        _chunk_counts,
        "SELECT 'orders' AS table_name, ceil(count(*) / 100)::BIGINT AS chunks FROM orders UNION ALL SELECT 'customer', ceil(count(*) / 100)::BIGINT FROM customer UNION ALL SELECT 'lineitem', ceil(count(*) / 100)::BIGINT FROM lineitem UNION ALL SELECT 'documents', 1 UNION ALL SELECT 'events', 1",
    ),
    "chk4_bound_texts": (_bounds, "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first FROM orders"),
    "hsh4_settings_fingerprint": (
        lambda s, d: s.createDataFrame([(r["r_name"], config.fingerprint({"job": r["r_name"]}, {"key": r["r_regionkey"]})) for r in table(s, d, "region").collect()], "job string, mark string"),
        """SELECT r_name AS job, sha256('[{"job": "' || r_name || '"}, {"key": ' || r_regionkey || '}]') AS mark FROM region""",
    ),
    "hsh5_short_names": (
        _short_names,
        "SELECT name, CASE WHEN length(name) <= 63 THEN name ELSE left(name, 54) || '_' || left(sha256(name), 8) END AS short FROM (SELECT 'index_of_' || repeat(n_name, n_nationkey % 9 + 1) AS name FROM nation)",
    ),
    "val11_resolved_rules": (
        _resolved,
        f"""SELECT type, CASE WHEN type IN {_in(TEXT_TYPES)} THEN 'strip' ELSE '{_plain.nul_char}' END AS nul_char, CASE WHEN type IN {_in(TEXT_TYPES)} THEN 'keep' ELSE '{_plain.trailing_space}' END AS trailing_space,
        CASE WHEN type IN {_in(DATE_TYPES | {"time"})} THEN 'null' ELSE '{_plain.sentinel}' END AS sentinel FROM (VALUES {_TYPES}) AS t(type)""",
    ),
    "nrm12_instants": (
        lambda s, d: table(s, d, "events").select("event_id", normalize.canonical(F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00")), "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"), "datetimeoffset").alias("instant")),
        "SELECT event_id, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS instant FROM events",
    ),
    "nrm17_refused_types": (_refused_types, f"SELECT type, false AS refused FROM (VALUES {_TYPES}) AS t(type) UNION ALL SELECT lower(n_name), true FROM nation UNION ALL VALUES ('sql_variant', true), ('geography', true)"),
    "msc7_safe_messages": (_messages, "SELECT n_nationkey, 'duplicate key value ? in column ? Key (n_name)?' AS message FROM nation"),
    "pln9_sequence_bounds": (
        _sequences,
        "SELECT 's' || n_nationkey AS name, greatest(-(10::HUGEINT ** n_nationkey)::HUGEINT, -9223372036854775808)::VARCHAR AS low, least((10::HUGEINT ** n_nationkey)::HUGEINT, 9223372036854775807)::VARCHAR AS high FROM nation",
    ),
    "pln10_claimed_names": (_claimed, "SELECT n_nationkey, 'ix_' || n_regionkey || CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1 THEN '_' || lower(n_name) ELSE '' END AS name FROM nation"),
    "snk6_created_and_reset": (_created, "SELECT 'created' AS step, 'nation' AS table_name, 'PLANNED' AS status, 0::BIGINT AS rows UNION ALL SELECT 'loaded', 'nation', 'LOADED', count(*) FROM nation UNION ALL SELECT 'reset', 'nation', 'PLANNED', 0"),
    "nrm13_clock_texts": (
        lambda s, d: table(s, d, "events").select("event_id", normalize.canonical(F.date_format("ts", "HH:mm:ss.SSSSSS"), "time").alias("clock")),
        "SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS clock FROM events",
    ),
    "nrm16_xml_texts": (
        lambda s, d: table(s, d, "nation").select("n_nationkey", normalize.canonical(F.concat(F.lit("<n>"), "n_name", F.lit("</n>")), "xml").alias("text"), F.lit(normalize.note("xml")).alias("note"), F.lit(normalize.note("text")).alias("none")),
        "SELECT n_nationkey, '<n>' || n_name || '</n>' AS text, 'xml text may differ though the documents are equal' AS note, NULL::VARCHAR AS none FROM nation",
    ),
}
