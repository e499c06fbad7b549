"""Command line: status, init, plan, schema, load, sync, verify, cutover, check, reset, vacuum (WFL9, WFL10).

Sources are folders of Parquet tables with the catalog as JSON beside them, or databases read by
JDBC with the catalog in a file; changes are envelopes in a folder.
"""

from __future__ import annotations

import argparse
import json
import sys
from decimal import Decimal
from pathlib import Path

from concordia.operators import sequences
from concordia.plans import cutover as co
from concordia.plans import ddl, planner
from concordia.plans import rules as R
from concordia.plans.load import Loader, create_tables, explained, safe
from concordia.plans.model import Catalog, Column, ForeignKey, Index, Sequence, Table
from concordia.sources import config as cfg
from concordia.sources import tables as sources
from concordia.sources.log import SourceLog
from concordia.sources.store import Lease, Refused, Store
from concordia.streaming import sync

COMMANDS = ("status", "init", "plan", "schema", "load", "sync", "verify", "cutover", "check", "reset", "vacuum")


def catalog_of(raw: dict) -> Catalog:
    def table(t: dict) -> Table:
        cols = tuple(Column(**{k: tuple(v) if k in ("identity", "default") and v else v for k, v in c.items()}) for c in t["columns"])
        idx = tuple(Index(i["name"], i["kind"], tuple((k, bool(d)) for k, d in i["keys"]), tuple(i.get("includes", ())), i.get("filter")) for i in t.get("indexes", ()))
        fks = tuple(ForeignKey(**f | {"columns": tuple(f["columns"]), "ref_columns": tuple(f["ref_columns"])}) for f in t.get("foreign_keys", ()))
        return Table(t["schema"], t["name"], cols, idx, fks, tuple(map(tuple, t.get("checks", ()))), tuple(t.get("triggers", ())), t.get("rows_estimate", 0))

    return Catalog(raw.get("database", ""), tuple(table(t) for t in raw["tables"]), tuple(Sequence(**s) for s in raw.get("sequences", ())), tuple(map(tuple, raw.get("other_objects", ()))))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("concordia")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--config", default="concordia.json")
    p.add_argument("--out", default="plan")
    p.add_argument("--tables", nargs="*")
    p.add_argument("--replace", action="store_true")
    p.add_argument("--reset", action="store_true", help="with load: empty the tables first")
    p.add_argument("--no-changes", action="store_true", help="with load: nothing writes to the source, so no capture has to run")
    p.add_argument("--once", action="store_true", help="with sync: take what is there and end, without proof that the source is quiet")
    p.add_argument("--max-wait", type=float, default=600)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return co.OK if e.code == 0 else co.BAD_CONFIG
    try:
        c = cfg.load(a.config)
        rules = R.load(c["rules"])
        catalog = catalog_of(json.loads(Path(c["catalog"] or f"{c['source']}/catalog.json").read_text(encoding="utf-8")))
    except (cfg.ConfigError, R.RuleError, OSError, KeyError, TypeError, json.JSONDecodeError) as e:
        print(safe(e), file=sys.stderr)
        return co.BAD_CONFIG
    plan = planner.plan(catalog, rules, c["include"], c["exclude"])
    if a.command == "plan":
        ddl.write(plan, a.out)
        print(ddl.report(plan), end="")
        return co.BLOCKED if plan.blocked else co.OK
    if plan.blocked:
        print(ddl.report(plan), end="", file=sys.stderr)
        return co.BLOCKED
    try:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"concordia {c['job']}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    except Exception as e:
        print(safe(e), file=sys.stderr)
        return co.NO_CONNECTION
    try:
        return _run(a, c, rules, plan, Store(spark, f"{c['state']}/{c['job']}"))
    except Refused as e:
        print(e, file=sys.stderr)
        return co.REFUSED
    except Exception as e:
        print(explained(e), file=sys.stderr)
        return co.FAILED


def sequence_state(store: Store, plan, target):
    """AGG10, MSC6: a row per identity column and sequence: ``(sequence, last, seed, increment, target_end)``."""
    rows = []
    for p in plan.tables:
        for c in p.columns:
            if c.source.identity is not None:
                seed, step, last = c.source.identity
                rows.append((f"{p.schema}.{p.name}.{c.name}", last, seed, step, sequences.target_ends(target(p), c.name, step).first()[0]))
    rows += [(f"{schema}.{name}", s.current, s.start, s.increment, None) for s, schema, name in plan.sequences]
    rows = [tuple(None if v is None else v if isinstance(v, str) else Decimal(v) for v in r) for r in rows]
    return store.spark.createDataFrame(rows, "sequence string, last decimal(38,0), seed decimal(38,0), increment decimal(38,0), target_end decimal(38,0)")


def _run(a, c: dict, rules: dict, plan, store: Store) -> int:
    spark, plans = store.spark, plan.tables
    if a.tables:
        plans = [t for t in plans if t.name in a.tables or t.source.full in a.tables]
    source = sources.reader(spark, c["source"], c["jdbc"])
    mark = cfg.fingerprint(c, rules)
    applier = sync.Applier(store, plan.tables, c["rows_per_bucket"], c["batch_size"])
    target = lambda t: applier.read(t.name)
    log = None
    if c["log"]:
        log = SourceLog.jdbc(spark, c["log"], c["jdbc"]) if c["log"].startswith("jdbc:") else SourceLog.folder(spark, c["log"])
    capture = sync.Capture(store, plan.tables, source=log, fingerprint=mark)
    changes = c["changes"] or f"{c['source']}/changes"
    captured = lambda: capture.run(changes, f"{store.root}/checkpoint").awaitTermination()

    def drain(writer: Lease) -> bool:
        capture.writer = applier.writer = writer
        return sync.drain(captured, applier, a.max_wait, source=log)

    if a.command == "init":
        store.commit(lambda s: s.update(job=s.get("job", "PLANNED"), fingerprint=mark))
    elif a.command == "schema":
        create_tables(store, plans, a.replace)
    elif a.command == "status":
        source_log = {"source": vars(log.snapshot()) | {"log_from": log.oldest(), "log_reuse_wait": log.reuse_wait()}} if log else {}
        print(json.dumps({"job": store.manifest().get("job", "PLANNED"), **applier.status(), **source_log, "tables": [r.asDict() for r in co.job_view(store).collect()], "state": [list(r) for r in co.full_view(store).collect()]}, indent=1))
    elif a.command == "load":
        if a.reset:
            sync.reset(store, [p.name for p in plans])
        loader = Loader(store, plans, source, c["rows_per_chunk"], c["table_parallelism"], c["chunks_per_table"], c["pause_seconds"], after_start=not a.no_changes, fingerprint=mark)
        return co.FAILED if any(v != "LOADED" for v in loader.run().values()) else co.OK
    elif a.command == "sync":
        with store.lock("sync") as lease:
            capture.writer = applier.writer = lease
            with sync.ticking(applier, c["status_seconds"]):
                if not a.once:
                    return co.OK if drain(lease) else co.TIMED_OUT
                captured()
                while applier.step():
                    pass
    elif a.command == "verify":
        run = co.verify_run(store, plans, source, target)
        print(json.dumps(run))
        return co.FAILED if run["mismatches"] else co.OK
    elif a.command == "cutover":
        switch = co.Cutover(store, plan.tables, source, target, lambda: drain(switch.writer), lambda: sequence_state(store, plan, target))
        code, steps = switch.run()
        print(json.dumps(steps, indent=1))
        return code
    elif a.command == "check":
        rows = co.after_check(store, plan.tables, target).collect()
        print("\n".join(" | ".join(r) for r in rows))
        return co.FAILED if any(r["level"] == "ERROR" for r in rows) else co.OK
    elif a.command == "reset":
        sync.reset(store, a.tables)
    elif a.command == "vacuum":
        print(store.vacuum())
    return co.OK


if __name__ == "__main__":
    sys.exit(main())
