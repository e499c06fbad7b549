"""Verification runs and the switch to the target (WFL4-WFL9, SNK7, MUT9, MUT10, JOIN11)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.operators import constraints, sequences, verify
from concordia.plans import planner
from concordia.plans.load import Loader, chunk_states, safe
from concordia.plans.model import TablePlan
from concordia.sources.store import Lease, Store, log_event, require

#: WFL9.
OK, BAD_CONFIG, NO_CONNECTION, BLOCKED, REFUSED, FAILED, TIMED_OUT = range(7)
RESULT = "run_id long, table_name string, check_kind string, check_target string, src_value string, tgt_value string, matched boolean"
DIFF = "run_id long, table_name string, key string, side string"


def spec_of(plan: TablePlan) -> verify.TableSpec:
    """What is compared of a table; source and target are both given under the target's names."""
    return verify.TableSpec(plan.name, tuple(verify.ColumnSpec(c.name, c.source.type, c.source.scale, c.rule) for c in plan.load_columns), tuple(plan.key))


def verify_run(store: Store, plans: list[TablePlan], source: Callable[[TablePlan], DataFrame], target: Callable[[TablePlan], DataFrame], keep_diffs: int = 100) -> dict:
    """WFL5: every table's checks, and the first differing keys where count or hash differ; an error is its table's result."""
    run_id = len(store.manifest()["runs"]) + 1
    results, diffs, errors = [], [], {}
    for plan in plans:
        try:
            spec = spec_of(plan)
            s = source(plan).select(*[F.col(c.source.name).alias(c.name) for c in plan.load_columns])
            t = target(plan).select(*[c.name for c in plan.load_columns])
            rows = verify.checks(s, t, spec).collect()  # a few rows
            results += [(run_id, plan.name, r["check_kind"], r["check_target"], _text(r["src_value"]), _text(r["tgt_value"]), r["matched"]) for r in rows]
            if any(not r["matched"] for r in rows if r["check_kind"] != "sum") and plan.key:
                found = verify.first_diffs(verify.row_diff(s, t, spec), keep_diffs)
                diffs += [(run_id, plan.name, r["key"], r["side"]) for r in found.collect()]
        except Exception as e:
            errors[plan.name] = safe(e)
    paths = {"results": store.save(store.spark.createDataFrame(results, RESULT), "verify_result"), "diffs": store.save(store.spark.createDataFrame(diffs, DIFF), "verify_diff")}
    mismatches = sum(not r[-1] for r in results) + len(errors)
    run = {"run_id": run_id, "checks": len(results), "mismatches": mismatches, "errors": errors, "status": "MATCHED" if not mismatches else "MISMATCHED", **paths}
    store.commit(lambda s: s["runs"].append(run))
    return run


def _text(v) -> str | None:
    return None if v is None else format(v.normalize(), "f")


class Cutover:
    """WFL6: the steps in order; the first failure stops, a later run starts over and every step may be done again."""

    STEPS = ("drain", "reload", "post_load", "verify", "setval", "foreign_keys")

    def __init__(
        self, store: Store, plans: list[TablePlan], source: Callable[[TablePlan], DataFrame], target: Callable[[TablePlan], DataFrame], drain: Callable[[], bool],
        sequence_state: Callable[[], DataFrame] | None = None,
    ) -> None:
        self.store, self.plans, self.source, self.target, self._drain, self.sequence_state = store, plans, source, target, drain, sequence_state
        self.writer: Store | Lease = store

    def run(self) -> tuple[int, list[dict]]:
        with self.store.lock("cutover") as self.writer:
            self.writer.commit(self._begin)
            steps, code = [], OK
            for name in self.STEPS:
                self._record(name, "RUNNING")
                began = time.monotonic()
                try:
                    problem, code = getattr(self, name)()
                except Exception as e:
                    problem, code = safe(e), FAILED
                steps.append({"step": name, "status": "FAILED" if problem else "DONE", "seconds": round(time.monotonic() - began, 3), "detail": problem})
                self._record(name, steps[-1]["status"])
                if problem:
                    break
            ok = code == OK
            self.writer.commit(lambda s: s.update(job="DONE" if ok else "FAILED", cutover=steps))
            return code, steps

    @staticmethod
    def _begin(s: dict) -> None:
        require(s, "cutover")
        s["job"] = "CUTOVER"

    def _record(self, step: str, status: str) -> None:
        self.writer.commit(lambda s: log_event(s, "INFO", f"cutover {step} {status}"))

    def drain(self) -> tuple[str | None, int]:
        return (None, OK) if self._drain() else ("changes still arrive", TIMED_OUT)

    def reload(self) -> tuple[str | None, int]:
        """Tables without a key get no changes: they are copied again."""
        bare = [p for p in self.plans if not p.key]
        if not bare:
            return None, OK

        def clear(s: dict) -> None:
            for p in bare:
                s["chunks"].pop(p.name.lower(), None)
                s["tables"][p.name.lower()] = {"status": "PLANNED", "files": None}

        self.writer.commit(clear)
        loader = Loader(self.store, bare, self.source, writer=self.writer)
        bad = [p.name for p in bare if loader._table(p) != "LOADED"]
        return (f"not loaded: {', '.join(bad)}", FAILED) if bad else (None, OK)

    def post_load(self) -> tuple[str | None, int]:
        """WFL4: the unique keys and checks that the target would now create hold."""
        bad = [name for name, rows in unique_and_checks(self.plans, self.target) if rows.limit(1).count()]
        return (f"violated: {', '.join(bad)}", FAILED) if bad else (None, OK)

    def verify(self) -> tuple[str | None, int]:
        run = verify_run(self.store, self.plans, self.source, self.target)
        return (f"{run['mismatches']} mismatches in run {run['run_id']}", FAILED) if run["mismatches"] else (None, OK)

    def setval(self) -> tuple[str | None, int]:
        if self.sequence_state is not None:
            t = self.sequence_state()
            chosen = t.select("sequence", sequences.next_value(F.col("last"), F.col("seed"), F.col("increment"), F.col("target_end")).alias("next_value")).collect()  # a row per sequence
            self.writer.commit(lambda s: s.update(sequences={r["sequence"]: {"value": int(r["next_value"]), "is_called": False} for r in chosen}))
        return None, OK

    def foreign_keys(self) -> tuple[str | None, int]:
        bad = [name for name, rows in references(self.plans, self.target) if rows.limit(1).count()]
        return (f"violated: {', '.join(bad)}", FAILED) if bad else (None, OK)


def unique_and_checks(plans: list[TablePlan], target: Callable[[TablePlan], DataFrame]) -> list[tuple[str, DataFrame]]:
    """Each unique key and check by name, with the rows or keys that violate it."""
    out = []
    for p in plans:
        df, new = planner.collated(target(p), p), {c.source.name: c.name for c in p.columns}
        folded = {c.source.name for c in p.columns if c.source.case_insensitive and not planner.spark_collation(c)}
        for i in p.source.indexes:
            keys = [k for k, _ in i.keys if k in new]
            if i.kind != "INDEX" and keys:
                out.append((f"{p.name}.{i.name}", constraints.duplicates(df, [new[k] for k in keys], [new[k] for k in keys if k in folded])))
        out += [(f"{p.name}.{c.name}", df.where(~F.expr(c.check.replace('"', "`")))) for c in p.columns if c.check]
    return out


def references(plans: list[TablePlan], target: Callable[[TablePlan], DataFrame]) -> list[tuple[str, DataFrame]]:
    """Each foreign key by name, with the rows that have no parent."""
    by_source, out = {p.source.full.lower(): p for p in plans}, []
    for p in plans:
        new = {c.source.name: c.name for c in p.columns}
        for f in p.source.foreign_keys:
            parent = by_source.get(f.ref_table.lower())
            if parent is None or f.disabled:
                continue
            ref = {c.source.name: c.name for c in parent.columns}
            out.append((f"{p.name}.{f.name}", constraints.orphans(planner.collated(target(p), p), planner.collated(target(parent), parent), [(new[a], ref[b]) for a, b in zip(f.columns, f.ref_columns, strict=True)])))
    return out


def probe_faults(p: TablePlan, df: DataFrame) -> list[str]:
    """MUT9: columns whose NOT NULL, check or generated value the row of a test insert would break; nothing is written."""
    key = p.key[0]
    if df.schema[key].dataType.typeName() not in ("long", "integer", "short"):
        return []
    row = constraints.probe(df, {}, key)
    wrong = {}
    for c in p.columns:
        bad = F.lit(False)
        if not c.source.nullable:
            bad = bad | F.col(c.name).isNull()
        if c.check:
            bad = bad | ~F.coalesce(F.expr(c.check.replace('"', "`")), F.lit(True))
        if c.generated:
            bad = bad | ~F.expr(f"`{c.name}` <=> CAST(({c.generated}) AS {_ddl(c)})")
        wrong[c.name] = bad
    got = row.select(*[F.coalesce(b, F.lit(False)).alias(n) for n, b in wrong.items()]).first()
    return [] if got is None else [n for n in wrong if got[n]]


def after_check(store: Store, plans: list[TablePlan], target: Callable[[TablePlan], DataFrame]) -> DataFrame:
    """WFL7: what to look at after the switch: ``(group, level, what, detail)``."""
    state, rows = store.manifest(), []
    rows.append(("job", "OK" if state.get("job") == "DONE" else "ERROR", "state", state.get("job", "PLANNED")))
    if state["runs"]:
        last = state["runs"][-1]
        rows.append(("verify", "OK" if last["status"] == "MATCHED" else "ERROR", f"run {last['run_id']}", f"{last['mismatches']} of {last['checks']}"))
    for name, s in sorted(state.get("sequences", {}).items()):
        rows.append(("next value", "OK", name, str(s["value"])))
    for p in plans:
        generated = [c.name for c in p.columns if c.generated]
        if generated:
            wrong = target(p).where(" OR ".join(f"NOT (`{c.name}` <=> CAST(({c.generated}) AS {_ddl(c)}))" for c in p.columns if c.generated)).count()
            rows.append(("generated", "OK" if not wrong else "ERROR", f"{p.name}: {', '.join(generated)}", f"{wrong} rows"))
        if p.key:
            faults = probe_faults(p, target(p))
            rows.append(("probe", "OK" if not faults else "ERROR", p.name, ", ".join(faults)))
        rows += [("manual", "WARN", f"{p.source.full}", f"trigger {t}") for t in p.source.triggers]
    for name, bad in [*unique_and_checks(plans, target), *references(plans, target)]:
        n = bad.count()
        rows.append(("constraint", "OK" if not n else "ERROR", name, f"{n} violations"))
    return store.spark.createDataFrame(rows, "group string, level string, what string, detail string")


def _ddl(c) -> str:
    return planner.spark_type(c.type).simpleString()


def job_view(store: Store) -> DataFrame:
    """WFL8: a row per table: status, ranges, rows, position."""
    state, rows, counts = store.manifest(), [], None
    for t, s in sorted(state["tables"].items()):
        rows.append((t, s["status"], (state["positions"].get(t) or [None])[0]))
        if t in state["chunks"]:
            done = F.col("status") == "DONE"
            one = chunk_states(store, t, state).agg(F.count("*").cast("int").alias("chunks"), F.count_if(done).cast("int").alias("done"), F.count_if(F.col("status") == "FAILED").cast("int").alias("failed"), F.coalesce(F.sum(F.when(done, F.col("rows"))), F.lit(0)).alias("rows"))
            one = one.select(F.lit(t).alias("table_name"), "*")
            counts = one if counts is None else counts.unionByName(one)
    tables = store.spark.createDataFrame(rows, "table_name string, status string, applied_lsn string")
    if counts is None:
        counts = store.spark.createDataFrame([], "table_name string, chunks int, done int, failed int, rows long")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "done", "failed", "rows")]
    return tables.join(counts, "table_name", "left").select("table_name", "status", *zero, "applied_lsn")


def full_view(store: Store) -> DataFrame:
    """WFL8: all of a job's state in rows of (section, name, value): job, synchronisation, verification, switch, leases, last events."""
    state = store.manifest()
    rows = [("job", k, str(state.get(k))) for k in ("job", "version", "fingerprint")]
    rows += [("sync", k, str(state.get(k))) for k in ("start_lsn", "stream_lsn", "src_max_at", "captured", "applied")]
    rows += [("sync", f"watermark {k}", str(v)) for k, v in sorted((state.get("watermark") or {}).items())]
    rows += [("verify", f"run {r['run_id']}", f"{r['status']}: {r['mismatches']} of {r['checks']}") for r in state["runs"][-3:]]
    rows += [("cutover", x["step"], x["status"] + (f": {x['detail']}" if x["detail"] else "")) for x in state.get("cutover", [])]
    rows += [("lease", n, v["owner"]) for n, v in sorted(state["leases"].items()) if n in store.held(state)]
    rows += [("event", str(e[0]), f"{e[1]} {e[2]}") for e in state["events"][-15:]]
    return store.spark.createDataFrame(rows, "section string, name string, value string")
