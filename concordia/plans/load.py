"""Copying tables in key ranges that can be resumed (WFL3, SRC7, SNK1, VAL1, PRJ1, CHK1-CHK4)."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from concordia.functions.values import TEXT_TYPES, has_nul, sentinel_value, text_rules
from concordia.operators import chunks as C
from concordia.plans.model import TablePlan
from concordia.plans.planner import spark_type
from concordia.sources.store import Lease, Lost, Refused, Store, log_event, require


def safe(message: str) -> str:
    """MSC7: an error's first line without literals, which may be values of rows."""
    line = str(message).strip().splitlines()[0] if str(message).strip() else "failed"
    return re.sub(r"'[^']*'|\"[^\"]*\"|=\s*\([^)]*\)", "?", line)[:300]


#: MSC8: what an error usually means.
HINTS = (
    (r"(?i)permission|access ?denied|not authorized", "the account lacks a right on the source or the state folder"),
    (r"(?i)no longer available|retention|purged|cleaned up", "the log no longer goes back to the stored position: reset and copy again"),
    (r"(?i)path.*(?:not exist|not found)|filenotfound|no such file", "a table's folder is missing"),
    (r"(?i)schema changed|column is absent", "the source's tables changed: plan again, reset and copy again"),
    (r"(?i)timed? ?out|connection (?:refused|reset)", "an endpoint can't be reached"),
)


def explained(message: str) -> str:
    """MSC8: the safe message with a hint, if there is one."""
    hint = next((h for pattern, h in HINTS if re.search(pattern, str(message))), None)
    return safe(message) + (f" ({hint})" if hint else "")


def create_tables(store: Store, plans: list[TablePlan], replace: bool = False) -> list[str]:
    """SNK6: register empty tables; ones that exist are refused, or emptied with ``replace``. Doing it again with the same plan is allowed while they are empty."""
    names = [p.name.lower() for p in plans]

    def create(s: dict) -> None:
        full = [n for n in names if s["tables"].get(n, {}).get("files")]
        if full and not replace:
            raise Refused(f"tables exist: {', '.join(full)}")
        for n in names:
            s["tables"][n] = {"status": "PLANNED", "files": None}
            s["chunks"].pop(n, None)
            s["positions"].pop(n, None)
        s["registered"] = {p.source.full: f"{p.schema}.{p.name}" for p in plans}
        s["job"] = "SCHEMA_DONE"
        log_event(s, "INFO", f"{len(names)} tables created")

    store.commit(create)
    return names


def converted(df: DataFrame, plan: TablePlan) -> DataFrame:
    """Loaded columns under target names and types, value rules applied."""
    def one(c) -> Column:
        v = F.col(c.source.name)
        if c.source.type in TEXT_TYPES:
            return text_rules(v, c.rule).alias(c.name)
        return sentinel_value(v, c.rule).cast(spark_type(c.type)).alias(c.name)

    return df.select(*[one(c) for c in plan.load_columns])


def with_generated(df: DataFrame, plan: TablePlan) -> DataFrame:
    """PLN4: generated columns computed from the copied ones, in the plan's order."""
    own = {c.name: F.expr(c.generated).cast(spark_type(c.type)) for c in plan.columns if c.generated}
    return df.withColumns(own).select(*[c.name for c in plan.columns]) if own else df.select(*[c.name for c in plan.columns])


def same_settings(s: dict, fingerprint: str | None) -> None:
    """HSH4: a job goes on under the settings and rules that it began with."""
    if fingerprint and s.get("fingerprint") and s["fingerprint"] != fingerprint:
        raise Refused("settings or rules differ from those that the job began with: go back to them, or reset and begin again")


CHUNK = "chunk_no long, status string, rows long, attempt int, error string, path string, epoch long"
_PLAN = "chunk_no long, lower array<string>, upper array<string>"


def chunk_states(store: Store, table: str, state: dict | None = None) -> DataFrame:
    """SRT5: a row per planned range: ``(chunk_no, lower, upper, status, rows, attempts, error, path, epoch)``, from a file for each attempt."""
    of = (state or store.manifest())["chunks"].get(table)
    if of is None:
        return store.spark.createDataFrame([], f"{_PLAN}, status string, rows long, attempts int, error string, path string, epoch long")
    folder = f"{store.root}/chunks/{table}/{of['load']}"
    plan = store.spark.read.schema(_PLAN).json(f"{folder}/plan.json")
    tries = store.spark.read.schema(CHUNK).json(f"{folder}/tries")
    last = tries.groupBy("chunk_no").agg(F.max_by(F.struct("status", "rows", "error", "path", "epoch"), F.struct("attempt", "status")).alias("x"), F.max("attempt").alias("attempts"))
    rows = plan.join(last, "chunk_no", "left")
    return rows.select(*plan.columns, F.coalesce("x.status", F.lit("PENDING")).alias("status"), "x.rows", F.coalesce("attempts", F.lit(0)).alias("attempts"), "x.error", F.coalesce("x.path", F.format_string(f"data/{table}/{of['load']}/%d", "chunk_no")).alias("path"), "x.epoch")


class Loader:
    """``writer`` is what publishes: the store itself, or the lease of whoever runs the loader.

    With ``after_start`` a load waits for the capture: it is refused until the log's start position is
    recorded, since changes made during the copy would be missed otherwise.  With ``fingerprint`` it is
    refused if the job began with other settings.
    """

    def __init__(
        self, store: Store, plans: list[TablePlan], source: Callable[[TablePlan], DataFrame], rows_per_chunk: int = 1_000_000, tables_at_once: int = 4, chunks_at_once: int = 2, pause: float = 0.0, lease: float = 60.0,
        after_start: bool = False, fingerprint: str | None = None, writer: Store | Lease | None = None,
    ) -> None:
        self.store, self.plans, self.source, self.writer = store, plans, source, writer or store
        self.rows_per_chunk, self.tables_at_once, self.chunks_at_once = rows_per_chunk, tables_at_once, chunks_at_once
        self.pause, self.lease = pause, lease  # seconds between two ranges of one worker, to spare the source
        self.after_start, self.fingerprint = after_start, fingerprint

    def run(self) -> dict[str, str]:
        """Table to status.  Ranges that are DONE are not copied again, also after a kill; a failed one leaves the others."""
        with self.store.lock("load", self.lease) as self.writer:
            self.writer.commit(self._begin)
            with ThreadPoolExecutor(self.tables_at_once) as pool:
                out = dict(zip([p.name for p in self.plans], pool.map(self._table, self.plans), strict=True))
            failed = any(v != "LOADED" for v in out.values())
            self.writer.commit(lambda s: s.update(job="FAILED" if failed else "SYNCING"))
            return out

    def _begin(self, s: dict) -> None:
        """WFL3: all that must hold before the first row is copied, judged in the state that the load's begin replaces."""
        require(s, "load")
        same_settings(s, self.fingerprint)
        if self.after_start and not s.get("start_lsn"):
            raise Refused("the log's start position is not recorded yet: start the synchronisation first, or load without changes")
        self._check_registered(s)
        s["job"] = "LOADING"

    def _check_registered(self, s: dict) -> None:
        """JOIN12: the plan must be the one the job began with."""
        known, now = s.get("registered"), {p.source.full: f"{p.schema}.{p.name}" for p in self.plans}
        if known is None:
            s["registered"] = now
        elif any(known.get(k) != v for k, v in now.items()):
            raise Refused("the plan differs from the registered tables")

    def _bounds(self, plan: TablePlan, df: DataFrame) -> list[list]:
        """Ranges as lists of texts; a single key of integers is split evenly, other keys by counts."""
        kinds = {c.source.name: c.source.type for c in plan.columns}
        key = [c.source.name for k in plan.key for c in plan.columns if c.name == k]
        n = C.chunk_count(df.count(), self.rows_per_chunk, [kinds[k] for k in key])
        if n <= 1:
            return [[None, None]]
        if len(key) == 1 and kinds[key[0]] in C.INTEGERS:
            low, high = df.agg(F.min(key[0]), F.max(key[0])).first()
            starts = [[str(x)] for x in C.even_starts(int(low), int(high), n)]
        else:
            starts = [[C.bound_text(r[k]) for k in key] for r in C.ntile_starts(df, key, n).orderBy("nt").collect()]  # n - 1 rows
        return [list(r) for r in C.ranges(starts)]

    def _table(self, plan: TablePlan) -> str:
        name, df, store = plan.name.lower(), self.source(plan), self.store
        state = store.manifest()
        if state["tables"].get(name, {}).get("status") == "LOADED":
            return "LOADED"
        if name not in state["chunks"]:  # planned once, so that a later run resumes the same ranges
            load, bounds = uuid.uuid4().hex, self._bounds(plan, df)
            store._publish_in(f"chunks/{name}/{load}/plan.json", "\n".join(json.dumps({"chunk_no": i, "lower": lo, "upper": hi}) for i, (lo, hi) in enumerate(bounds)))
            store._fs.mkdirs(store._path(f"chunks/{name}/{load}/tries"))

            def plan_chunks(s: dict) -> None:
                s["chunks"][name] = {"load": load, "n": len(bounds)}
                s["tables"][name] = {"status": "LOADING", "files": None}

            state = self.writer.commit(plan_chunks)
        load = state["chunks"][name]["load"]
        todo = chunk_states(store, name, state).where("status <> 'DONE'").orderBy("chunk_no").collect()  # a short row for each range
        with ThreadPoolExecutor(self.chunks_at_once) as pool:
            list(pool.map(lambda c: self._chunk(plan, df, name, load, c), todo))
        done, n, rows = chunk_states(store, name, state).agg(F.count_if(F.col("status") == "DONE"), F.count("*"), F.sum("rows")).first()
        paths = [r["path"] for r in chunk_states(store, name, state).orderBy("chunk_no").select("path").collect()] if done == n else []  # a path for each range
        files = store.put_files(name, {"-1": paths}) if done == n else None
        status = "LOADED" if done == n else "FAILED"
        self.writer.commit(lambda s: s["tables"].update({name: {"status": status, "files": files, "rows": rows or 0}}))
        return status

    def _chunk(self, plan: TablePlan, df: DataFrame, name: str, load: str, chunk) -> None:
        """One range in one pass: counted and looked over for refused characters while it is written, to a folder of its own that counts once its record names it."""
        attempt = chunk["attempts"] + 1
        i, rows, error, path = chunk["chunk_no"], None, None, f"data/{name}/{load}/{chunk['chunk_no']}-{attempt}-{uuid.uuid4().hex[:8]}"
        try:
            self._still_mine()
            kinds = {c.source.name: c.source.type for c in plan.columns}
            key = [c.source.name for k in plan.key for c in plan.columns if c.name == k]
            bound = lambda b: None if b is None else [C.bound_value(v, kinds[k]) for v, k in zip(b, key, strict=True)]
            part = df.where(C.in_range(key, bound(chunk["lower"]), bound(chunk["upper"]))) if key else df
            seen = Observation()
            strict = [c for c in plan.load_columns if c.source.type in TEXT_TYPES and c.rule.nul_char == "fail"]
            part = part.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(has_nul(F.col(c.source.name))).alias(f"nul_{c.name}") for c in strict])
            with_generated(converted(part, plan), plan).write.parquet(f"{self.store.root}/{path}")
            got = seen.get
            rows = got["rows"]
            bad = {c.name: got[f"nul_{c.name}"] for c in strict if got[f"nul_{c.name}"]}
            if bad:  # VAL1: nothing of the range is kept; the count is told, not the value
                raise ValueError("NUL characters in " + ", ".join(f"{k} ({v} rows)" for k, v in bad.items()))
            self._still_mine()
        except Lost:  # another load may be at the same range: nothing is recorded
            self.store.drop(path)
            raise
        except Exception as e:  # a range's failure is its own; the run reports it
            error = safe(e)
            self.store.drop(path)
            self.writer.commit(lambda s: log_event(s, "ERROR", f"{name} chunk {i}: {error}"))
        record = {"chunk_no": i, "status": "FAILED" if error else "DONE", "rows": None if error else rows, "attempt": attempt, "error": error, "path": None if error else path, "epoch": getattr(self.writer, "epoch", None)}
        self.store._publish_in(f"chunks/{name}/{load}/tries/{i}-{attempt}-{uuid.uuid4().hex[:8]}.json", json.dumps(record))
        if self.pause:
            time.sleep(self.pause)

    def _still_mine(self) -> None:
        if isinstance(self.writer, Lease):
            self.writer.check()
