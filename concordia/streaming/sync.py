"""Capture into a change log, and application of the log to versioned tables (STR1-STR12, MUT1-MUT8, SNK2, SNK3).

The two halves share only the log.  Capture is a stream whose batches are appended once: a batch
whose number is committed already does nothing, and an event that is in the log, or at or before
its table's applied position, is dropped.  Application takes the head of the pending events of
loaded tables, nets it per key, rewrites the buckets it touches, and publishes the new files and
positions in one commit; if anything is wrong with any event, nothing is published.  A captured
batch whose events are all applied leaves the log with that commit.

A captured batch is written in parts of ascending positions, and an index beside it says of each
part and table the first and last position and the number of events (``concordia.streaming.log``).
So the head of the log, and what is pending, are found without opening the rest of it.
"""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from concordia.functions import lsn
from concordia.functions.values import TEXT_TYPES, sentinel_value, text_rules
from concordia.operators import changes as ch
from concordia.plans.load import same_settings, with_generated
from concordia.plans.model import TablePlan
from concordia.plans.planner import spark_type, struct_type
from concordia.sources import envelope
from concordia.sources.log import Quiet, SourceLog, check_retention
from concordia.sources.store import Lease, Refused, Store, log_event
from concordia.streaming.log import BEFORE_ALL, LOG, find_head, indexed, parts_of

_POSITIONS = "table_name string, commit_lsn string, change_lsn string, event_serial_no long"


#: Buckets of one table, at most.
MOST_BUCKETS = 65_536
#: Events of a batch whose number isn't set: so many at least, or one for so many rows of the tables that it changes.
LEAST_BATCH, ROWS_PER_EVENT = 100_000, 4


class BadBatch(RuntimeError):
    """Some event cannot be applied; the message has reasons and counts, never values (MSC7)."""


def _reasons(bad: DataFrame) -> str:
    return ", ".join(f"{r['reason']} ({r['n']})" for r in bad.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect())


def log_frame(store: Store, state: dict) -> DataFrame:
    return store.open([b["path"] for b in state["log"]], LOG)


def positions_frame(store: Store, state: dict) -> DataFrame:
    return store.spark.createDataFrame([(t, *p) for t, p in state["positions"].items()], _POSITIONS)


class Capture:
    """SNK2: the stream's sink.  ``writer`` publishes: the store, or the lease of whoever captures.

    With ``source`` a stream that begins again is refused if the source's log no longer goes back
    to the stored position, with ``fingerprint`` if the settings are not those the job began with.
    """

    def __init__(self, store: Store, plans: list[TablePlan], writer: Store | Lease | None = None, source: SourceLog | None = None, fingerprint: str | None = None, part_rows: int = 50_000) -> None:
        self.store, self.writer, self.source, self.fingerprint, self.part_rows = store, writer or store, source, fingerprint, part_rows
        keyed = [p for p in plans if p.key]
        self.columns = {p.source.full: [c.source.name for c in p.load_columns] for p in keyed}
        self.tables = {p.source.full.lower(): p.name for p in keyed}
        self.names = {f"{p.source.full.lower()}|{c.source.name}": c.name for p in keyed for c in p.load_columns}

    def _renamed(self, events: DataFrame) -> DataFrame:
        """PRJ2: target names of tables and columns."""
        as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
        source = F.lower("table_name")
        image = lambda c: F.transform_keys(c, lambda k, _: F.coalesce(F.element_at(as_map(self.names), F.concat(source, F.lit("|"), k)), k))
        events = events.withColumns({"before": image("before"), "after": image("after")})  # the table's new name only then: the lambdas would see it
        return events.withColumn("table_name", F.element_at(as_map(self.tables), source))

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        state = self.store.manifest()
        if batch_id <= state.get("captured_batch", -1):  # STR2: a replay after the commit
            return
        events = events.persist()
        try:
            if bad := _reasons(envelope.invalid(events, self.columns)):
                raise BadBatch(bad)  # STR8: a schema change stops here too
            edge = events.agg(F.max(F.coalesce("stream_lsn", "commit_lsn")).alias("stream"), F.min(F.coalesce("stream_lsn", "commit_lsn")).alias("first"), F.max("src_commit_at").cast("string").alias("at")).first()
            new = self._renamed(events.where("kind = 'CHANGE'"))
            batch = self._append(ch.not_applied(new, positions_frame(self.store, state)), state)
        finally:
            events.unpersist()

        def publish(s: dict) -> None:
            s["captured_batch"] = batch_id
            if edge["first"] and not s.get("start_lsn"):
                s["start_lsn"] = edge["first"]  # STR1: once
            s["stream_lsn"] = max(filter(None, (s.get("stream_lsn"), edge["stream"])), default=None)  # STR11
            s["src_max_at"] = max(filter(None, (s.get("src_max_at"), edge["at"])), default=None)
            if batch:
                s["captured"] = s.get("captured", 0) + batch["rows"]
                for t, n in batch["count"].items():
                    s["captured_of"][t] = s["captured_of"].get(t, 0) + n
                s["log"].append(batch)

        self.writer.commit(publish)

    def _append(self, new: DataFrame, state: dict) -> dict | None:
        """Write events that the log doesn't hold yet, in parts of ascending positions; the batch's entry in the log.

        An event that comes twice lies twice in one part's range, so it is met there, without a move of its own.
        """
        n, low, high = new.agg(F.count("*"), F.min(lsn.position()), F.max(lsn.position())).first()
        if not n:
            return None
        near = [p.path for p in parts_of(self.store, state["log"]) if p.first <= list(high) and p.last >= list(low)]
        if near:  # only parts that reach into the batch's positions can hold one of its events
            new = new.join(self.store.open(near, LOG).select(*ch.POSITION), list(ch.POSITION), "left_anti")
        rows = new.select(*[F.col(c) for c in ("commit_lsn", "change_lsn", "event_serial_no", "op", "table_name", "before", "after", "src_commit_at")])
        parts = ch.distinct_events(rows.repartitionByRange(-(-n // self.part_rows), *ch.POSITION))
        path = self.store.save(parts.sortWithinPartitions(*ch.POSITION), "log")
        return indexed(self.store, path)

    def run(self, folder: str, checkpoint: str, available_now: bool = True):
        """Start the stream; with ``available_now`` it takes what is there and ends."""
        return self.start(envelope.stream(self.store.spark, folder), checkpoint, available_now)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = True):
        """As ``run``, of any stream of parsed events."""
        state = self.store.manifest()
        same_settings(state, self.fingerprint)
        if self.source is not None:
            check_retention(state, self.source, self.tables)
        writer = events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def bucket_of(hash_: Column, buckets: int) -> Column:
    """Linear hashing: the remainder by the next power of two, or by the one before it while that bucket hasn't split off yet."""
    low = 1 << (buckets.bit_length() - 1)
    wide = F.pmod(hash_, F.lit(2 * low))
    return F.when(wide < buckets, wide).otherwise(F.pmod(hash_, F.lit(low))).cast("int")


def parent(bucket: int) -> int:
    """The bucket that a bucket's rows were in before it split off."""
    return bucket - (1 << (bucket.bit_length() - 1))


def grown(buckets: int, wanted: int, touched: set[int]) -> tuple[int, set[int]]:
    """How many buckets a batch may grow to, and which of the old ones it then rewrites.

    Buckets split in order.  Splitting one that the batch rewrites anyway is free, and as many others
    may be read for it as the batch touches, so a batch's work stays within twice its own.
    """
    rewrite, budget, n = set(touched), max(1, len(touched)), buckets
    while n < wanted:
        root = parent(n)
        while root >= buckets:
            root = parent(root)
        if root not in rewrite:
            if not budget:
                break
            budget -= 1
            rewrite.add(root)
        n += 1
    return n, rewrite


class Applier:
    """SNK3, MUT7.  A table's files are kept by bucket of its key, so a batch rewrites only what it touches.

    Buckets are numbered by linear hashing: as a table grows, further ones split off, a few with each
    batch, so the rows that one changed key rewrites don't grow with the table (up to ``MOST_BUCKETS``).
    The rows of each bucket are counted from its files' footers as it is written.

    A batch whose keys lie all over a table rewrites all of it.  Were its size fixed, then the rewritten
    rows would grow with the table's rows times its changes.  So unless ``batch_size`` sets a number, a
    batch grows with the tables that it changes, and a change costs a few rewritten rows at any size.
    """

    def __init__(self, store: Store, plans: list[TablePlan], rows_per_bucket: int = 50_000, batch_size: int | None = None, writer: Store | Lease | None = None) -> None:
        self.store, self.plans, self.writer = store, {p.name.lower(): p for p in plans}, writer or store
        self.schemas = {t: struct_type(p) for t, p in self.plans.items()}
        self.keys = {t: list(p.key) for t, p in self.plans.items()}
        self.rows_per_bucket, self.batch_size = rows_per_bucket, batch_size
        self.opened: list[str] = []  # parts of the log that the last batch read

    def wanted(self, rows: int) -> int:
        return min(MOST_BUCKETS, max(1, -(-rows // self.rows_per_bucket)))

    def bucket(self, table: str, buckets: int) -> Column:
        return bucket_of(F.xxhash64(*[F.col(k).cast("string") for k in self.keys[table]]), buckets)

    def read(self, table: str, state: dict | None = None, only: list[int] | None = None) -> DataFrame:
        files = self.store.files(state or self.store.manifest(), table.lower())
        paths = [p for b, ps in files.items() if only is None or int(b) in only or b == "-1" for p in ps]
        return self.store.open(paths, self.schemas[table.lower()])

    def ready(self, state: dict) -> dict[str, list]:
        """STR3: loaded tables with a key, and their applied positions; one that waits blocks no other."""
        return {t: state["positions"].get(t) or BEFORE_ALL for t, s in state["tables"].items() if s.get("status") == "LOADED" and self.keys.get(t)}

    def events_at_once(self, state: dict, tables: set[str]) -> int:
        """How many events a batch takes that may change these tables."""
        rows = sum(state["tables"][t].get("rows") or 0 for t in tables)
        return self.batch_size or max(LEAST_BATCH, rows // ROWS_PER_EVENT)

    def head(self, state: dict) -> DataFrame | None:
        """SRT1: the first ``events_at_once`` pending events of ready tables in log order; None if there are none.

        The index says which parts can hold them.  Up to ``sure`` there are no more than a batch's events,
        up to ``end`` at least as many, so only events between the two are looked through for the last one.
        """
        ready = self.ready(state)
        parts = [p for p in (p.of(ready) for p in parts_of(self.store, state["log"])) if p is not None]
        n = self.events_at_once(state, {t for p in parts for t in p.tables})
        cut = find_head(parts, n)
        self.opened = [p.path for p in cut.open]
        if not cut.open:
            return None
        events = self.store.open(self.opened, LOG).withColumn("table_name", F.lower("table_name"))
        events = ch.not_applied(events.where(F.col("table_name").isin(list(ready)) & (F.col("commit_lsn") <= cut.end[0])), positions_frame(self.store, state))
        at = lambda p: F.struct(F.lit(p[0]).alias("commit_lsn"), F.lit(p[1]).alias("change_lsn"), F.lit(p[2]).cast("long").alias("event_serial_no"))
        if cut.whole:
            return events
        sure = cut.count if cut.count is not None else events.where(lsn.position() <= at(cut.sure)).count()
        last = cut.sure
        if sure < n:
            more = ch.batch_head(events.where(lsn.position() > at(cut.sure)), n - sure).agg(F.max(lsn.position())).first()[0]
            last = last if more is None else more
        return events.where(lsn.position() <= at(last))

    def step(self) -> int:
        """One batch; the number of events it applied."""
        state = self.store.manifest()
        head = self.head(state)
        if head is None:
            return 0
        head = head.persist()
        try:
            counts = ch.batch_positions(head, at="src_commit_at").collect()  # a row per table
            if not counts:
                return 0
            new: dict[str, dict] = {}
            for r in counts:
                table = r["table_name"]
                new[table] = self._table(head.where(F.col("table_name") == table), table, state)
        finally:
            head.unpersist()
        n = sum(r["n"] for r in counts)

        def publish(s: dict) -> None:
            for r in counts:
                t = r["table_name"]
                if s["positions"].get(t) != state["positions"].get(t) or s["tables"][t]["files"] != state["tables"][t]["files"]:
                    raise Refused(f"{t} changed meanwhile")
                s["tables"][t].update(new[t])
                s["positions"][t] = [r["commit_lsn"], r["change_lsn"], r["event_serial_no"]]
                s["applied_of"][t] = s["applied_of"].get(t, 0) + r["n"]
                s["tables"][t]["applied_at"] = r["at"]
            s["applied"] = s.get("applied", 0) + n
            s["log"] = [b for b in s["log"] if any(last > (s["positions"].get(t) or BEFORE_ALL) for t, last in b["last"].items())]

        self.writer.commit(publish)
        return n

    def _table(self, events: DataFrame, table: str, state: dict) -> dict:
        plan, key, schema = self.plans[table], self.keys[table], self.schemas[table]
        strict = [c.name for c in plan.load_columns if c.source.type in TEXT_TYPES and c.rule.nul_char == "fail"]
        if bad := _reasons(ch.faults(events, key, strict)):
            raise BadBatch(f"{table}: {bad}")
        files, rows = self.store.files(state, table), self.store.bucket_rows(state, table)
        had, known = state["tables"][table].get("buckets"), state["tables"][table].get("rows") or 0
        whole = had is None  # as loaded, not bucketed yet
        if whole:
            buckets, rewrite = self.wanted(known), None
        else:
            keys = ch.split_key_changes(events, key).select(*[F.col(f"key_{k}").cast(schema[k].dataType).alias(k) for k in key])
            touched = {r[0] for r in keys.select(self.bucket(table, had).alias("b")).distinct().collect()}  # bucket numbers
            buckets, rewrite = grown(had, self.wanted(known), touched)
        net = ch.net_effect(events, key, [c.name for c in plan.load_columns if c.name not in key])
        net = net.withColumns({c.name: self._value(c) for c in plan.load_columns if c.name not in key})
        old = self.read(table, state, None if whole else sorted(rewrite)).select(*[c.name for c in plan.load_columns])
        after = with_generated(ch.applied_to(old, net, key), plan)
        parts = self.store.save_parts(after.withColumn("_b", self.bucket(table, buckets)), table, "_b")
        counted = self._rows_of(parts)
        done = range(buckets) if whole else [*sorted(rewrite), *range(had, buckets)]
        work = {"rows": known if whole else sum(rows.get(str(b), 0) for b in rewrite), "buckets": len(done), "split": 0 if whole else buckets - had}
        for b in done:
            files[str(b)], rows[str(b)] = [parts[str(b)]] if str(b) in parts else [], counted.get(b, 0)
        files.pop("-1", None)
        return {"files": self.store.put_files(table, files, rows), "buckets": buckets, "rows": sum(rows.values()), "rewritten": work}

    def _rows_of(self, parts: dict[str, str]) -> dict[int, int]:
        """Rows by bucket, from the footers of the files just written."""
        if not parts:
            return {}
        base = f"{self.store.root}/{next(iter(parts.values())).rsplit('/', 1)[0]}"
        return dict(self.store.spark.read.parquet(base).groupBy(F.col("_b").cast("int")).count().collect())  # a row per bucket

    @staticmethod
    def _value(c) -> Column:
        """MUT5: a change's values pass the rules that copied values pass."""
        v = F.col(c.name)["v"]
        if c.source.type in TEXT_TYPES:
            new = text_rules(v, c.rule)
        else:
            new = sentinel_value(v.cast(spark_type(c.type)), c.rule).cast("string")
        return F.when(F.col(c.name).isNotNull(), F.struct(new.alias("v")))

    def status(self, state: dict | None = None) -> dict:
        """STR4: from the counters that commits keep and the log's index; no event is read.

        ``first_pending_at`` is the oldest commit time that may be pending: that of the first event of a
        part, or of the last applied one where a part is applied halfway.
        """
        state = state or self.store.manifest()
        ready, of = self.ready(state), lambda t: state["captured_of"].get(t, 0) - state["applied_of"].get(t, 0)
        parts = [p for p in (p.of({t: state["positions"].get(t) or BEFORE_ALL for t in state["captured_of"]}) for p in parts_of(self.store, state["log"])) if p is not None]
        oldest = [max(filter(None, (at, state["tables"].get(t, {}).get("applied_at") if p.halfway else None)), default=None) for p in parts for t, at in p.began.items()]
        return {
            "pending": sum(of(t) for t in state["captured_of"] if t in ready), "waiting_for_load": sum(of(t) for t in state["captured_of"] if t not in ready), "captured": state.get("captured", 0), "applied": state.get("applied", 0),
            "stream_lsn": state.get("stream_lsn"), "first_pending_at": min(filter(None, oldest), default=None), "src_max_at": state.get("src_max_at"),
        }


def drain(capture: Callable[[], object], applier: Applier, max_wait: float = 600.0, poll: float = 1.0, source: SourceLog | None = None) -> bool:
    """STR5, STR6: capture and apply until nothing more can come; False if that takes longer than ``max_wait`` seconds.

    With ``source`` that is proved in two looks at its log.  Once all that it holds is applied, its
    clock is read: the mark.  Then a scan of the log must have started after the mark and ended, for
    commits from before the mark may not have been scanned yet; and a second look must find no commit
    after the mark and nothing that isn't captured.  A commit after the mark means that the source is
    still written to, and the proof begins again with a new mark.  Without ``source``, a capture pass
    that began after everything was applied brings nothing more.
    """
    end, proof = time.monotonic() + max_wait, Quiet(source) if source else None
    while time.monotonic() < end:
        capture()
        while applier.step():
            pass
        state = applier.store.manifest()
        loaded = all(s.get("status") == "LOADED" for s in state["tables"].values())
        idle = loaded and applier.status(state)["pending"] == 0
        if proof is not None:
            if proof.look(state.get("stream_lsn") if idle else None, idle):
                return True
        elif idle:
            mark = state.get("captured", 0)
            capture()
            if applier.store.manifest().get("captured", 0) == mark:
                return True
        time.sleep(poll)
    return False


def write_watermark(applier: Applier, **more) -> None:
    """STR4: the job's status as its state's ``watermark``."""
    applier.writer.commit(lambda s: s.update(watermark=applier.status(s) | {"at": time.time()} | more))


class StatusListener(StreamingQueryListener):
    """STR4: notes each micro-batch of the capture in the watermark, as Spark reports it; nothing is scanned for it."""

    def __init__(self, applier: Applier) -> None:
        self.applier = applier

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        try:
            write_watermark(self.applier, batch=p.batchId, batch_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond)
        except Exception as e:  # the next one tells
            print(f"status: {type(e).__name__}", file=sys.stderr)


@contextmanager
def ticking(applier: Applier, seconds: float):
    """STR4: while inside, the watermark is written with each micro-batch of a stream and every so many seconds, from counters alone."""
    stop, listener = threading.Event(), StatusListener(applier)

    def run() -> None:
        while not stop.wait(seconds):
            try:
                write_watermark(applier)
            except Exception as e:  # the next tick tells
                print(f"status: {type(e).__name__}", file=sys.stderr)

    applier.store.spark.streams.addListener(listener)
    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        applier.store.spark.streams.removeListener(listener)
        write_watermark(applier)


def reset(store: Store, tables: list[str] | None = None) -> None:
    """MUT8: empty tables and their ranges, or all state; refused while a load, a synchronisation or a switch runs, clears leases that ran out."""
    def clear(s: dict) -> None:
        if held := store.held(s):
            raise Refused(f"reset is not allowed while {', '.join(held)} runs")
        s["leases"] = {}
        for t in tables if tables is not None else list(s["tables"]):
            s["tables"][t.lower()] = {"status": "PLANNED", "files": None}
            s["chunks"].pop(t.lower(), None)
            s["positions"].pop(t.lower(), None)
            s["applied_of"][t.lower()] = s["captured_of"].get(t.lower(), 0) - sum(b["count"].get(t.lower(), 0) for b in s["log"])  # what the log holds is pending again
        if tables is None:
            s.update(log=[], positions={}, runs=[], captured=0, applied=0, captured_of={}, applied_of={}, job="SCHEMA_DONE")
            for k in ("captured_batch", "fingerprint", "start_lsn", "stream_lsn", "src_max_at", "watermark", "cutover"):
                s.pop(k, None)
        log_event(s, "INFO", "reset " + ("all" if tables is None else ", ".join(tables)))

    store.commit(clear)
