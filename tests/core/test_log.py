"""Leases with epochs, the proof of a quiet source, the log's index, buckets that split, and what a load waits for."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from concordia.operators import changes as ch
from concordia.plans.load import Loader, chunk_states
from concordia.sources import envelope
from concordia.sources.log import LogCut, Quiet, Snapshot, SourceLog, check_retention
from concordia.sources.store import Lost, Refused, Store
from concordia.streaming import sync
from concordia.streaming.log import BEFORE_ALL, LOG, Part, find_head, parts_of
from tests.core.test_jobs import envelopes, job  # noqa: F401

FULL = lambda k, nm="new": {"Id": str(k), "nm": nm, "amt": "1.0000", "body": "b"}

# ------------------------------------------------------------------ leases


def test_a_holder_paused_beyond_its_lease_publishes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    from concordia.sources.store import Lease

    paused = Lease(store, "load", 0.5)  # taken by a process that then stands still
    store.commit(paused.take)
    paused.commit(lambda s: s.update(mine=1))
    time.sleep(0.6)
    with pytest.raises(Lost):
        paused.commit(lambda s: s.update(mine=2))  # it ran out, though nobody took it over
    with store.lock("load", 30) as second:
        assert second.epoch == paused.epoch + 1
        with pytest.raises(Lost):
            paused.commit(lambda s: s.update(mine=3))
        with pytest.raises(Lost):
            paused.check()
        paused.keep(NoWait())  # it can't renew either
        assert paused.lost.is_set()
        second.commit(lambda s: s.update(mine=4))
    assert store.manifest()["mine"] == 4 and store.held() == []
    store.commit(paused.give_back)
    assert store.manifest()["epoch"] == 2


class NoWait:
    def wait(self, _):
        return False


def test_renewal_survives_an_error_of_the_file_system(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    real, left = store._publish, [3]

    def failing(name, text):
        if threading.current_thread() is not threading.main_thread() and left[0]:
            left[0] -= 1
            raise OSError("no route")
        return real(name, text)

    monkeypatch.setattr(store, "_publish", failing)
    with store.lock("sync", 1.2) as lease:
        time.sleep(2.5)
        lease.commit(lambda s: s.update(n=1))
    assert left == [0] and store.manifest()["n"] == 1


def test_a_load_that_lost_its_lease_stops_and_its_ranges_stay_its_successors(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    item, calls = [t for t in plan.tables if t.name == "item"], []

    def stolen(t):  # while the first load runs, its lease runs out and another holder comes
        def take(s):
            s["epoch"] += 1
            s["leases"]["load"] = {"owner": "second", "until": time.time() + 600, "epoch": s["epoch"]}

        calls.append(1)
        store.commit(take)
        return source(t)

    with pytest.raises(Lost):
        Loader(store, item, stolen, rows_per_chunk=30, lease=600).run()
    state = store.manifest()
    assert calls and "item" not in state["chunks"] and state["tables"].get("item", {}).get("files") is None
    store.commit(lambda s: s["leases"].clear())
    assert Loader(store, item, source, rows_per_chunk=30).run() == {"item": "LOADED"}
    paths = [r.path for r in chunk_states(store, "item").collect()]
    assert len(set(paths)) == 4 and sync.Applier(store, item).read("item").count() == 100


def test_vacuum_is_alone(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    store.save(spark.range(3), "item")
    with store.lock("load"), pytest.raises(Refused, match="load runs"):
        store.vacuum(0)
    with store.lock("vacuum"), pytest.raises(Refused, match="vacuum runs"), store.lock("sync"):
        pass
    assert store.vacuum(3600) == 0 and store.vacuum(0) == 1 and sync.Applier(store, plan.tables).read("item").count() == 100


# ------------------------------------------------------------------ a quiet source


class Scripted:
    """A source whose clock moves on with every look, with commits and scans by its clock."""

    def __init__(self, commits=(), scans=()):
        self.now, self.commits, self.scans = 0, list(commits), list(scans)

    def snapshot(self):
        self.now += 1
        seen = [c for c in self.commits if c <= self.now]
        return Snapshot(f"{self.now:04d}", f"{max(seen):04d}" if seen else None, f"{max(seen):04d}" if seen else None)

    def scanned_since(self, mark):
        return any(int(mark) < a and b <= self.now for a, b in self.scans)


def test_quiet_needs_a_scan_from_after_the_mark_and_a_second_look():
    far = "9999"
    proof = Quiet(Scripted(scans=[(1, 2), (3, 5)]))
    assert [proof.look(far, True) for _ in range(5)] == [False, False, False, False, True]  # mark 1; the scan of 3 ends by 5
    busy = Quiet(Scripted(commits=range(1, 100, 2), scans=[(i, i) for i in range(100)]))
    assert not any(busy.look(far, True) for _ in range(40))  # commits after every mark
    late = Quiet(Scripted(commits=[3], scans=[(2, 2)]))  # it shows between the scan and the second look
    assert not late.look(far, True) and not late.look(far, True) and late.mark == "0001"
    behind = Quiet(Scripted(commits=[1], scans=[(i, i) for i in range(100)]))
    assert not any(behind.look("0000", True) for _ in range(5)) and not any(behind.look(far, False) for _ in range(5)) and behind.mark is None
    assert [behind.look("0001", True) for _ in range(3)] == [False, True, True]


def test_drain_goes_on_while_the_source_commits(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    applier, capture, changes = sync.Applier(store, plan.tables), sync.Capture(store, plan.tables), tmp / "changes"
    envelopes(changes, "0.json", [(1, "d", {"Id": "1"}, None)])
    left = [3]

    class Committing(Scripted):  # three more commits, each after the drain has caught up with the one before
        def scanned_since(self, mark):
            if left[0]:
                n = 5 - left[0]
                left[0] -= 1
                envelopes(changes, f"{n}.json", [(n, "d", {"Id": str(n)}, None)])
                self.commits.append(self.now)
            return True

        def snapshot(self):
            s = super().snapshot()
            return Snapshot(s.at, f"{4 - left[0]:08x}:00000000:0001", s.max_commit_at)

    run = lambda: capture.run(str(changes), f"{tmp}/checkpoint").awaitTermination()
    assert sync.drain(run, applier, 120, 0, Committing(commits=[0]))
    assert left == [0] and store.manifest()["applied"] == 4 and applier.read("item").count() == 96


def test_a_log_cut_behind_the_stored_position_stops_the_stream(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    at = lambda n: f"{n:08x}:00000000:0001"
    envelopes(tmp / "changes", "1.json", [(5, "d", {"Id": "5"}, None)])
    spark.createDataFrame([(at(9), "2026-01-01")], "lsn string, commit_at string").write.parquet(f"{tmp}/log/log_times")
    log = SourceLog.folder(spark, f"{tmp}/log")
    capture = sync.Capture(store, plan.tables, source=log, fingerprint="a")
    store.commit(lambda s: s.update(fingerprint="a"))
    run = lambda c: c.run(str(tmp / "changes"), f"{tmp}/checkpoint").awaitTermination()
    run(capture)  # nothing stored yet: it begins where the log does
    assert store.manifest()["stream_lsn"] == at(5)
    with pytest.raises(LogCut, match="no longer available"):
        run(capture)
    spark.createDataFrame([(at(5),)], "low string").write.parquet(f"{tmp}/log/log_bounds")  # the log is whole from there on, though its first commit came later
    run(capture)
    check_retention({"stream_lsn": None}, log)
    with pytest.raises(Refused, match="settings"):
        run(sync.Capture(store, plan.tables, source=log, fingerprint="b"))


def test_a_load_waits_for_the_start_position_and_for_its_settings(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    load = lambda **more: Loader(store, plan.tables, source, **more).run()
    with pytest.raises(Refused, match="start position"):
        load(after_start=True)
    assert store.manifest()["job"] == "SCHEMA_DONE" and not store.manifest()["chunks"] and store.held() == []
    capture = sync.Capture(store, plan.tables)
    beat = lambda at: spark.createDataFrame([("HEARTBEAT", at)], "kind string, stream_lsn string").write.mode("append").json(str(tmp / "changes"))
    run = lambda: capture.run(str(tmp / "changes"), f"{tmp}/checkpoint").awaitTermination()
    beat(None)
    run()
    assert store.manifest().get("start_lsn") is None
    beat("00000003:00000000:0001")
    run()
    store.commit(lambda s: s.update(fingerprint="a"))
    with pytest.raises(Refused, match="settings"):
        load(after_start=True, fingerprint="b")
    assert load(after_start=True, fingerprint="a") == {"item": "LOADED", "note": "LOADED"}
    sync.reset(store)
    assert "fingerprint" not in store.manifest() and "start_lsn" not in store.manifest()


# ------------------------------------------------------------------ the head of the log


def random_parts(rng):
    out = []
    for k in range(rng.randrange(1, 9)):
        tables = {}
        for t in rng.sample("abc", rng.randrange(1, 4)):
            at = sorted(rng.sample(range(60), rng.randrange(1, 9)))
            tables[t] = [[f"{p:02d}", t, k] for p in at]
        out.append(tables)
    return out


def test_the_head_found_by_counts_is_the_head():
    rng = random.Random(7)
    for _ in range(3000):
        raw, n = random_parts(rng), rng.randrange(1, 30)
        applied = {t: rng.choice([BEFORE_ALL, [f"{rng.randrange(60):02d}", t, 9]]) for t in rng.sample("abc", rng.randrange(0, 4))}
        pending = lambda t, p: t in applied and p > applied[t]
        parts = [Part(str(i), {t: [ps[0], ps[-1], len(ps), None] for t, ps in ts.items()}) for i, ts in enumerate(raw)]
        cut = find_head([p for p in (p.of(applied) for p in parts) if p], n)
        opened = {int(p.path) for p in cut.open}
        inside = sorted(p for i in opened for t, ps in raw[i].items() for p in ps if pending(t, p) and (cut.whole or p[0] <= cut.end[0]))
        want = sorted(p for ts in raw for t, ps in ts.items() for p in ps if pending(t, p))[:n]
        if cut.whole:
            assert inside == want
            continue
        sure = [p for p in inside if p <= cut.sure]
        assert len(sure) <= n and cut.count in (None, len(sure))
        assert sure + [p for p in inside if p > cut.sure][: n - len(sure)] == want


def captured(store, plan, tmp, batches, part_rows):
    capture = sync.Capture(store, plan.tables, part_rows=part_rows)
    for i, rows in enumerate(batches):
        envelopes(tmp / f"changes{i}", "1.json", rows)
        capture(envelope.batch(store.spark, str(tmp / f"changes{i}")), i)


def test_ten_batches_open_only_the_files_of_their_heads(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    captured(store, plan, tmp, [[(1000 * i + j, "u", {"Id": str(j % 100)}, FULL(j % 100, f"v{i}")) for j in range(100)] for i in range(5)], part_rows=50)
    state = store.manifest()
    assert len(parts_of(store, state["log"])) == 10 and state["captured_of"] == {"item": 500}
    applier = sync.Applier(store, plan.tables, batch_size=50)
    log = store.open([b["path"] for b in state["log"]], LOG)
    want = [tuple(r) for r in ch.batch_head(log, 120).select(*ch.POSITION).collect()]
    applier.batch_size = 120
    assert sorted(tuple(r) for r in applier.head(state).select(*ch.POSITION).collect()) == want and len(applier.opened) == 3
    applier.batch_size = 50
    opened, n = [], 0
    while k := applier.step():
        assert k == 50
        n += k
        opened.append(len(applier.opened))
        assert applier.status()["pending"] == 500 - n
    assert n == 500 and len(opened) == 10 and max(opened) == 1, opened
    assert store.manifest()["log"] == [] and {r.nm for r in applier.read("item").select("nm").distinct().collect()} == {"v4"}


def test_an_event_that_a_batch_holds_twice_is_captured_once(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    once = [(k, "u", {"Id": str(k)}, FULL(k, f"v{k}")) for k in range(1, 81)]
    captured(store, plan, tmp, [once + once[20:60] + once[:1]], part_rows=20)
    state = store.manifest()
    parts = sorted(parts_of(store, state["log"]), key=lambda p: p.first)
    assert state["captured"] == 80 == sum(p.count for p in parts) and all(a.last < b.first for a, b in zip(parts, parts[1:], strict=False))
    assert sync.Applier(store, plan.tables).step() == 80


def test_the_rows_that_changes_all_over_a_table_rewrite_grow_as_the_table(job, monkeypatch):  # noqa: F811
    spark, tmp, plan, store, source = job
    monkeypatch.setattr(sync, "LEAST_BATCH", 10)
    Loader(store, plan.tables, source).run()
    captured(store, plan, tmp, [[(k + 1, "u", {"Id": str(37 * k % 100)}, FULL(37 * k % 100)) for k in range(100)]], part_rows=10)
    applier, rewritten = sync.Applier(store, plan.tables, rows_per_bucket=10), []
    while applier.step():
        rewritten.append(store.manifest()["tables"]["item"]["rewritten"]["rows"])
    assert len(rewritten) == 4 and sum(rewritten) <= 400, rewritten  # a quarter of the rows at a time, not ten events
    assert applier.events_at_once(store.manifest(), {"item"}) == 25 and applier.events_at_once(store.manifest(), set()) == 10
    assert applier.read("item").where("nm = 'new'").count() == 100 == store.manifest()["applied"]


def test_a_late_batch_is_held_against_the_parts_it_reaches_into(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    rows = lambda a, b: [(k, "u", {"Id": str(k % 100)}, FULL(k % 100)) for k in range(a, b)]
    captured(store, plan, tmp, [rows(1, 101), rows(201, 301), rows(80, 220)], part_rows=40)  # the third holds 41 known ones
    state = store.manifest()
    assert state["captured"] == 300 and sum(p.count for p in parts_of(store, state["log"])) == 300
    assert sync.Applier(store, plan.tables).status() == {"pending": 0, "waiting_for_load": 300, "captured": 300, "applied": 0, "stream_lsn": f"{300:08x}:00000000:0001", "first_pending_at": "2026-01-01 00:00:00", "src_max_at": "2026-01-01 00:00:00"}
    Loader(store, plan.tables, source).run()
    applier, done = sync.Applier(store, plan.tables, batch_size=70), []
    while k := applier.step():
        done.append((k, store.manifest()["positions"]["item"][0][:8]))
    assert done == [(70, f"{70:08x}"), (70, f"{140:08x}"), (70, f"{210:08x}"), (70, f"{280:08x}"), (20, f"{300:08x}")]


def test_the_status_reads_no_event_and_a_reset_table_is_pending_again(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    captured(store, plan, tmp, [[(k, "u", {"Id": str(k)}, FULL(k)) for k in range(1, 41)]], part_rows=10)
    applier = sync.Applier(store, plan.tables, batch_size=15)
    assert applier.step() == 15 and len(applier.opened) == 2
    spark.sparkContext.setJobGroup("status", "no job may run here")
    status = applier.status()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("status")
    spark.sparkContext._jsc.clearJobGroup()
    assert status["pending"] == 25 and not jobs
    sync.reset(store, ["item"])
    assert applier.status()["waiting_for_load"] == 40 and applier.status()["pending"] == 0


def test_the_watermark_follows_the_stream_s_batches(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    applier, capture = sync.Applier(store, plan.tables), sync.Capture(store, plan.tables)
    envelopes(tmp / "changes", "1.json", [(5, "d", {"Id": "5"}, None), (6, "d", {"Id": "6"}, None)])
    with sync.ticking(applier, 3600):
        capture.run(str(tmp / "changes"), f"{tmp}/checkpoint").awaitTermination()
        end = time.monotonic() + 30
        while "watermark" not in store.manifest() and time.monotonic() < end:
            time.sleep(0.1)
        mark = store.manifest()["watermark"]
    assert (mark["batch"], mark["batch_rows"], mark["waiting_for_load"], mark["captured"]) == (0, 2, 2, 2)


# ------------------------------------------------------------------ buckets that split


def test_linear_hashing_moves_rows_only_to_the_bucket_that_splits_off(spark):
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("h"))
    for n in (1, 2, 3, 5, 8, 12, 31):
        r = rows.select(sync.bucket_of(F.col("h"), n).alias("a"), sync.bucket_of(F.col("h"), n + 1).alias("b")).distinct().collect()
        assert {x.a for x in r} == set(range(n)) and all(x.a == x.b or (x.b == n and x.a == sync.parent(n)) for x in r)
    assert sync.grown(4, 6, {0, 1}) == (6, {0, 1}) and sync.grown(4, 100, {3}) == (5, {0, 3}) and sync.grown(1, 9, {0}) == (9, {0}) and sync.grown(8, 4, {2}) == (8, {2})


def test_the_rows_a_change_rewrites_do_not_grow_with_the_table(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    item = [t for t in plan.tables if t.name == "item"]
    Loader(store, item, source).run()
    applier, per, key = sync.Applier(store, item, rows_per_bucket=25), 25, [1000]

    def batch(i, rows):
        captured_at = [(key[0] + j, *r) for j, r in enumerate(rows)]
        key[0] += len(rows)
        envelopes(tmp / f"c{i}", "1.json", captured_at)
        sync.Capture(store, item)(envelope.batch(spark, str(tmp / f"c{i}")), i)
        applier.step()
        return store.manifest()["tables"]["item"]

    for i in range(5):  # twenty times as many rows
        s = batch(i, [("c", None, FULL(1000 + 420 * i + j)) for j in range(420)])
    assert s["rows"] == 2200 == applier.read("item").count()
    for i in range(5, 9):
        s = batch(i, [("u", {"Id": "5"}, FULL(5, f"n{i}"))])
        assert s["rewritten"]["rows"] <= 12 * per and s["rewritten"]["buckets"] <= 4  # its own bucket, another one for a split, and what splits off
    rows = store.bucket_rows(store.manifest(), "item")
    assert s["buckets"] >= 2200 / per / 2 and sum(rows.values()) == 2200 and max(rows.values()) <= 5 * per
    assert applier.read("item").where("id = 5").first().nm == "n8" and applier.read("item").select("id").distinct().count() == 2200


def test_a_state_of_the_version_before_is_taken_over(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()

    def older(s):
        s["version"] = 4
        for k in ("epoch", "captured_of", "applied_of"):
            s.pop(k)
        s["tables"]["item"]["buckets"] = 3

    store.commit(older)
    again = Store(spark, store.root)
    assert again.manifest()["version"] == 5 and "buckets" not in again.manifest()["tables"]["item"] and sync.Applier(again, plan.tables).read("item").count() == 100
    store.commit(lambda s: s.update(version=4, log=[{"path": "x"}]))
    with pytest.raises(Refused, match="drained"):
        Store(spark, store.root)
