"""Copy, capture, apply, verify and switch, end to end on small tables."""

import json
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from concordia import cli
from concordia.plans import cutover as co
from concordia.plans import planner
from concordia.plans import rules as R
from concordia.plans.load import Loader, chunk_states, create_tables, explained, safe
from concordia.plans.model import Catalog, Table
from concordia.sources import config as cfg
from concordia.sources import tables as sources
from concordia.sources.log import Snapshot, SourceLog
from concordia.sources.store import Refused, Store
from concordia.streaming import sync
from tests.core import harbor

CATALOG = Catalog("X", (
    Table("dbo", "Item", (harbor.col(1, "Id", "int", 4, 10, 0, False), harbor.col(2, "nm", "varchar", 40), harbor.col(3, "amt", "money", 8, 19, 4), harbor.col(4, "body", "nvarchar", -1), harbor.col(5, "up", "varchar", 40, computed="(upper([nm]))")), (harbor.pk("pk_item", "Id"),)),
    Table("dbo", "note", (harbor.col(1, "a", "int", 4, 10, 0), harbor.col(2, "b", "varchar", 9))),
))
RULES = {"tables": {"dbo.Item": {"columns": {"up": {"generated": "upper(nm)"}, "nm": {"trailing_space": "rtrim"}}}}}


@pytest.fixture
def job(spark, tmp_path):
    items = spark.range(100).select(F.col("id").cast("int").alias("Id"), F.concat(F.lit("n"), "id", F.lit("  ")).alias("nm"), (F.col("id") / 4).cast("decimal(19,4)").alias("amt"), F.lit("text").alias("body"))
    items.write.parquet(f"{tmp_path}/src/dbo.Item")
    spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "a int, b string").write.parquet(f"{tmp_path}/src/dbo.note")
    plan = planner.plan(CATALOG, R.load(RULES))
    assert not plan.blocked
    store = Store(spark, f"{tmp_path}/state")
    store.commit(lambda s: s.update(job="SCHEMA_DONE"))
    return spark, tmp_path, plan, store, lambda t: spark.read.parquet(f"{tmp_path}/src/{t.source.full}")


def envelopes(folder, name, rows):
    folder.mkdir(exist_ok=True)
    out = []
    for n, op, before, after in rows:
        lsn = f"{n:08x}:00000000:0001"
        out.append(json.dumps({"kind": "CHANGE", "stream_lsn": lsn, "schema": "dbo", "table": "Item", "op": op, "commit_lsn": lsn, "change_lsn": lsn, "event_serial_no": 1, "commit_at": "2026-01-01T00:00:00", "before": before, "after": after}))
    (folder / name).write_text("\n".join(out))


def test_from_copy_to_switch(job):
    spark, tmp, plan, store, source = job
    assert Loader(store, plan.tables, source, rows_per_chunk=30).run() == {"item": "LOADED", "note": "LOADED"}
    view = {r.table_name: r for r in co.job_view(store).collect()}
    assert (view["item"].chunks, view["item"].done, view["item"].rows) == (4, 4, 100) and view["note"].chunks == 1
    applier = sync.Applier(store, plan.tables, rows_per_bucket=25, batch_size=3)
    target = lambda t: applier.read(t.name)
    row = applier.read("item").where("id = 5").first()
    assert (row.nm, row.up, str(row.amt)) == ("n5", "N5", "1.2500")
    assert co.verify_run(store, plan.tables, source, target)["status"] == "MATCHED"

    full = lambda k, nm, body="b": {"Id": str(k), "nm": nm, "amt": "1.0000", "body": body}
    changes = tmp / "changes"
    envelopes(changes, "1.json", [(10, "c", None, full(200, "new ")), (11, "u", {"Id": "5"}, full(5, "five", '{"unavailable":true}')), (12, "d", {"Id": "6"}, None), (13, "u", {"Id": "7"}, full(700, '{"b64":"eA=="}')), (10, "c", None, full(200, "new "))])
    capture = sync.Capture(store, plan.tables)
    run = lambda: capture.run(str(changes), f"{tmp}/checkpoint").awaitTermination()
    assert sync.drain(run, applier, 120, 0)
    state = store.manifest()
    assert state["log"] == [] and state["tables"]["item"]["buckets"] == 4  # what is applied leaves the log
    assert state["captured"] == 4 == state["applied"] and state["start_lsn"] == state["positions"]["item"][0].replace("0d", "0a")
    got = {r.id: (r.nm, r.body, r.up) for r in applier.read("item").where("id in (5, 6, 7, 200, 700)").collect()}
    assert got == {5: ("five", "text", "FIVE"), 200: ("new", "b", "NEW"), 700: ("x", "b", "X")} and applier.read("item").count() == 100

    envelopes(changes, "2.json", [(12, "d", {"Id": "8"}, None), (14, "u", {"Id": "9"}, full(9, "nine"))])  # one is not after the applied position
    assert sync.drain(run, applier, 120, 0) and store.manifest()["captured"] == 5
    capture(spark.createDataFrame([], "kind string, stream_lsn string, commit_lsn string, change_lsn string, event_serial_no long, op string, table_name string, before map<string,struct<v:string,unavailable:boolean>>, after map<string,struct<v:string,unavailable:boolean>>, src_commit_at timestamp_ntz"), 0)
    assert store.manifest()["captured"] == 5  # a replayed batch does nothing
    assert applier.status()["pending"] == 0

    found = co.verify_run(store, plan.tables, source, target)
    assert found["status"] == "MISMATCHED"
    diff = {(r.key, r.side) for r in spark.read.parquet(f"{store.root}/{found['diffs']}").collect()}
    assert ("6", "missing") in diff and ("200", "extra") in diff and ("5", "diff") in diff

    code, steps = co.Cutover(store, plan.tables, source, target, lambda: True).run()
    assert code == co.FAILED and [s["step"] for s in steps] == ["drain", "reload", "post_load", "verify"] and store.manifest()["job"] == "FAILED"
    moved = applier.read("item").drop("up").withColumnRenamed("id", "Id")
    now = lambda t: moved if t.name == "item" else source(t)
    sequences = lambda: spark.createDataFrame([("item.id", 100, 1, 1, 700)], "sequence string, last long, seed long, increment long, target_end long")
    code, steps = co.Cutover(store, plan.tables, now, target, lambda: True, sequences).run()
    assert code == co.OK and len(steps) == 6 and store.manifest()["sequences"]["item.id"]["value"] == 701
    levels = {(r.group, r.level) for r in co.after_check(store, plan.tables, target).collect()}
    assert {("job", "OK"), ("verify", "OK"), ("generated", "OK"), ("probe", "OK"), ("constraint", "OK")} <= levels
    assert ("cutover", "setval", "DONE") in {tuple(r) for r in co.full_view(store).collect()}
    before = applier.read("item").count()
    assert store.vacuum(0) > 0 and applier.read("item").count() == before and store.vacuum(0) == 0
    assert co.Cutover(store, plan.tables, now, target, lambda: False).run is not None


def test_a_failed_chunk_is_the_only_one_copied_again(job):
    spark, tmp, plan, store, source = job
    item = [t for t in plan.tables if t.name == "item"]
    bad = lambda t: source(t).withColumn("body", F.when(F.col("Id") == 42, F.lit("a\x00")).otherwise(F.col("body")))
    assert Loader(store, item, bad, rows_per_chunk=30).run() == {"item": "FAILED"}
    chunks = chunk_states(store, "item").orderBy("chunk_no").collect()
    assert [c.status for c in chunks].count("FAILED") == 1 and "body (1 rows)" in next(c.error for c in chunks if c.error)
    assert Loader(store, item, source, rows_per_chunk=7).run() == {"item": "LOADED"}
    again = chunk_states(store, "item").orderBy("chunk_no").collect()
    assert [c.attempts for c in again] == [2 if c.status == "FAILED" else 1 for c in chunks] and sum(c.rows for c in again) == 100 == sync.Applier(store, item).read("item").count()


def test_bad_events_publish_nothing(job):
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    applier, changes = sync.Applier(store, plan.tables), tmp / "changes"
    envelopes(changes, "1.json", [(1, "d", None, None), (2, "d", {"Id": "1"}, None)])
    sync.Capture(store, plan.tables).run(str(changes), f"{tmp}/checkpoint").awaitTermination()
    before = store.manifest()
    with pytest.raises(sync.BadBatch, match="delete without key"):
        applier.step()
    assert store.manifest() == before and applier.status()["pending"] == 2
    envelopes(changes, "2.json", [(3, "u", {"Id": "1"}, {"Id": "1"})])
    with pytest.raises(Exception, match="a planned column is absent"):
        sync.Capture(store, plan.tables).run(str(changes), f"{tmp}/checkpoint").awaitTermination()
    assert not sync.drain(lambda: None, sync.Applier(store, []), 0)


def test_state_is_atomic_and_locks_are_exclusive(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: store.commit(lambda s: s.update(n=s.get("n", 0) + 1), tries=200), range(12)))
    assert store.manifest()["n"] == 12
    with store.lock("load"), pytest.raises(Refused), store.lock("load"):
        pass
    with store.lock("load"):
        pass
    assert len(os.listdir(tmp_path / "manifest")) <= 20  # older ones go
    store.commit(lambda s: s.update(version=99))
    with pytest.raises(Refused):
        Store(spark, str(tmp_path))


def test_a_manifest_whose_writer_died_is_passed_over(spark, tmp_path, monkeypatch):
    import concordia.sources.store as module

    store = Store(spark, str(tmp_path))
    last = max(int(f[:-5]) for f in os.listdir(tmp_path / "manifest") if f.endswith(".json"))
    (tmp_path / "manifest" / f"{last + 1}.json").write_text('{"half')
    monkeypatch.setattr(module, "DEAD_AFTER", 0.5)
    store.commit(lambda s: s.update(n=1))
    assert store.manifest()["n"] == 1 and store.commit(lambda s: s.update(n=2))["n"] == 2


def test_a_lease_runs_out_and_is_lost(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit(lambda s: s["leases"].update(load={"owner": "dead", "until": time.time() + 1.5}))
    with pytest.raises(Refused), store.lock("load"):
        pass
    with pytest.raises(Refused, match="load runs"):
        sync.reset(store, [])
    time.sleep(1.6)
    with store.lock("load", 0.6):
        time.sleep(1.2)
        assert store.held() == ["load"]  # renewed meanwhile
    sync.reset(store, [])
    assert store.held() == []


KILLED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from tests.core.test_jobs import CATALOG, RULES
from concordia.plans import planner, rules as R
from concordia.plans.load import Loader
from concordia.sources.store import Store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
plan = planner.plan(CATALOG, R.load(RULES))
Loader(Store(spark, {state!r}), plan.tables, lambda t: spark.read.parquet({src!r} + "/" + t.source.full), rows_per_chunk=10, chunks_at_once=1, pause=1.0, lease=4.0).run()
"""


def test_a_killed_load_is_resumed(job):
    spark, tmp, plan, store, source = job
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    child = subprocess.Popen([sys.executable, "-c", KILLED.format(repo=repo, state=store.root, src=f"{tmp}/src")], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    end = time.monotonic() + 120
    while time.monotonic() < end:
        chunks = store.manifest()["chunks"].get("item")
        if chunks and len(os.listdir(f"{store.root}/chunks/item/{chunks['load']}/tries")) >= 2:
            break
        time.sleep(0.1)
    os.killpg(child.pid, signal.SIGKILL)
    child.wait()
    done = {r.chunk_no for r in chunk_states(store, "item").where("status = 'DONE'").collect()}
    assert 1 <= len(done) < 10
    time.sleep(max(0.0, store.manifest()["leases"].get("load", {}).get("until", 0) - time.time()) + 0.1)
    assert Loader(store, plan.tables, source, rows_per_chunk=99).run() == {"item": "LOADED", "note": "LOADED"}
    states = chunk_states(store, "item").collect()
    assert len(states) == 10 and all(r.attempts == 1 for r in states if r.chunk_no in done) and sync.Applier(store, plan.tables).read("item").count() == 100
    assert sync.Applier(store, plan.tables).read("item").select("id").distinct().count() == 100


def test_changes_leave_untouched_buckets_alone(job):
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    applier = sync.Applier(store, plan.tables, rows_per_bucket=2)
    capture = sync.Capture(store, plan.tables)
    full = lambda k: {"Id": str(k), "nm": "new", "amt": "1.0000", "body": "b"}
    envelopes(tmp / "changes", "1.json", [(10, "u", {"Id": "5"}, full(5))])
    run = lambda: capture.run(str(tmp / "changes"), f"{tmp}/checkpoint").awaitTermination()
    run()
    assert applier.step() == 1
    before = store.files(store.manifest(), "item")
    envelopes(tmp / "changes", "2.json", [(20 + i, "u", {"Id": str(5 + i % 3)}, full(5 + i % 3)) for i in range(1000)])
    run()
    assert applier.step() == 1000
    after = store.files(store.manifest(), "item")
    assert len(before) == 50 and 1 <= sum(before[b] != after[b] for b in before) <= 3
    assert applier.read("item").where("nm = 'new'").count() == 3 and applier.read("item").count() == 100


def test_the_source_log_proves_the_end(job):
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    applier, capture = sync.Applier(store, plan.tables), sync.Capture(store, plan.tables)
    at = "0000000a:00000000:0001"
    (tmp / "changes").mkdir()
    run = lambda: capture.run(str(tmp / "changes"), f"{tmp}/checkpoint").awaitTermination()
    tables = lambda **t: [spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp}/log/{n}") for n, (rows, schema) in t.items()]
    scans = "started_at string, ended_at string"
    tables(log_times=([(at, "2026-01-01 00:00:00")], "lsn string, commit_at string"), log_scans=([("2026-01-01 00:00:01", "2026-01-01 00:00:02")], scans), log_clock=([("2026-01-01 00:00:05",)], "now string"))
    log = SourceLog.folder(spark, f"{tmp}/log")
    assert log.snapshot() == Snapshot("2026-01-01 00:00:05.000000", at, "2026-01-01 00:00:00.000000") and log.oldest() == at and log.reuse_wait() is None
    tables(log_database=([("REPLICATION",)], "log_reuse_wait string"))
    assert log.reuse_wait() == "REPLICATION"
    assert not sync.drain(run, applier, 1.0, 0.1, log)  # the position isn't captured
    envelopes(tmp / "changes", "1.json", [(10, "d", {"Id": "5"}, None)])
    assert not sync.drain(run, applier, 3.0, 0.1, log) and store.manifest()["applied"] == 1  # applied, but no scan has started since
    tables(log_scans=([("2026-01-01 00:00:06", None)], scans))
    assert not sync.drain(run, applier, 2.0, 0.1, log)  # one has, and runs on
    tables(log_scans=([("2026-01-01 00:00:06", "2026-01-01 00:00:07")], scans))
    assert sync.drain(run, applier, 60, 0.1, log)
    with sync.ticking(applier, 30):
        pass
    assert store.manifest()["watermark"]["pending"] == 0 and store.manifest()["watermark"]["stream_lsn"] == at


def test_a_database_is_read_in_ranges(spark, tmp_path):
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    if not sources.driver_there(spark, driver):
        pytest.skip("no database on the class path")
    url = f"jdbc:derby:{tmp_path}/db"
    rows = spark.range(50).select(F.col("id").cast("int").alias("Id"), F.concat(F.lit("n"), "id").alias("nm"), F.lit("1.5").cast("decimal(19,4)").alias("amt"), F.lit("b").alias("body"))
    spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true").createStatement().execute('CREATE SCHEMA "dbo"')
    rows.write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", '"dbo"."Item"').save()
    plan = planner.plan(CATALOG, R.load(RULES), include=["dbo.Item"])
    store = Store(spark, f"{tmp_path}/state")
    store.commit(lambda s: s.update(job="SCHEMA_DONE"))
    source = sources.reader(spark, url, {"driver": driver})
    assert "PushedFilters: [*IsNotNull(Id), *GreaterThanOrEqual(Id,5)]" in source(plan.tables[0]).where("Id >= 5")._jdf.queryExecution().toString()
    assert Loader(store, plan.tables, source, rows_per_chunk=20).run() == {"item": "LOADED"}
    assert co.verify_run(store, plan.tables, source, lambda t: sync.Applier(store, plan.tables).read(t.name))["status"] == "MATCHED"
    with pytest.raises(ValueError, match="class path"):
        sources.reader(spark, url, {"driver": "no.such.Driver"})


def test_reset_and_create(job):
    spark, tmp, plan, store, source = job
    assert create_tables(store, plan.tables) == ["item", "note"] == create_tables(store, plan.tables)
    Loader(store, plan.tables, source).run()
    sync.reset(store, ["item"])
    assert store.manifest()["tables"]["item"] == {"status": "PLANNED", "files": None} and sync.Applier(store, plan.tables).read("item").count() == 0
    with pytest.raises(Refused):
        create_tables(store, plan.tables)
    create_tables(store, plan.tables, replace=True)
    sync.reset(store)
    assert store.manifest()["job"] == "SCHEMA_DONE"


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nA='from file'\nexport B=b\n")
    monkeypatch.setenv("B", "from env")
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"source": "${A}", "state": "${B}", "job": "${C:j}"}))
    got = cfg.load(f)
    assert (got["source"], got["state"], got["job"], got["batch_size"]) == ("from file", "from env", "j", 100_000)
    for bad in ({"source": "x"}, {"source": "x", "state": "y", "job": "z", "typo": 1}, {"source": "${NOPE}", "state": "y", "job": "z"}, {"source": "x", "state": "y", "job": "z", "batch_size": 0}):
        f.write_text(json.dumps(bad))
        with pytest.raises(cfg.ConfigError):
            cfg.load(f)
    assert cfg.fingerprint({}, {}) != cfg.fingerprint({"a": 1}, {}) and "secret" not in safe("duplicate key value 'secret'\nmore") and "reset" in explained("position is no longer available")


def test_command_line(job, tmp_path, capsys):
    spark, tmp, plan, store, source = job
    item = CATALOG.tables[0]
    raw = {"tables": [{"schema": "dbo", "name": "Item", "columns": [{k: getattr(c, k) for k in ("ordinal", "name", "type", "max_length", "precision", "scale", "nullable", "computed")} for c in item.columns], "indexes": [{"name": "pk_item", "kind": "PRIMARY_KEY", "keys": [["Id", False]]}]}]}
    (tmp / "src" / "catalog.json").write_text(json.dumps(raw))
    (tmp / "rules.json").write_text(json.dumps(RULES))
    c = tmp / "job.json"
    c.write_text(json.dumps({"source": f"{tmp}/src", "state": f"{tmp}/cli", "job": "j", "rules": f"{tmp}/rules.json"}))
    run = lambda *a: cli.main([*a, "--config", str(c), "--out", f"{tmp}/out"])
    assert run("plan") == co.OK and (tmp / "out" / "plan.txt").exists()
    assert run("load") == co.REFUSED and run("init") == co.OK and run("load") == co.REFUSED and run("schema") == co.OK
    assert run("load") == co.REFUSED  # no capture has recorded where the log starts
    assert run("load", "--no-changes") == co.OK and run("schema") == co.REFUSED
    (tmp / "src" / "changes").mkdir()
    assert run("sync") == co.OK and run("verify") == co.OK and run("cutover") == co.OK and run("check") == co.OK and run("status") == co.OK
    assert run("vacuum") == co.OK and run("load") == co.REFUSED and cli.main(["nonsense"]) == co.BAD_CONFIG and cli.main(["plan", "--config", f"{tmp}/none.json"]) == co.BAD_CONFIG
    (tmp / "rules.json").write_text("{}")
    assert run("plan") == co.BLOCKED and run("load") == co.BLOCKED


def test_command_line_with_a_capture_first(job, capsys):
    spark, tmp, plan, store, source = job
    item = CATALOG.tables[0]
    raw = {"tables": [{"schema": "dbo", "name": "Item", "columns": [{k: getattr(c, k) for k in ("ordinal", "name", "type", "max_length", "precision", "scale", "nullable", "computed")} for c in item.columns], "indexes": [{"name": "pk_item", "kind": "PRIMARY_KEY", "keys": [["Id", False]]}]}]}
    (tmp / "src" / "catalog.json").write_text(json.dumps(raw))
    (tmp / "rules.json").write_text(json.dumps(RULES))
    at = "0000000a:00000000:0001"
    spark.createDataFrame([(at, "2026-01-01 00:00:00")], "lsn string, commit_at string").write.parquet(f"{tmp}/log/log_times")
    spark.createDataFrame([("2026-01-01 00:00:06", "2026-01-01 00:00:07")], "started_at string, ended_at string").write.parquet(f"{tmp}/log/log_scans")
    spark.createDataFrame([("2026-01-01 00:00:05",)], "now string").write.parquet(f"{tmp}/log/log_clock")
    settings = {"source": f"{tmp}/src", "state": f"{tmp}/cli", "job": "j", "rules": f"{tmp}/rules.json", "log": f"{tmp}/log", "changes": f"{tmp}/changes"}
    c = tmp / "job.json"
    c.write_text(json.dumps(settings))
    run = lambda *a: cli.main([*a, "--config", str(c)])
    envelopes(tmp / "changes", "1.json", [(10, "d", {"Id": "5"}, None)])
    assert run("init") == co.OK and run("schema") == co.OK and run("load") == co.REFUSED
    assert "start position" in capsys.readouterr().err
    assert run("sync", "--once") == co.OK and run("load") == co.OK and run("sync") == co.OK
    assert run("status") == co.OK
    out = capsys.readouterr().out
    shown = json.loads(out[out.index("{") :])
    assert shown["pending"] == 0 and shown["applied"] == 1 and shown["source"]["log_from"] == at and shown["source"]["log_reuse_wait"] is None
    c.write_text(json.dumps(settings | {"rows_per_bucket": 7}))  # other settings than the job began with
    assert run("load") == co.REFUSED and run("sync", "--once") == co.REFUSED
    assert "settings" in capsys.readouterr().err
