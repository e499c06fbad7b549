"""A change table as a stream, and a database read in ranges."""

import uuid

import pytest
from pyspark.sql import functions as F

from concordia.operators import chunks as C
from concordia.operators import views
from concordia.plans.load import Loader
from concordia.sources import changetable as ct
from concordia.sources import tables
from concordia.sources.log import Snapshot, SourceLog
from concordia.streaming import sync
from tests.core.test_jobs import job  # noqa: F401

AT = lambda n: f"{n:08x}:00000000:0001"


def records(spark, folder, rows):
    """Rows of (commit, serial, item id); a commit of None with a serial is a heartbeat at that position."""
    out = []
    for commit, serial, k in rows:
        if k is None:
            out.append(("HEARTBEAT", AT(commit), None, None, None, None, None, None, None, None, None))
        else:
            out.append(("CHANGE", AT(commit), "dbo", "Item", "u", AT(commit), AT(commit), serial, None, {"Id": str(k)}, {"Id": str(k), "nm": f"v{commit}", "amt": "1.0000", "body": "b"}))
    spark.createDataFrame(out, ct.SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def taken(spark, folder, checkpoint, **more):
    """What one run of the stream brings: lists of commits by batch."""
    got = []
    events = ct.changes(spark, folder, progress=f"{checkpoint}-progress", **more)
    take = lambda b, i: got.append(sorted((int(r.commit_lsn[:8], 16), r.event_serial_no) for r in b.where("kind = 'CHANGE'").collect()))
    events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return [b for b in got if b]


def test_batches_end_with_whole_transactions(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    records(spark, folder, [(1, 1, 5), (1, 2, 6), (2, 1, 5)])
    records(spark, folder, [(2, 2, 7), (2, 3, 8), (3, 1, 9)])  # the second transaction goes over two files, the third may go on
    assert taken(spark, folder, checkpoint) == [[(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]]
    assert taken(spark, folder, checkpoint) == []
    records(spark, folder, [(3, 2, 9), (4, 1, None)])  # a heartbeat ends it
    assert taken(spark, folder, checkpoint) == [[(3, 1), (3, 2)]]
    middle = taken(spark, folder, str(tmp_path / "c2"), start=AT(2))  # from the middle of the second: it comes whole
    assert middle == [[(2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]]


def test_admission_counts_transactions_and_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / "t")
    for k in range(4):
        records(spark, folder, [(5 * k + j, s, j) for j in range(1, 6) for s in (1, 2)])
    reader = ct.Reader({"path": folder, "transactions": "3", "progress": str(tmp_path / "p")})
    ends, at = [], reader.initialOffset()
    while (end := reader.latestOffset()) != at:
        rows = sum(b.num_rows for p in reader.partitions(at, end) for b in reader.read(p))
        ends.append((int(end["lsn"][:8], 16), rows))
        reader.commit(end)
        at = end
        if len(ends) == 2:  # begin again from what was committed
            reader = ct.Reader({"path": folder, "transactions": "3", "progress": str(tmp_path / "p")})
            assert reader.at == at
    assert ends == [(3, 6), (6, 6), (9, 6), (12, 6), (15, 6), (18, 6), (19, 2)]  # the twentieth may go on
    assert ct.Reader({"path": str(tmp_path / "none")}).latestOffset() == {"lsn": "", "inclusive": False}


def test_a_change_table_feeds_the_capture(job):  # noqa: F811
    spark, tmp, plan, store, source = job
    Loader(store, plan.tables, source).run()
    folder = str(tmp / "t")
    records(spark, folder, [(c, s, 10 * c + s) for c in range(1, 6) for s in (1, 2)] + [(9, 1, None)])
    capture = sync.Capture(store, plan.tables)
    capture.start(ct.changes(spark, folder, transactions=2, progress=f"{tmp}/p"), f"{tmp}/checkpoint").awaitTermination()
    while store.manifest()["captured"] < 10:  # a batch takes two transactions
        before = store.manifest()["captured"]
        capture.start(ct.changes(spark, folder, transactions=2, progress=f"{tmp}/p"), f"{tmp}/checkpoint").awaitTermination()
        assert before < store.manifest()["captured"] and store.manifest()["captured"] % 4 in (0, 2)
    applier = sync.Applier(store, plan.tables)
    assert applier.step() == 10 and applier.read("item").where("nm like 'v%'").count() == 10


# ------------------------------------------------------------------ databases

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def database(spark, n=60):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex}"
    spark._jvm.java.sql.DriverManager.getConnection(f"{url};create=true").close()
    rows = spark.range(n).select((F.col("id") % 4).cast("int").alias("a"), F.concat(F.lit("k'"), F.lpad("id", 3, "0")).alias("b"), F.col("id").alias("v"))
    rows.write.jdbc(url, '"APP"."t"', properties={"driver": DRIVER, "createTableColumnTypes": "b varchar(20)"})
    return url


def test_ranges_are_the_partitions_of_one_read(spark):
    url = database(spark)
    starts = [["0", "k'030"], ["2", "k'000"], ["3", "k'"]]
    read = tables.in_ranges(spark, url, "APP", "t", ["a", "b"], ["int", "varchar"], C.ranges(starts), {"driver": DRIVER})
    got = [(r.p, r.a, r.b) for r in read.withColumn("p", F.spark_partition_id()).collect()]
    assert read.rdd.getNumPartitions() == 4 and len(got) == 60
    assert all(sum((a, b) >= (int(x), y) for x, y in starts) == p for p, a, b in got)


def test_reads_begin_with_their_isolation_level(spark):
    url = database(spark, 3)
    level = lambda more: spark.read.format("jdbc").option("url", url).option("query", 'SELECT CURRENT ISOLATION AS L FROM "APP"."t"').options(**tables.jdbc_options(url, more | {"driver": DRIVER})).load().first()[0].strip()
    assert level({"isolation": "serializable"}) == "RR" and level({"isolation": "read uncommitted"}) == "UR" and level({}) == "CS"
    assert tables.jdbc_options("jdbc:sqlserver://h", {"isolation": "snapshot"})["sessionInitStatement"] == "SET TRANSACTION ISOLATION LEVEL SNAPSHOT"
    with pytest.raises(ValueError, match="words"):
        tables.jdbc_options(url, {"isolation": "x; drop table t"})


def test_range_conditions_as_text():
    assert C.range_sql(["k"], ["bigint"], None, None) == "1 = 1"
    assert C.range_sql(["k"], ["bigint"], ["5"], ["9"]) == '"k" >= 5 AND "k" < 9'
    assert C.range_sql(["d", "n"], ["date", "varchar"], ["2026-01-01", "o'x"], None, "`") == "(`d` > DATE '2026-01-01' OR (`d` = DATE '2026-01-01' AND `n` >= 'o''x'))"


def test_rows_of_ranges_are_counted_alike_by_search_and_by_as_of(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 50 != 0, F.col("id") * 3 % 701).alias("k"))
    for starts in ([], [10], [0, 1, 2, 350, 351, 700, 900]):
        bounds = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(C.ranges(starts))], "chunk_no long, lower long, upper long")
        one, two = ({r.chunk_no: r.row_count for r in C.chunk_counts(df, "k", bounds, most).collect()} for most in (100, -1))
        assert one == two and sum(one.values()) == 980 and len(one) == len(starts) + 1


def test_a_lookup_finds_the_last_position_over_many_ranges(spark):
    times = spark.range(30_000).select((F.col("id") * 2).alias("lsn"), F.concat(F.lit("t"), F.col("id") * 2).alias("commit_at")).unionByName(spark.createDataFrame([(None, "never")], "lsn long, commit_at string"))
    probes = spark.range(-5, 200_000, numPartitions=6).select(F.when(F.col("id") != 7, F.col("id")).alias("probe"))
    for probe in (probes, probes.where("probe > 150000")):  # the second: ranges without any times
        found = views.as_of(probe, times, "probe")
        want = F.when(F.col("probe") >= 0, F.concat(F.lit("t"), F.least(F.lit(59_998), F.col("probe") - F.col("probe") % 2)))
        n, wrong = found.agg(F.count("*"), F.count_if(~F.col("commit_at").eqNullSafe(want))).first()
        assert (n, wrong) == (probe.count(), 0)


def test_a_database_s_own_tables_say_what_its_log_holds(spark):
    url = database(spark, 1)
    statement = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    statement.execute("CREATE TABLE times (lsn varchar(22), ended timestamp)")
    statement.execute("CREATE TABLE scans (a timestamp, b timestamp)")
    statement.execute("INSERT INTO times VALUES ('0x0000000A000000000001', '2026-01-01 00:00:00'), ('0x0000000B000000000002', '2026-01-01 00:00:03')")
    statement.execute("INSERT INTO scans VALUES ('2026-01-01 00:00:04', '2026-01-01 00:00:05'), ('2026-01-01 00:00:06', NULL)")
    queries = {"log_times": "SELECT lsn, ended AS commit_at FROM times", "log_scans": "SELECT a AS started_at, b AS ended_at FROM scans", "log_clock": "SELECT MAX(a) AS now FROM scans", "log_bounds": "SELECT 'Dbo.' || SUBSTR(lsn, 10, 1) AS table_name, lsn AS low FROM times"}
    log = SourceLog.jdbc(spark, url, {"driver": DRIVER}, queries)
    assert log.snapshot() == Snapshot("2026-01-01 00:00:06.000000", "0000000b:00000000:0002", "2026-01-01 00:00:03.000000")
    assert log.scanned_since("2026-01-01 00:00:03.000000") and not log.scanned_since("2026-01-01 00:00:05.000000") and log.oldest() == "0000000b:00000000:0002" and log.oldest(["dbo.A"]) == "0000000a:00000000:0001" and log.reuse_wait() is None
