import pytest
from pyspark.sql import functions as F

from concordia.operators import catalog, changes, chunks, constraints, verify


def test_even_split_vectors():
    assert chunks.even_starts(1, 100, 4) == [26, 51, 76] and chunks.even_starts(1, 2, 4) == [2] and chunks.even_starts(10, 10, 4) == [] and chunks.even_starts(-5, 4, 2) == [0]
    assert chunks.ranges([26, 51]) == [(None, 26), (26, 51), (51, None)] and chunks.ranges([]) == [(None, None)]
    assert chunks.chunk_count(10, 3, ["int"]) == 4 and chunks.chunk_count(10, 3, []) == 1 and chunks.chunk_count(10, 3, ["xml"]) == 1 and chunks.chunk_count(0, 3, ["int"]) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 13])
def test_tiles_equal_ntile(spark, n):
    df = spark.range(10).select((F.col("id") * 7 % 10).alias("k")).repartition(3)
    rows, size, more, at = list(range(10)), 10 // n, 10 % n, 0
    want = []
    for t in range(1, n + 1):
        if t > 1 and at < 10:
            want.append((t, rows[at]))
        at += size + (t <= more)
    got = sorted(tuple(r) for r in chunks.ntile_starts(df, ["k"], n).collect())
    assert got == [w for w in want if w[0] <= max(1, min(n, 10))]


def test_ranges_of_a_composite_key_cover_every_row_once(spark):
    df = spark.createDataFrame([(a, b) for a in range(5) for b in "xyz"], "a int, b string")
    for edges in ([[None, None]], [[None, [1, "y"]], [[1, "y"], [3, "z"]], [[3, "z"], None]]):
        parts = [df.where(chunks.in_range(["a", "b"], lo, hi)).count() for lo, hi in edges]
        assert sum(parts) == 15
    plan = df.where(chunks.in_range(["a"], [1], [3]))
    assert plan.count() == 6


def test_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{tmp_path}/t")
    text = spark.read.parquet(f"{tmp_path}/t").where(chunks.in_range(["a", "b"], [1, 2], [3, 4]))._jdf.queryExecution().toString()
    pushed = text.split("PushedFilters: ")[1].split("\n")[0]
    assert "GreaterThan(a,1)" in pushed and "GreaterThanOrEqual(b,2)" in pushed


SPEC = verify.TableSpec("t", (verify.ColumnSpec("k", "int"), verify.ColumnSpec("v", "varchar"), verify.ColumnSpec("n", "decimal", 2)), ("k",))


def test_one_changed_row_and_one_lost_row_are_found(spark):
    rows = [(i, f"v{i}", None if i == 3 else f"{i}.50") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v string, n string").withColumn("n", F.col("n").cast("decimal(9,2)"))
    target = df.where("k <> 7").withColumn("v", F.when(F.col("k") == 5, F.concat("v", F.lit(" "))).otherwise(F.col("v"))).unionByName(df.where("k = 1").withColumn("k", F.lit(99)))
    for narrow in (True, False):
        assert {tuple(r) for r in verify.row_diff(df, target, SPEC, narrow).collect()} == {("5", "diff"), ("7", "missing"), ("99", "extra")}
    assert all(r.matched for r in verify.checks(df, df, SPEC).collect())
    empty = df.limit(0)
    assert all(r.matched for r in verify.checks(empty, empty, SPEC).collect())  # no rows: sums are null and equal
    assert not all(r.matched for r in verify.checks(df, empty, SPEC).collect())
    assert verify.rows_diff(df.unionByName(df.where("k = 2")), df, SPEC).select("src_n", "tgt_n").first() == (2, 1)


def test_constraints(spark):
    df = spark.createDataFrame([(1, "A", 1), (2, "a", 1), (3, None, 300), (4, None, None)], "k int, c string, t int")
    assert constraints.duplicates(df, ["c"], fold=["c"]).count() == 2 and constraints.duplicates(df, ["c"]).count() == 1
    assert constraints.duplicates(df, ["c"], fold=["c"], where=F.col("c").isNotNull()).count() == 1
    assert [r.k for r in constraints.outside(df, "t").collect()] == [3]
    assert [r.k for r in constraints.orphans(df, spark.createDataFrame([("A",)], "p string"), [("c", "p")]).collect()] == [2]
    assert constraints.probe(df, {"c": F.lit("z")}, "k").first() == (1_000_004, "z", 1)


def test_wildcards(spark):
    df = spark.createDataFrame([("dbo.a_b",), ("dbo.aXb",), ("x.a",)], "n string")
    assert [r.n for r in df.where(catalog.selected(F.col("n"), ["DBO.a?b"], ["*x*"])).collect()] == ["dbo.a_b"]
    assert df.where(catalog.selected(F.col("n"), [])).count() == 3


IMAGE = "map<string,struct<v:string,unavailable:boolean>>"
EVENT = f"n int, op string, before {IMAGE}, after {IMAGE}"


def events(spark, rows):
    cell = lambda d: None if d is None else {k: (None, True) if v == "?" else (v, False) for k, v in d.items()}
    df = spark.createDataFrame([(n, op, cell(b), cell(a)) for n, op, b, a in rows], EVENT)
    at = F.lpad(F.col("n").cast("string"), 4, "0")
    return df.select(at.alias("commit_lsn"), at.alias("change_lsn"), F.lit(1).cast("long").alias("event_serial_no"), "op", "before", "after", F.lit("t").alias("table_name"))


def replay(target, rows):
    """The log applied event by event."""
    out = dict(target)
    for _, op, b, a in rows:
        if op == "d" or b and a and b["k"] != a["k"]:
            out.pop(b["k"], None)
        if op != "d":
            old = out.get(a["k"], {})
            out[a["k"]] = {c: old[c] if v == "?" else v for c, v in a.items() if c != "k"}
    return out


def test_netting_equals_replay(spark):
    import random

    rng = random.Random(1)
    target = {str(i): {"v": f"o{i}", "lob": f"L{i}"} for i in range(6)}
    rows, now = [], dict(target)
    for n in range(300):
        k = str(rng.randrange(9))
        if k not in now:
            a = {"k": k, "v": f"v{n}", "lob": f"l{n}"}
            rows.append((n, "c", None, a))
        elif rng.random() < 0.25:
            rows.append((n, "d", {"k": k}, None))
        elif rng.random() < 0.2 and (free := [x for x in map(str, range(9)) if x not in now]):
            rows.append((n, "u", {"k": k}, {"k": free[0], "v": f"v{n}", "lob": f"m{n}"}))
        else:
            rows.append((n, "u", {"k": k}, {"k": k, "v": f"v{n}", "lob": "?"}))
        now = replay(now, rows[-1:])
    df = spark.createDataFrame([(k, x["v"], x["lob"]) for k, x in target.items()], "k string, v string, lob string")
    got = changes.applied_to(df, changes.net_effect(events(spark, rows), ["k"], ["v", "lob"]), ["k"])
    assert {r.k: {"v": r.v, "lob": r.lob} for r in got.collect()} == now


def test_an_image_without_its_value_fails_the_batch(spark):
    df = spark.createDataFrame([("1", "old")], "k string, lob string")
    bad = [(1, "d", {"k": "1"}, None), (2, "c", None, {"k": "1", "lob": "?"})]
    with pytest.raises(Exception, match="no value for column lob"):
        changes.applied_to(df, changes.net_effect(events(spark, bad), ["k"], ["lob"]), ["k"]).collect()
    good = [(1, "u", {"k": "1"}, {"k": "1", "lob": "?"})]
    assert changes.applied_to(df, changes.net_effect(events(spark, good), ["k"], ["lob"]), ["k"]).first() == ("1", "old")


def test_events_of_one_table_stay_where_they_are_when_held_against_its_position(spark):
    at = F.lpad(F.col("id").cast("string"), 4, "0")
    log = spark.range(0, 400, numPartitions=4).select(at.alias("commit_lsn"), at.alias("change_lsn"), F.lit(1).cast("long").alias("event_serial_no"), F.lit("t").alias("table_name"))
    applied = spark.createDataFrame([("T", "0009", "0009", 1), ("u", "0300", "0300", 1)], "table_name string, commit_lsn string, change_lsn string, event_serial_no long")
    got = changes.not_applied(log, applied).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in got) == [90, 100, 100, 100]  # not all in one task
    none = changes.not_applied(log, applied.where("false"))
    assert none.count() == 400 and none.select(F.spark_partition_id()).distinct().count() == 4


def test_netting_sorts_once_and_application_reads_each_side_once(spark):
    rows = [(1, "u", {"k": "1"}, {"k": "1", "v": "a"}), (2, "d", {"k": "1"}, None), (3, "c", None, {"k": "1", "v": "?"}), (4, "u", {"k": "2"}, {"k": "3", "v": "?"}), (5, "u", {"k": "3"}, {"k": "3", "v": "b"}), (6, "d", {"k": "4"}, None)]
    net = changes.net_effect(events(spark, rows), ["k"], ["v"])
    plan = net._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1, plan
    assert {(r.k, r.op, r.epoch, r.v and r.v.v) for r in net.collect()} == {("1", "u", 1, None), ("2", "d", 1, None), ("3", "u", 0, "b"), ("4", "d", 1, None)}
    target = spark.range(10, numPartitions=2).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"))
    after = changes.applied_to(target, changes.net_effect(events(spark, rows[3:]), ["k"], ["v"]), ["k"])
    assert after._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    assert {r.k: r.v for r in after.collect()} == {str(i): "b" if i == 3 else "old" for i in range(10) if i not in (2, 4)}
    folded = spark.createDataFrame([("ab", "old"), ("c", "old")], "k string collate UTF8_LCASE, v string")  # a key that compares without case: the row gets the change's key
    changed = changes.applied_to(folded, changes.net_effect(events(spark, [(1, "u", {"k": "AB"}, {"k": "AB", "v": "?"})]), ["k"], ["v"]), ["k"])
    assert sorted((r.k, r.v) for r in changed.collect()) == [("AB", "old"), ("c", "old")]


def test_faults_are_found_before_netting(spark):
    rows = [(1, "x", {"k": "1"}, {"k": "1"}), (2, "d", None, None), (3, "u", {"k": "1"}, None), (4, "u", {"k": "1"}, {"k": "1", "v": "a\x00"}), (5, "u", {"k": "1"}, {"k": "1", "v": "a"})]
    got = [r.reason for r in changes.faults(events(spark, rows), ["k"], ["v"]).orderBy("commit_lsn").collect()]
    assert got == ["unknown op", "delete without key", "change without key", "NUL character"]


def test_names_messages_and_bounds_as_columns_are_those_of_the_plan(spark):
    from concordia.operators import catalog as cat
    from concordia.plans.load import safe
    from concordia.plans.names import shortened

    names = ["", "a", "a" * 63, "a" * 64, "é" * 31, "é" * 32, "ab😀" * 20, "x" * 53 + "éy" * 9, "x" * 54 + "é" * 9, "n" * 53 + "😀z" * 5]
    texts = ["", "  ", "failed here", " key 'a''b' = (1, 2) and \"c\"\nsecond 'x'", "x" * 400, "\n\nlater 'v'"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", cat.short_names(F.col("n")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: shortened(n) for i, n in enumerate(names)}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cat.safe_messages(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: safe(t) for i, t in enumerate(texts)}


def test_rows_are_hashed_once_where_most_buckets_differ(spark):
    spec = verify.TableSpec("t", (verify.ColumnSpec("id", "bigint"), verify.ColumnSpec("v", "int")), ("id",))
    rows = spark.range(4000).select("id", (F.col("id") % 7).cast("int").alias("v"))
    for every, passes in ((1, 0), (1000, 1)):  # all rows changed; four of them
        changed = F.col("id") % every == 0
        found = verify.row_diff(rows, rows.where("id <> 2000").withColumn("v", F.when(changed, F.col("v") + 1).otherwise(F.col("v"))), spec)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert min(1, plan.count("Aggregate")) == passes  # the pass that counts buckets
        want = {(str(i), "missing" if i == 2000 else "diff") for i in range(0, 4000, every)}
        assert {tuple(r) for r in found.collect()} == want
