import hashlib
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordia.functions import fingerprint, lsn, normalize, values
from concordia.functions.values import ValueRule


def one(spark, column, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, bytes) else F.unhex(F.lit(v.hex())).alias(k) for k, v in cells.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "up", "down"), [
    ("2026-01-01 10:00:00.1234607", "2026-01-01 10:00:00.123461", "2026-01-01 10:00:00.123460"), ("2026-01-01 10:00:00.1234604", "2026-01-01 10:00:00.123460", "2026-01-01 10:00:00.123460"),
    ("2026-12-31 23:59:59.9999995", "2027-01-01 00:00:00.000000", "2026-12-31 23:59:59.999999"), ("1753-01-01 00:00:00", "1753-01-01 00:00:00.000000", "1753-01-01 00:00:00.000000"),
])
def test_timestamps_round_before_any_cast(spark, raw, up, down):
    for how, want in (("half_up", up), ("truncate", down)):
        assert one(spark, values.timestamp_of(F.col("a"), how), a=raw) == datetime.fromisoformat(want)


@pytest.mark.parametrize(("raw", "want"), [("23:59:59.9999997", "24:00:00"), ("01:02:03.0000004", "01:02:03.000000"), ("10:00:00", "10:00:00.000000")])
def test_times(spark, raw, want):
    assert one(spark, values.time_of(F.col("a")), a=raw) == want


def test_text_rules_in_order(spark):
    assert one(spark, values.text_rules(F.col("a"), ValueRule("replace", "�", "rtrim", "upper")), a="aa+\x00 \t ") == "AA+� \t"
    assert one(spark, values.text_rules(F.col("a"), ValueRule("strip", trailing_space="rtrim")), a="a\x00  ") == "a"
    assert one(spark, values.has_nul(F.col("a")), a="a\x00") and not one(spark, values.has_nul(F.col("a")), a=None)


def test_copy_fields(spark):
    assert one(spark, values.copy_text(F.col("a")), a="a\tb\nc\rd\\e") == r"a\tb\nc\rd\\e"
    assert one(spark, values.copy_text(F.col("a")), a="\\N") == "\\\\N" and one(spark, values.copy_text(F.col("a").cast("string")), a=None) == "\\N"
    assert one(spark, values.bytes_text(F.col("a")), a=b"\x01\xff") == "\\x01ff"
    assert [one(spark, values.bit_text(F.col("a"), t), a=True) for t in ("boolean", "smallint")] == ["t", "1"]


@pytest.mark.parametrize(("value", "action", "want"), [("1753-01-01", "keep", "1753-01-01 00:00:00.000"), ("1753-01-01", "null", None), ("1753-01-01", "infinity", "-infinity"), ("9999-12-31 23:59:59.997", "infinity", "infinity"), ("2001-02-03", "infinity", "2001-02-03 00:00:00.000"), ("1900-01-01", "null", None)])
def test_sentinels(spark, value, action, want):
    assert one(spark, normalize.canonical(F.col("a").cast("timestamp_ntz"), "datetime", ValueRule(sentinel=action)), a=value) == want
    if action != "keep" and want != "2001-02-03 00:00:00.000":  # the target side holds the rule's result already
        assert one(spark, normalize.canonical(F.col("a").cast("timestamp_ntz"), "datetime", ValueRule(sentinel=action), False), a=value).startswith(value[:10])


def test_canonical_texts(spark):
    c = lambda kind, cast="string", **k: one(spark, normalize.canonical(F.col("a").cast(cast), kind), **k)
    assert c("char", a="ab  ") == "ab" and c("varchar", a="ab  ") == "ab  " and c("char", a=None) is None
    assert c("decimal", "decimal(9,4)", a="0.0001") == "0.0001" and c("money", "decimal(19,4)", a="922337203685477.5807") == "922337203685477.5807"
    assert c("float", "double", a=1e30) is None and c("float", "double", a=0.5) == "0.5000000000" and c("bit", "int", a=0) == "0"
    assert c("uniqueidentifier", a="AB-C") == "ab-c" and one(spark, normalize.canonical(F.col("a"), "rowversion"), a=b"\x00\x0a") == "000A"
    with pytest.raises(ValueError):
        normalize.canonical(F.col("a"), "geography")
    assert normalize.sum_scale("money") == 4 and normalize.sum_scale("float") is None and normalize.sum_scale("decimal", 3) == 3 and normalize.note("xml")


def test_fingerprints(spark):
    text = "1|\\N|x"
    got = one(spark, fingerprint.row_hash(fingerprint.row_text([F.col("a"), F.col("b").cast("string"), F.col("c")])), a="1", b=None, c="x")
    assert got == int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)
    assert one(spark, fingerprint.bucket(F.col("a")), a="k") == int.from_bytes(hashlib.md5(b"k").digest()[:2], "big")
    pair = lambda exact: [one(spark, fingerprint.row_text([F.col("a"), F.col("b")], exact), a=a, b=b) for a, b in (("a|b", "c"), ("a", "b|c"))]
    assert len(set(pair(False))) == 1 and len(set(pair(True))) == 2
    big = spark.range(4).select(F.lit((1 << 63) - 1).alias("h")).agg(fingerprint.hash_sum(F.col("h"))).first()[0]
    assert big == Decimal(4 * ((1 << 63) - 1))


def test_log_positions_and_lag(spark):
    assert one(spark, lsn.normal(F.col("a")), a="0x0000002A000001F80003") == "0000002a:000001f8:0003"
    assert one(spark, lsn.normal(F.col("a")), a="NULL") is None and one(spark, lsn.normal(F.col("a")), a="0000002A:000001F8:0003") == "0000002a:000001f8:0003"
    assert one(spark, lsn.latest(F.col("a"), F.col("b").cast("string")), a="x", b=None) == "x"
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, lsn.lag_seconds(t("2026-01-01 00:00:05.5"), t("2026-01-01 00:00:03")), a=1) == Decimal("2.500")
    assert one(spark, lsn.lag_seconds(t("2026-01-01 00:00:00"), t("2026-01-01 00:00:03")), a=1) == 0 and one(spark, lsn.lag_seconds(t(None), t("2026-01-01")), a=1) is None
    assert one(spark, lsn.with_staleness(F.lit(1).cast("decimal(12,3)"), t("2026-01-01 00:00:00"), t("2026-01-01 00:00:20")), a=1) == 20


@pytest.mark.parametrize(("kind", "raw", "want"), [("timestamp_millis", "-6847804799003", datetime(1753, 1, 1, 0, 0, 0, 997000)), ("timestamp_micros", "1000001", datetime(1970, 1, 1, 0, 0, 1, 1)), ("timestamp_nanos", "-1500", datetime(1969, 12, 31, 23, 59, 59, 999999)), ("time_micros", "3723000001", "01:02:03.000001"), ("long", "7", 7), ("string", "x", "x")])
def test_payload_values(spark, kind, raw, want):
    assert one(spark, lsn.decode(F.col("a"), kind), a=raw) == want
