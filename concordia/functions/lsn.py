"""Positions in a change log (MSC1, MSC2), values in its payloads (MSC3) and lag (MSC4, MSC5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds without a scan of the log after which the capture counts as standing still.
STALE_SECONDS = 15


def normal(c: Column) -> Column:
    """``xxxxxxxx:xxxxxxxx:xxxx`` in lower case; the text NULL and blanks are null."""
    text = F.lower(F.trim(c))
    hexed = F.regexp_replace(text, "^0x", "")
    plain = F.concat_ws(":", F.substr(hexed, F.lit(1), F.lit(8)), F.substr(hexed, F.lit(9), F.lit(8)), F.substr(hexed, F.lit(17), F.lit(4)))
    return F.when(text.isin("null", ""), None).when(hexed.rlike("^[0-9a-f]{20}$"), plain).when(text.rlike("^[0-9a-f]{8}:[0-9a-f]{8}:[0-9a-f]{4}$"), text)


def of_number(n: Column) -> Column:
    """A log position made from a number, for logs that number their entries."""
    return F.concat(F.lpad(F.lower(F.hex(n)), 8, "0"), F.lit(":00000000:0001"))


def latest(*c: Column) -> Column:
    """The later of two positions; null is before all."""
    return F.greatest(*c)


def position(commit: str = "commit_lsn", change: str = "change_lsn", serial: str = "event_serial_no") -> Column:
    """MSC2: compared field by field; positions are fixed-width text, so text order is log order."""
    return F.struct(F.col(commit).alias("commit_lsn"), F.col(change).alias("change_lsn"), F.col(serial).alias("event_serial_no"))


def lag_seconds(source_max: Column, applied: Column) -> Column:
    """MSC4: never negative, null if either side is unknown."""
    seconds = (F.unix_micros(source_max.cast("timestamp")) - F.unix_micros(applied.cast("timestamp"))) / 1e6
    return F.when(source_max.isNotNull() & applied.isNotNull(), F.greatest(seconds, F.lit(0.0))).cast("decimal(12,3)")


def with_staleness(lag: Column, last_scan: Column, now: Column) -> Column:
    """MSC5: a capture that has not scanned for a while lags at least that long."""
    still = ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_scan.cast("timestamp"))) / 1e6).cast("decimal(12,3)")
    return F.when(lag.isNotNull() & (still > STALE_SECONDS), F.greatest(lag, still)).otherwise(lag)


def decode(value: Column, kind: str) -> Column:
    """MSC3: a payload's text to a value. Epochs may be before 1970, so nanoseconds are floored."""
    n = value.cast("bigint")
    micros_of = lambda x: F.call_function("div", x + 500 - F.pmod(x + 500, F.lit(1000)), F.lit(1000))  # noqa: E731 - in whole numbers: a double can't hold them
    ntz = lambda micros: F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    clock = lambda micros: F.date_format(ntz(micros), "HH:mm:ss.SSSSSS")
    if kind in ("bytes", "binary"):
        return F.unbase64(value)
    table = {
        "date": lambda: F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int")),
        "timestamp_millis": lambda: ntz(n * 1000), "timestamp_micros": lambda: ntz(n), "timestamp_nanos": lambda: ntz(micros_of(n)),
        "time_millis": lambda: clock(n * 1000), "time_micros": lambda: clock(n), "time_nanos": lambda: clock(micros_of(n)),
        "long": lambda: n, "boolean": lambda: value.cast("boolean"), "string": lambda: value,
    }
    return table[kind]()
