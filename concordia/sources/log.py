"""A source's change log as the source itself sees it: its clock, its last commit, its scans, what it still holds (SRC10, STR5, STR8)."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.operators import views
from concordia.sources.store import Refused
from concordia.sources.tables import jdbc_options


#: Where a source of this kind keeps what it knows of its log.
LOG_QUERIES = {
    "log_times": "SELECT CONVERT(varchar(22), start_lsn, 1) AS lsn, tran_end_time AS commit_at FROM cdc.lsn_time_mapping WHERE tran_id <> 0x00",
    "log_scans": "SELECT start_time AS started_at, end_time AS ended_at FROM sys.dm_cdc_log_scan_sessions WHERE session_id > 0",
    "log_clock": "SELECT SYSDATETIME() AS now",
    "log_bounds": "SELECT OBJECT_SCHEMA_NAME(source_object_id) + '.' + OBJECT_NAME(source_object_id) AS table_name, CONVERT(varchar(22), MIN(start_lsn), 1) AS low FROM cdc.change_tables GROUP BY source_object_id",
    "log_database": "SELECT log_reuse_wait_desc AS log_reuse_wait FROM sys.databases WHERE database_id = DB_ID()",
}


class LogCut(Refused):
    """The source's log no longer goes back to where the job stopped."""


@dataclass(frozen=True)
class Snapshot:
    """The source's clock, and the last commit in its log; times as texts that order as times do."""

    at: str
    max_lsn: str | None = None
    max_commit_at: str | None = None


class SourceLog:
    """Reads the tables that a source keeps of its log, by name.

    ``log_times`` (lsn, commit_at) has the commits that the log still holds, ``log_scans`` (started_at,
    ended_at) the scans that filled it.  Two more are used where ``has`` says that they are there:
    ``log_clock`` (now), the source's clock, for which Spark's stands in, which must then agree with it
    to within a second; and ``log_bounds`` (low, and table_name if it differs by table), the position
    from which on the log is whole, for which its first commit stands in.  ``log_database`` (log_reuse_wait) says what keeps the log from being
    cut, which is shown with the job's status.
    """

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], has: Callable[[str], bool] = lambda _: False) -> None:
        self.spark, self.read, self.has = spark, read, has

    @classmethod
    def folder(cls, spark: SparkSession, folder: str) -> SourceLog:
        """Tables as Parquet folders."""

        def has(name: str) -> bool:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

        return cls(spark, lambda t: spark.read.parquet(f"{folder}/{t}"), has)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, options: dict | None = None, queries: dict[str, str] | None = None) -> SourceLog:
        """Tables as queries of a database; positions in any notation of ``lsn.normal``.  Without ``queries``, those of a source that keeps its log in change-data tables."""
        known = queries or LOG_QUERIES
        more = jdbc_options(url, options)

        def read(name: str) -> DataFrame:
            df = spark.read.format("jdbc").option("url", url).option("query", known[name]).options(**more).load()
            df = df.toDF(*[c.lower() for c in df.columns])
            return df.withColumns({c: lsn.normal(F.col(c)) for c in ("lsn", "low") if c in df.columns})

        return cls(spark, read, lambda name: name in known)

    def clock(self) -> DataFrame:
        return self.read("log_clock") if self.has("log_clock") else self.spark.range(1).select(F.current_timestamp().cast("timestamp_ntz").alias("now"))

    def snapshot(self) -> Snapshot:
        now = self.clock().agg(F.max(_time("now"))).first()[0]  # before the log is looked at, so that no commit is dated after it by reading late
        r = views.log_status(self.read("log_times"), self.read("log_scans")).select("max_lsn", _time("max_commit_at").alias("at")).first()
        return Snapshot(now, r["max_lsn"], r["at"])

    def scanned_since(self, mark: str) -> bool:
        """Whether a scan that started after the mark has ended."""
        return not self.read("log_scans").where((_time("started_at") > mark) & F.col("ended_at").isNotNull()).limit(1).isEmpty()

    def reuse_wait(self) -> str | None:
        """SRC10: what the source's log waits for before it can be cut; a capture that stands still lets it grow."""
        row = self.read("log_database").select("log_reuse_wait").first() if self.has("log_database") else None
        return row[0] if row else None

    def oldest(self, tables: Collection[str] = ()) -> str | None:
        """The position from which on the log is whole, for the given tables (schema.table) where it differs by table."""
        if self.has("log_bounds"):
            bounds = self.read("log_bounds")
            if tables and "table_name" in bounds.columns:
                bounds = bounds.where(F.lower("table_name").isin([t.lower() for t in tables]))
            return bounds.agg(F.max("low")).first()[0]
        return self.read("log_times").agg(F.min("lsn")).first()[0]


def _time(c: str):
    return F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


class Quiet:
    """STR5: the proof that a source is no longer written to; ``look`` is called until it is done."""

    def __init__(self, source: SourceLog) -> None:
        self.source, self.mark = source, None

    def look(self, captured_to: str | None, idle: bool) -> bool:
        """One look.  ``captured_to`` is the stream's position, ``idle`` says that nothing captured waits to be applied."""
        now = self.source.snapshot()
        if not idle or not _holds(captured_to, now):
            self.mark = None
        elif self.mark is None or (now.max_commit_at or "") > self.mark:
            self.mark = now.at
        elif self.source.scanned_since(self.mark):
            again = self.source.snapshot()  # the scan may have brought commits since the first look
            return (again.max_commit_at or "") <= self.mark and _holds(captured_to, again)
        return False


def _holds(captured_to: str | None, now: Snapshot) -> bool:
    return now.max_lsn is None or (captured_to or "") >= now.max_lsn


def check_retention(state: dict, source: SourceLog, tables: Collection[str] = ()) -> None:
    """STR8: what the job has captured must reach the span that the source's log still holds.

    A log that holds nothing says nothing of what it held, and a job that has captured nothing begins where the log does.
    """
    stored, oldest = state.get("stream_lsn"), source.oldest(tables)
    if stored and oldest and stored < oldest:
        raise LogCut(f"the source's log begins at {oldest}, and changes after {stored} are no longer available")
