"""What a job's state tables show (JOIN6-JOIN9, AGG7-AGG9, AGG12, SRT2, SRT3, STR4, WFL8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import lsn
from concordia.operators.chunks import dealt


def as_of(probes: DataFrame, times: DataFrame, probe: str, at: str = "lsn", value: str = "commit_at") -> DataFrame:
    """JOIN7: for each probe the value at the last position up to it.

    Probes and times are put in one stream in order of position; a running maximum over ranges
    of positions and the maximum of all earlier ranges give the answer without pairing rows.  Both
    take a row's range from where the ranges start, which is settled beforehand.
    """
    from pyspark.sql import Window as W

    both = times.where(F.col(at).isNotNull()).select(F.col(at).alias("_p"), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(probes.schema[probe].dataType).alias(probe))
    both = both.unionByName(probes.select(F.col(probe).alias("_p"), F.lit(None).cast(both.schema["_t"].dataType).alias("_t"), F.lit(1).alias("_k"), F.col(probe)))
    both, parts = dealt(both, "_p")
    run = W.partitionBy("_part").orderBy("_p", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = both.where("_k = 0").groupBy("_part").agg(F.max("_t").alias("_m"))
    every = probes.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part")).join(last, "_part", "left")  # a row per range, also of those without times
    edge = every.select("_part", F.max("_m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    found = both.withColumn("_here", F.max("_t").over(run)).where("_k = 1").join(F.broadcast(edge), "_part")
    return found.select(probe, F.coalesce("_here", "_before")["v"].alias(value))


def log_status(log_times: DataFrame, scans: DataFrame) -> DataFrame:
    """SRC10, AGG9, JOIN6: one row: last log position, its commit time and the end of the last scan; nulls where nothing is known."""
    last = log_times.agg(F.max_by("commit_at", "lsn").alias("max_commit_at"), F.max("lsn").alias("max_lsn"))
    return last.withColumn("_one", F.lit(1)).join(scans.agg(F.max("ended_at").alias("last_scan_at")).withColumn("_one", F.lit(1)), "_one", "left").select("max_lsn", "max_commit_at", "last_scan_at")


def retention(stopped: DataFrame, log_times: DataFrame, stored: str = "stored") -> DataFrame:
    """STR8: positions where jobs stopped, with the first one that the log still holds, ``low``, and whether each ``goes_on`` from there; an empty log says nothing."""
    low = log_times.agg(F.min("lsn").alias("low")).withColumn("_one", F.lit(1))
    rows = stopped.withColumn("_one", F.lit(1)).join(F.broadcast(low), "_one", "left").drop("_one")  # a row
    return rows.withColumn("goes_on", F.coalesce(F.col(stored) >= F.col("low"), F.lit(True)))


def job_progress(jobs: DataFrame, tables: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """JOIN6, JOIN9, AGG7, AGG8: per table its chunks, loaded rows and pending changes."""
    of_chunks = chunks.groupBy("job_table_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("status") == "DONE").alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.sum(F.when(F.col("status") == "DONE", F.col("row_count"))).alias("rows")
    )
    pending = log.groupBy(F.lower("table_name").alias("_t")).agg(F.count("*").alias("pending"), F.min("commit_lsn").alias("first_pending"))
    rows = jobs.join(tables, "job_id", "left").join(of_chunks, "job_table_id", "left").join(pending, F.lower("src_table") == F.col("_t"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "done", "failed", "rows", "pending")]
    return rows.select("job_id", "job_table_id", "src_table", F.col("table_status").alias("status"), *zero, "first_pending")


def verify_rollup(results: DataFrame, tables: DataFrame, diffs: DataFrame) -> DataFrame:
    """JOIN8, AGG12: per run and table the checks, mismatches and row differences; an errored table counts one mismatch more."""
    n = diffs.groupBy("run_id", "table_name").agg(F.count("*").alias("row_diffs"))
    checks = results.groupBy("run_id", "job_table_id").agg(F.count("*").alias("checks"), (F.count_if(~F.col("matched")) + F.max(F.col("error").isNotNull().cast("int"))).alias("mismatches"))
    rows = checks.join(tables.select("job_table_id", "src_table"), "job_table_id").join(n, [checks["run_id"] == n["run_id"], F.col("src_table") == n["table_name"]], "left")
    return rows.select(checks["run_id"], "src_table", "checks", F.col("mismatches").cast("bigint").alias("mismatches"), F.coalesce("row_diffs", F.lit(0)).alias("row_diffs"))


def latest(runs: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """SRT2: the last run of each group, without a sort."""
    return runs.groupBy(*by).agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns if c not in by]), order).alias("r")).select(*by, "r.*")


def recent(events: DataFrame, n: int = 15, order: str = "event_id") -> DataFrame:
    """SRT3."""
    return events.orderBy(F.desc(order)).limit(n)


def lag_view(watermark: DataFrame) -> DataFrame:
    """STR4: one row per job: lag by the source's clock; no pending change means no lag."""
    behind = F.when(F.col("pending") == 0, F.col("src_max_at")).otherwise(F.col("applied_at"))
    return watermark.select("job_id", lsn.with_staleness(lsn.lag_seconds(F.col("src_max_at"), behind), F.col("last_scan"), F.col("now")).alias("lag_seconds"))
