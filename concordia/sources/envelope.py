"""Change events from envelopes (SRC8, SRC9).

An envelope is one JSON record: kind (CHANGE, HEARTBEAT, SCHEMA_CHANGE, SCHEMA_SNAPSHOT),
stream_lsn, and for changes schema, table, op, commit_lsn, change_lsn, event_serial_no,
commit_at and the images before and after.  A value in an image is a string, null,
``{"b64": ...}`` for text that JSON cannot carry, or ``{"unavailable": true}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import lsn

ENVELOPE = "kind string, stream_lsn string, schema string, table string, op string, commit_lsn string, change_lsn string, event_serial_no long, commit_at timestamp_ntz, before map<string,string>, after map<string,string>"
IMAGE = "map<string,struct<v:string,unavailable:boolean>>"


def image(raw: Column) -> Column:
    """An image's values decoded."""
    marked = F.from_json
    form = "struct<b64:string,unavailable:boolean>"

    def one(_: Column, v: Column) -> Column:
        x = F.when(v.startswith('{"b64":') | v.startswith('{"unavailable":'), marked(v, form))
        text = F.when(x["b64"].isNotNull(), F.unbase64(x["b64"]).cast("string")).when(F.coalesce(x["unavailable"], F.lit(False)), None).otherwise(v)
        return F.struct(text.alias("v"), F.coalesce(x["unavailable"], F.lit(False)).alias("unavailable"))

    return F.transform_values(raw, one)


def parsed(records: DataFrame) -> DataFrame:
    """Envelopes as events: positions normalised, images decoded, ``table_name`` as schema.table."""
    return records.select(
        "kind", lsn.normal(F.col("stream_lsn")).alias("stream_lsn"), lsn.normal(F.col("commit_lsn")).alias("commit_lsn"), lsn.normal(F.col("change_lsn")).alias("change_lsn"),
        "event_serial_no", "op", F.concat_ws(".", "schema", "table").alias("table_name"), image(F.col("before")).alias("before"), image(F.col("after")).alias("after"), F.col("commit_at").alias("src_commit_at"),
    )


def invalid(events: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Changes that cannot be taken: without a position, of an unknown kind or operation, of a table or with columns outside the plan."""
    known = F.create_map(*[x for t, cs in columns.items() for x in (F.lit(t.lower()), F.array(*[F.lit(c) for c in cs]))]) if columns else F.create_map().cast("map<string,array<string>>")
    want = F.element_at(known, F.lower("table_name"))
    change = F.col("kind") == "CHANGE"
    missing = F.exists(want, lambda c: ~F.array_contains(F.map_keys("after"), c))
    reason = (
        F.when(~F.coalesce(F.col("kind").isin("CHANGE", "HEARTBEAT", "SCHEMA_CHANGE", "SCHEMA_SNAPSHOT"), F.lit(False)), "unknown kind")
        .when(F.col("kind") == "SCHEMA_CHANGE", "the source's schema changed")
        .when(change & (F.col("commit_lsn").isNull() | F.col("change_lsn").isNull() | F.col("event_serial_no").isNull()), "no position")
        .when(change & ~F.coalesce(F.col("op").isin("c", "u", "d"), F.lit(False)), "unknown op")
        .when(change & want.isNull(), "not in the plan")
        .when(change & (F.col("op") != "d") & missing, "a planned column is absent")
    )
    return events.withColumn("reason", reason).where("reason IS NOT NULL")


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """SRC8: new envelope files of a folder as a stream."""
    return parsed(spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(folder))


def batch(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.schema(ENVELOPE).json(folder))
