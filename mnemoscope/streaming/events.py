"""Episodic events as a stream: parse, check, redact, drop repeats, expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import looks_secret, redact, scope_token

#: Types of events, and the days that they are kept (None: for ever, as are types that are not listed). Fixed values.
TYPES = (
    "conversation.user",
    "conversation.assistant",
    "tool.call",
    "tool.result",
    "ops.decision",
    "ops.alert",
    "ops.observation",
)
RETENTION_DAYS = {
    "conversation.user": 60,
    "conversation.assistant": 90,
    "tool.call": 30,
    "tool.result": 30,
    "ops.decision": None,
    "ops.alert": 90,
}


def tail(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """New lines of a folder of JSON-lines files; the checkpoint remembers what was read."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def parsed(lines: DataFrame) -> DataFrame:
    """Events of ``lines`` (value), each with an error for what can't be used; an event without an id gets the digest of its line."""
    v = F.try_parse_json("value")
    get = lambda n, kind="string": F.try_variant_get(v, f"$.{n}", kind)
    summary = F.coalesce(get("summary"), F.lit(""))
    tag = r"^\s*\[\s*(?i:scope)\s*:\s*([^\]]+)\]\s*"
    ts = get("ts_ms", "bigint")
    error = F.when(F.trim("value") == "", "blank").when(v.isNull(), "invalid_json").when(ts.isNull() | (ts <= 0) | ~F.coalesce(get("type").isin(*TYPES), F.lit(False)), "invalid_event")
    return lines.select(
        F.coalesce(get("event_id"), F.sha2(F.col("value").cast("binary"), 256)).alias("event_id"), F.timestamp_millis(ts).alias("ts"), get("type").alias("type"), get("session_id").alias("session_id"),
        F.coalesce(scope_token(get("scope")), scope_token(F.nullif(F.regexp_extract(summary, tag, 1), F.lit("")))).alias("scope"), F.regexp_replace(summary, tag, "").alias("summary"), error.alias("error"),
    )


def redacted(events: DataFrame) -> DataFrame:
    """Secrets blank the whole summary; addresses and numbers go one by one."""
    secret = looks_secret(F.col("summary"))
    return events.withColumn("redacted", secret | (F.col("summary") != redact(F.col("summary")))).withColumn("summary", F.when(secret, "[REDACTED]").otherwise(redact(F.col("summary"))))


def distinct_events(events: DataFrame, *, late: str = "7 days") -> DataFrame:
    """One row for each event_id, forgotten after ``late`` so that state stays bounded."""
    return events.where("error is null").drop("error").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, *, late: str = "7 days") -> StreamingQuery:
    """Take in all new files once, append events as Parquet by type, and stop; run it again for more."""
    events = distinct_events(redacted(parsed(tail(spark, folder))), late=late)
    return events.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).partitionBy("type").trigger(availableNow=True).start()


def per_window(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a user without a longer pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def expired(events: DataFrame, now) -> DataFrame:
    """Events past their retention."""
    days = F.create_map(*(F.lit(x) for kv in RETENTION_DAYS.items() if kv[1] is not None for x in kv))[F.col("type")]
    return events.where(F.coalesce(F.unix_timestamp("ts") < F.unix_timestamp(now) - days * 86400, F.lit(False)))
