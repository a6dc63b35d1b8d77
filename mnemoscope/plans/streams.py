"""Windows, sessions, chunks and vectors over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, sinks
from ..streaming import events as stream
from .registry import query
from .views import NOW, now, table, turns, vectors


@query("SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def stm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows; the same plan runs on a stream."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    return stream.per_window(e, width="6 hours").select(F.unix_timestamp(F.col("window.start")).alias("start"), "type", "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, CAST(min(t) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end with an hour's pause."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return stream.sessions(e, gap="1 hour").select("user_id", F.unix_micros(F.col("session_window.start")).alias("start"), "n")


@query(f"SELECT event_id, type FROM turns WHERE type = 'conversation.user' AND ts < TIMESTAMP '{NOW}' - to_days(60) OR type = 'conversation.assistant' AND ts < TIMESTAMP '{NOW}' - to_days(90)")
def stm_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.expired(turns(spark, sf_dir), now()).select("event_id", "type")


@query()
def src_markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown chunks of at most 1,200 characters; tests check them against a second version."""
    return readers.markdown_chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", "heading_path", F.length("text").alias("chars"), "hash")


@query("SELECT label AS model, 64 AS dim, count(*) AS n, round(sum(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x * x), 'sum')), 4) AS squares FROM embeddings GROUP BY 1")
def snk_vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of unit vectors for an index, summed up by model and width."""
    v = sinks.normalised_vectors(vectors(spark, sf_dir))
    return v.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("norm") * F.col("norm")), 4).alias("squares"))


@query("SELECT event_id, bytes, CASE WHEN bytes > 2000 THEN 'too_large' WHEN sum(CASE WHEN bytes <= 2000 THEN bytes ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn, event_id ROWS UNBOUNDED PRECEDING) > 3000 THEN 'over_quota' ELSE 'stored' END AS admitted FROM (SELECT event_id, session_id, turn, strlen(summary)::BIGINT AS bytes FROM turns)")
def snk_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).select("event_id", "session_id", F.col("turn").alias("at"), F.col("summary").alias("body"))
    return sinks.artifacts(t, max_bytes=2000, session_quota=3000).select("event_id", "bytes", "admitted")
