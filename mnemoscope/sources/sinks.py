"""Exports, artifacts and index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import looked_up


def export_jsonl(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines, range-partitioned by id so that files are in order; the manifest is returned."""
    rows.repartitionByRange("id").sortWithinPartitions("id").write.mode("errorifexists").json(path)
    return manifest(rows)


def manifest(rows: DataFrame) -> DataFrame:
    """(kind, n, first_id, last_id, digest): the digest sums row hashes, so it doesn't depend on order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(row.cast("decimal(20,0)")).cast("string").alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether a read-back has the manifest of what was written."""
    return manifest(a).exceptAll(manifest(b)).isEmpty() and manifest(b).exceptAll(manifest(a)).isEmpty()


def artifacts(blobs: DataFrame, *, max_bytes: int, session_quota: int) -> DataFrame:
    """Content-addressed blobs (session_id, at, body): sha256 and admission by size, then by the session's running total."""
    sized = blobs.withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    upto = F.sum(F.when(F.col("bytes") <= max_bytes, F.col("bytes")).otherwise(0)).over(Window.partitionBy("session_id").orderBy("at", "sha256").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("upto", upto).withColumn("admitted", F.when(F.col("bytes") > max_bytes, "too_large").when(F.col("upto") > session_quota, "over_quota").otherwise("stored"))


#: Ranks of trust, fixed values.
TRUST_RANK = {"quarantined": 0, "unknown": 0, "untrusted": 1, "trusted": 2}


def retrieval(requests: DataFrame, store: DataFrame) -> DataFrame:
    """What each request (sha256, scope, trust, at) gets from the store (sha256, scope, trust, expires): the first of missing, expired, scope, trust and returned that holds."""
    s = store.select(F.col("sha256").alias("k"), F.col("scope").alias("own_scope"), F.col("trust").alias("own_trust"), "expires")
    outcome = (
        F.when(F.col("k").isNull(), "missing").when(F.col("expires") < F.col("at"), "expired").when(~(F.col("own_scope").isin("global", "public") | (F.col("own_scope") == F.col("scope"))), "scope_denied")
        .when(looked_up(TRUST_RANK, F.col("trust"), 0) < looked_up(TRUST_RANK, F.col("own_trust"), 0), "trust_denied").otherwise("returned")
    )
    return requests.join(s, F.col("sha256") == F.col("k"), "left").select(*requests.columns, outcome.alias("outcome"))


def normalised_vectors(vectors: DataFrame) -> DataFrame:
    """(model, dim, id, vector, norm) with unit vectors, for searches by dot product alone; write it partitioned by model and dim."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("model", F.size("vector").alias("dim"), "id", norm.alias("norm"), "vector").withColumn("vector", F.transform("vector", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)))


def index_status(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """(model, status) of an index against its source: fresh, stale, missing or orphaned, by row count and largest id."""
    of = lambda df, n, m: df.groupBy("model").agg(F.count(F.lit(1)).alias(n), F.max("id").alias(m))
    joined = of(vectors, "n", "top").join(of(index, "index_n", "index_top"), "model", "full")
    status = F.when(F.col("index_n").isNull(), "missing").when(F.col("n").isNull(), "orphaned").when((F.col("n") == F.col("index_n")) & (F.col("top") == F.col("index_top")), "fresh").otherwise("stale")
    return joined.select("model", status.alias("status"))
