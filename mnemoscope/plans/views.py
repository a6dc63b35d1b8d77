"""Domain tables over the given Parquet tables, in Spark and, for checking, in DuckDB SQL.

``observations`` are documents with labels, ``turns`` are conversations,
``nodes`` and ``edges`` come from the keys of the business tables, ``facts``
from the history of orders and ``receipts`` from order lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("fact", "preference", "decision", "entity", "event", "plan", "learning", "note")
STATES = ("active", "captured", "categorized", "consolidated", "stale", "soft-archived")
TRUST = ("trusted", "untrusted", "quarantined", "unknown")
#: "Now" of every time-dependent query; operators take it as an argument.
NOW = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def days_before_now(days: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now()) - days * 86400)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, kind, summary, lang, scope, label, score, trust, state, used_count, last_used, quarantined."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("summary"), "lang", F.col("source").alias("scope"))
    i = F.col("id")
    return docs.join(labels, "id", "left").select(
        "id", days_before_now(i % 400).alias("ts"), pick(KINDS, i).alias("kind"), "summary", "lang", "scope",
        F.when(F.col("quality") == 1, "must_remember").when(F.col("quality") == 0, "ignore").otherwise("unknown").alias("label"),
        F.when(F.col("quality").isNotNull(), (i % 101) / 100.0).alias("score"),
        pick(TRUST, i).alias("trust"), pick(STATES, i).alias("state"), (i % 7).alias("used_count"),
        F.when(i % 3 == 0, days_before_now(i % 40)).alias("last_used"), (F.coalesce("toxic", F.lit(0)) == 1).alias("quarantined"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("model"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodic events: session, position, type, summary, scope."""
    role = F.col("role")
    kind = F.when(role == "user", "conversation.user").when(role == "assistant", "conversation.assistant").otherwise("ops.observation")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("session_id"), "turn", kind.alias("type"), F.col("text").alias("summary"),
        F.concat(F.lit("scope"), (F.col("conv_id") % 5).cast("string")).alias("scope"), days_before_now(F.col("conv_id") % 120).alias("ts"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes: node_id, node_type, tag."""
    t = lambda name, key, kind, tag: table(spark, sf_dir, name).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), tag.cast("string").alias("tag"))
    return (
        t("region", "r_regionkey", "region", F.col("r_name")).unionByName(t("nation", "n_nationkey", "nation", F.col("n_name")))
        .unionByName(t("customer", "c_custkey", "customer", F.col("c_mktsegment"))).unionByName(t("supplier", "s_suppkey", "supplier", F.lit("supply")))
        .unionByName(t("part", "p_partkey", "part", F.col("p_brand"))).unionByName(t("orders", "o_orderkey", "order", F.col("o_orderstatus")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges: src, dst, type, provenance (a file and line)."""
    def t(name: str, kind: str, key: str, to: str, to_key: str, edge: str) -> DataFrame:
        ref = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
        return table(spark, sf_dir, name).select(ref(kind, key).alias("src"), ref(to, to_key).alias("dst"), F.lit(edge).alias("type"), F.concat(F.lit(f"{name}.md#L"), F.col(key).cast("string")).alias("provenance"))

    return (
        t("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of").unionByName(t("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in"))
        .unionByName(t("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in")).unionByName(t("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by"))
        .unionByName(t("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains")).unionByName(t("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "shipped_by"))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal facts: fact_id, subject, predicate, object, valid_from, valid_to (null: open), status, confidence."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    after = F.lead(start).over(Window.partitionBy("o_custkey").orderBy(start, "o_orderkey"))
    late = F.timestamp_seconds(F.unix_timestamp(start) + 400 * 86400)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("fact_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        start.alias("valid_from"), F.when(k % 5 == 0, late).otherwise(after).alias("valid_to"),
        F.when(k % 11 == 0, "retracted").when(k % 13 == 0, "stale").when(k % 17 == 0, "superseded").otherwise("active").alias("status"),
        pick(("low", "source_capped", "corroborated", "operator_asserted"), k).alias("confidence"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection receipts: receipt_id, ref, ts; one row for each selected reference."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), F.col("l_partkey").alias("ref"), F.col("l_shipdate").cast("timestamp").alias("ts"))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

#: The same tables for DuckDB, as common table expressions.
VIEWS_SQL = {
    "observations": f"""observations AS (SELECT d.doc_id AS id, TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 400 AS INTEGER)) AS ts, {_list(KINDS)}[d.doc_id % 8 + 1] AS kind,
        d.text AS summary, d.lang AS lang, d.source AS scope, CASE l.quality WHEN 1 THEN 'must_remember' WHEN 0 THEN 'ignore' ELSE 'unknown' END AS label,
        CASE WHEN l.quality IS NOT NULL THEN (d.doc_id % 101) / 100.0::DOUBLE END AS score, {_list(TRUST)}[d.doc_id % 4 + 1] AS trust, {_list(STATES)}[d.doc_id % 6 + 1] AS state,
        d.doc_id % 7 AS used_count, CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '{NOW}' - to_days(CAST(d.doc_id % 40 AS INTEGER)) END AS last_used, coalesce(l.toxic, 0) = 1 AS quarantined
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "vectors": "vectors AS (SELECT vec_id AS id, embedding AS vector, label AS model FROM embeddings)",
    "turns": f"""turns AS (SELECT conv_id * 1000 + turn AS event_id, conv_id AS session_id, turn, CASE role WHEN 'user' THEN 'conversation.user' WHEN 'assistant' THEN 'conversation.assistant' ELSE 'ops.observation' END AS type,
        text AS summary, 'scope' || (conv_id % 5) AS scope, TIMESTAMP '{NOW}' - to_days(CAST(conv_id % 120 AS INTEGER)) AS ts FROM conversations)""",
    "nodes": """nodes AS (SELECT 'region:' || r_regionkey AS node_id, 'region' AS node_type, r_name AS tag FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_mktsegment FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'supply' FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, 'part', p_brand FROM part UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus FROM orders)""",
    "edges": """edges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part_of' AS type, 'nation.md#L' || n_nationkey AS provenance FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'customer.md#L' || c_custkey FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'supplier.md#L' || s_suppkey FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'orders.md#L' || o_orderkey FROM orders
        UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', 'lineitem.md#L' || l_orderkey FROM lineitem
        UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'shipped_by', 'lineitem.md#L' || l_orderkey FROM lineitem)""",
    "facts": """facts AS (SELECT o_orderkey AS fact_id, 'customer:' || o_custkey AS subject, 'status' AS predicate, o_orderstatus AS object, CAST(o_orderdate AS TIMESTAMP) AS valid_from,
        CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_days(400) ELSE lead(CAST(o_orderdate AS TIMESTAMP)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS valid_to,
        CASE WHEN o_orderkey % 11 = 0 THEN 'retracted' WHEN o_orderkey % 13 = 0 THEN 'stale' WHEN o_orderkey % 17 = 0 THEN 'superseded' ELSE 'active' END AS status,
        ['low', 'source_capped', 'corroborated', 'operator_asserted'][o_orderkey % 4 + 1] AS confidence FROM orders)""",
    "receipts": "receipts AS (SELECT l_orderkey AS receipt_id, l_partkey AS ref, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)",
}


def with_views(sql: str) -> str:
    """``sql`` with the views that it names in front; it may begin with further expressions after WITH."""
    used = [v for k, v in VIEWS_SQL.items() if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    rest = re.sub(r"^\s*WITH\s+(?!RECURSIVE)", ", ", sql)
    head = "WITH RECURSIVE " if re.match(r"\s*WITH\s+RECURSIVE", sql) else "WITH "
    rest = re.sub(r"^\s*WITH\s+RECURSIVE\s+", ", ", rest)
    return head + ", ".join(used) + " " + rest
