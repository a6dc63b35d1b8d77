"""Graph queries and temporal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ranking import ranked
from .filters_joins import TOKEN_LINKS_SQL, token_components
from .registry import query
from .views import edges, facts, nodes, table


@query("SELECT e.src, e.dst, e.type, s.node_type AS src_type, d.node_type AS dst_type FROM edges e LEFT JOIN nodes s ON s.node_id = e.src LEFT JOIN nodes d ON d.node_id = e.dst WHERE e.dst = 'nation:3'")
def grf_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into a node with the types of both ends."""
    n = nodes(spark, sf_dir)
    end = lambda name: n.select(F.col("node_id").alias(name), F.col("node_type").alias(f"{name}_type"))
    return edges(spark, sf_dir).where("dst = 'nation:3'").join(end("src"), "src", "left").join(end("dst"), "dst", "left").select("src", "dst", "type", "src_type", "dst_type")


@query("SELECT node_id, other, direction, type FROM (SELECT src AS node_id, dst AS other, 'out' AS direction, type FROM edges UNION ALL SELECT dst, src, 'in', type FROM edges) WHERE starts_with(node_id, 'supplier:')")
def grf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    both = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "type").union(e.select("dst", "src", F.lit("in"), "type"))
    return both.where(F.col("node_id").startswith("supplier:"))


@query("""WITH RECURSIVE walk AS (SELECT 'order:' || o_orderkey AS start, 'order:' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey % 100 = 0 UNION SELECT w.start, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
    SELECT w.start, e.src, e.dst, e.type, e.provenance, min(w.depth + 1)::BIGINT AS depth FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3 GROUP BY 1, 2, 3, 4, 5""")
def grf_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything downstream of the orders whose key is divisible by 100, three steps deep."""
    starts = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("order:"), "o_orderkey").alias("start"))
    walk = graph.lineage(edges(spark, sf_dir), starts.select("start", F.col("start").alias("node_id")), depth=3)
    return walk.withColumn("depth", F.col("depth").cast("long"))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges WHERE type IN ('part_of', 'located_in') UNION ALL SELECT dst, src FROM edges WHERE type IN ('part_of', 'located_in'))), walk AS (SELECT node_id AS start, node_id AS node, 0 AS depth FROM nodes WHERE node_type = 'region' UNION SELECT w.start, b.dst, w.depth + 1 FROM walk w JOIN b ON b.src = w.node WHERE w.depth < 2)
    SELECT start, node AS node_id, min(depth)::BIGINT AS distance FROM walk GROUP BY 1, 2""")
def grf_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two undirected steps of each region."""
    places = edges(spark, sf_dir).where("type in ('part_of', 'located_in')")
    starts = nodes(spark, sf_dir).where("node_type = 'region'").select(F.col("node_id").alias("start"), "node_id")
    return graph.neighbourhood(places, starts, depth=2).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH RECURSIVE {TOKEN_LINKS_SQL}, e AS (SELECT left_id AS a, right_id AS b FROM links UNION SELECT right_id, left_id FROM links), w AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.node AND w.label < e.b) SELECT node AS event_id, min(label) AS cluster FROM (SELECT node, label FROM w UNION ALL SELECT a, b FROM e) GROUP BY node""")
def agg_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of events: connected components of all links by two shared useful tokens."""
    return token_components(spark, sf_dir).select(F.col("node").alias("event_id"), F.col("label").alias("cluster"))


@query("""SELECT n.node_id, n.node_type, coalesce(d.degree, 0) AS degree, round(CASE WHEN contains(n.node_id, '1') THEN 1.0 ELSE 0.0 END + CASE WHEN n.node_type = 'supplier' THEN 0.25 ELSE 0 END + 0.05 * least(coalesce(d.degree, 0), 5), 6)::DOUBLE AS score
    FROM nodes n LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d ON d.node = n.node_id WHERE n.node_type IN ('supplier', 'nation', 'customer')""")
def grf_degree_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    degree = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes(spark, sf_dir).where("node_type in ('supplier', 'nation', 'customer')").join(degree, F.col("node_id") == F.col("node"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    score = F.when(F.contains("node_id", F.lit("1")), 1.0).otherwise(0.0) + F.when(F.col("node_type") == "supplier", 0.25).otherwise(0.0) + 0.05 * F.least("degree", F.lit(5))
    return n.select("node_id", "node_type", "degree", F.round(score, 6).alias("score"))


#: Edges and nodes that a task counts.
_TASK_ROWS = 1_000_000


@query("""SELECT 'dangling_src' AS issue, src AS ref, count(*) AS n FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE node_id NOT LIKE 'order:%7') GROUP BY 2 UNION ALL SELECT 'dangling_dst', dst, count(*) FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes WHERE node_id NOT LIKE 'part:%9') GROUP BY 2""")
def grf_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are not among the nodes, after some nodes have been taken out."""
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir).select("node_id")
    # By rows, for sorted ids pack so well that tasks dealt by their bytes would hold tens of millions.
    tasks = 1 + (e.count() + n.count()) // _TASK_ROWS

    def missing(end: str, lost: str) -> DataFrame:
        known = n.where(~F.col("node_id").like(lost)).select(F.col("node_id").alias("ref"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("known"))
        each = e.select(F.col(end).alias("ref"), F.lit(1).cast("long").alias("n"), F.lit(0).alias("known")).unionByName(known)
        counts = each.repartition(tasks, "ref").groupBy("ref").agg(F.sum("n").alias("n"), F.max("known").alias("known")).where("known = 0")
        return counts.select(F.lit(f"dangling_{end}").alias("issue"), "ref", "n")

    return missing("src", "order:%7").unionByName(missing("dst", "part:%9"))


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, CASE WHEN (SELECT count(*) FROM nodes) = 0 THEN 'empty' WHEN (SELECT count(*) FROM edges) = 0 THEN 'warning' ELSE 'ok' END AS status")
def grf_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_edges"))
    status = F.when(F.col("n_nodes") == 0, "empty").when(F.col("n_edges") == 0, "warning").otherwise("ok")
    return n.crossJoin(F.broadcast(e)).select("n_nodes", "n_edges", status.alias("status"))  # one row each


_AT = "TIMESTAMP '1996-06-01'"


@query(f"""SELECT fact_id, subject, CASE WHEN NOT (valid_from <= {_AT} AND (valid_to IS NULL OR {_AT} < valid_to)) THEN 'outside_interval' WHEN status IN ('superseded', 'invalidated', 'retracted') THEN 'non_current_status' WHEN status = 'stale' THEN 'stale_excluded' ELSE 'included' END AS outcome FROM facts""")
def fct_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as of a date, each with the first reason it is left out for."""
    at = F.to_timestamp(F.lit("1996-06-01 00:00:00"))
    held = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    outcome = F.when(~held, "outside_interval").when(F.col("status").isin("superseded", "invalidated", "retracted"), "non_current_status").when(F.col("status") == "stale", "stale_excluded").otherwise("included")
    return facts(spark, sf_dir).select("fact_id", "subject", outcome.alias("outcome"))


@query("""SELECT subject, fact_id, object, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS place, date_diff('day', valid_from, valid_to) AS days FROM facts""")
def fct_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ranked(facts(spark, sf_dir), by=[F.col("valid_from"), F.col("fact_id")], groups=["subject", "predicate"], name="place")
    return f.select("subject", "fact_id", "object", F.col("place").cast("long").alias("place"), F.datediff("valid_to", "valid_from").cast("long").alias("days"))


@query("""WITH i AS (SELECT 'interval_invalid' AS issue, 'error' AS severity, fact_id FROM facts WHERE valid_to IS NOT NULL AND valid_from > valid_to UNION ALL SELECT 'confidence_exceeds_source_cap', 'error', fact_id FROM facts WHERE confidence = 'operator_asserted' AND fact_id % 3 = 0
    UNION ALL SELECT 'stale_source', 'warning', fact_id FROM facts WHERE status = 'stale' UNION ALL SELECT 'unresolved_supersedes', 'error', fact_id FROM facts f WHERE fact_id % 19 = 0 AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.fact_id = f.fact_id - 3)) SELECT issue, severity, count(*) AS n, min(fact_id) AS first_id FROM i GROUP BY 1, 2""")
def fct_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    rule = lambda rows, issue, severity: rows.select(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), "fact_id")
    old = f.where("fact_id % 19 = 0").select("fact_id", (F.col("fact_id") - 3).alias("old"))
    gone = old.join(f.select(F.col("fact_id").alias("old")), "old", "left_anti")
    issues = (
        rule(f.where("valid_to is not null and valid_from > valid_to"), "interval_invalid", "error").unionByName(rule(f.where("confidence = 'operator_asserted' and fact_id % 3 = 0"), "confidence_exceeds_source_cap", "error"))
        .unionByName(rule(f.where("status = 'stale'"), "stale_source", "warning")).unionByName(rule(gone, "unresolved_supersedes", "error"))
    )
    return issues.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first_id"))


@query("""SELECT subject, bool_or(object = 'O') AND bool_or(object = 'F') AS conflict, count(*) AS n FROM facts WHERE status = 'active' GROUP BY subject""")
def fct_guard_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that two contrary rules apply to."""
    both = F.bool_or(F.col("object") == "O") & F.bool_or(F.col("object") == "F")
    return facts(spark, sf_dir).where("status = 'active'").groupBy("subject").agg(both.alias("conflict"), F.count(F.lit(1)).alias("n"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+) (is|are) ([a-z]+)\b')) AS m FROM documents), x AS (SELECT doc_id, lower(split_part(m, ' ', 1)) AS subject, split_part(m, ' ', 3) AS object FROM t)
    SELECT subject, object, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1, 2 HAVING count(*) >= 2""")
def fct_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple statements found in texts, with how often and where they stand."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+) (is|are) ([a-z]+)\b"), F.lit(0))).alias("m"))
    x = found.select("doc_id", F.lower(F.split("m", " ")[0]).alias("subject"), F.split("m", " ")[2].alias("object"))
    per_doc = x.groupBy("subject", "object", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("subject", "object").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 2")
