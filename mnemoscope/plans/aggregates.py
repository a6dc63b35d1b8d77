"""Counts, distributions and evaluations over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators.graph import ensure_checkpoint_dir
from .registry import query
from .views import NOW, STATES, edges, nodes, now, observations, receipts, table, turns, vectors

_FINGERPRINT = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z一-鿿]+', ' ', 'g'))"


@query("SELECT coalesce(nullif(trim(kind), ''), '<empty>') AS kind, count(*) AS n FROM observations GROUP BY 1")
def agg_count_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("<empty>"))
    return observations(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s.state, count(o.id) AS n FROM (SELECT unnest([{', '.join(repr(s) for s in STATES)}]) AS state) s LEFT JOIN observations o ON o.state = s.state AND o.kind <> 'event' GROUP BY 1")
def agg_state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state has a row, zero if nothing is in it."""
    states = spark.createDataFrame([(s,) for s in STATES], "state string")
    counts = observations(spark, sf_dir).where("kind <> 'event'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'observations' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages")
def agg_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, t: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count("observations", "documents").unionByName(count("embeddings", "embeddings")).unionByName(count("turns", "conversations")).unionByName(count("pages", "pages"))


@query("SELECT model, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, model) AS place FROM vectors GROUP BY model")
def agg_models_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = vectors(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "model")))


@query("""SELECT source, sum(n)::BIGINT AS n_edges, count(*) AS n_types, string_agg(type || '=' || n, ',' ORDER BY type) AS by_type FROM (
    SELECT trim(CASE WHEN instr(provenance, '#') > 0 THEN substr(provenance, 1, instr(provenance, '#') - 1) ELSE provenance END) AS source, type, count(*) AS n FROM edges GROUP BY 1, 2)
    WHERE source <> '' GROUP BY source HAVING sum(n) >= 5""")
def agg_provenance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the file they come from, with their types, from five edges on."""
    source = F.trim(F.substring_index("provenance", "#", 1))
    by_type = edges(spark, sf_dir).groupBy(source.alias("source"), "type").agg(F.count(F.lit(1)).alias("n")).where("source <> ''")
    entry = F.struct("type", F.concat_ws("=", "type", F.col("n").cast("string")).alias("t"))
    groups = by_type.groupBy("source").agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_types"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), ",").alias("by_type"))
    return groups.where("n_edges >= 5")


@query("""SELECT kind, count(*) AS n, sum(line_start)::BIGINT AS lines FROM (SELECT CASE WHEN regexp_matches(provenance, '^[^#]+#L\\d+(-L?\\d+)?$') THEN 'file_line' ELSE 'opaque' END AS kind,
    TRY_CAST(regexp_extract(provenance, '#L(\\d+)', 1) AS BIGINT) AS line_start FROM edges) GROUP BY 1""")
def agg_provenance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = text.provenance(F.col("provenance"))
    return edges(spark, sf_dir).select(ref.alias("r")).groupBy("r.kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r.line_start").cast("long")).alias("lines"))


@query("SELECT 'node' AS part, node_type AS type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2")
def agg_graph_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).groupBy(F.lit("node").alias("part"), F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(edges(spark, sf_dir).groupBy(F.lit("edge").alias("part"), "type").agg(F.count(F.lit(1)).alias("n")))


@query(f"""SELECT scope, count(*) AS n, min(length(summary))::BIGINT AS min_chars, max(length(summary))::BIGINT AS max_chars, round(avg(length(summary)), 4) AS avg_chars, median(length(summary))::DOUBLE AS median_chars,
    min(date_diff('day', ts, TIMESTAMP '{NOW}'))::BIGINT AS min_age, max(date_diff('day', ts, TIMESTAMP '{NOW}'))::BIGINT AS max_age FROM observations GROUP BY scope""")
def agg_memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, age = F.length("summary").cast("long"), F.datediff(now(), F.col("ts")).cast("long")
    return observations(spark, sf_dir).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.min(chars).alias("min_chars"), F.max(chars).alias("max_chars"), F.round(F.avg(chars), 4).alias("avg_chars"), F.median(chars).alias("median_chars"),
        F.min(age).alias("min_age"), F.max(age).alias("max_age"),
    )


@query(f"""SELECT * FROM (SELECT id, scope, md5(fp) AS fingerprint, count(*) OVER w AS n, min(id) OVER w AS canonical, max(id) OVER w AS latest
    FROM (SELECT id, scope, {_FINGERPRINT.format('summary')} AS fp FROM observations) WHERE length(fp) >= 8 WINDOW w AS (PARTITION BY scope, fp)) WHERE n >= 2""")
def agg_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one scope that are equal but for punctuation and case: a row for each member, with its cluster's size, canonical (least) and latest id."""
    ensure_checkpoint_dir(spark)
    # Texts are read once: digests are written, and both sides of the join read these. No group is gathered in one row.
    o = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), text.fingerprint(F.col("text")).alias("fp"))
    o = o.select("id", "scope", F.when(F.length("fp") >= 8, F.md5(F.col("fp").cast("binary"))).alias("fingerprint")).checkpoint().where("fingerprint is not null")
    clusters = o.groupBy("scope", "fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("canonical"), F.max("id").alias("latest")).where("n >= 2")
    return o.join(clusters, ["scope", "fingerprint"]).select("id", "scope", "fingerprint", "n", "canonical", "latest")


@query("""SELECT user_id, event_type, count(*) AS misses, max(event_id) AS last_event FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def agg_repeated_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalls with no result, by asker and question, from two on; events stand for recalls, k for the number of results."""
    e = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").try_cast("long") == 0)
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("misses"), F.max("event_id").alias("last_event")).where("misses >= 2")


@query("""WITH m AS (SELECT count(*) AS n, count(*) FILTER (score IS NULL) AS missing, count(*) FILTER (score IS NOT NULL AND label <> CASE WHEN score >= 0.8 THEN 'must_remember' WHEN score >= 0.5 THEN 'nice_to_have' ELSE 'ignore' END) AS mismatch,
    count(*) FILTER (label = 'ignore' AND regexp_matches(summary, '(?i)\\b(password|passphrase)\\b|\\bapi[ _-]*key\\b|\\b(access|refresh)[ _-]*token\\b')) AS risky FROM observations),
    p(profile, c1, r1, c2, r2, c3, r3) AS (VALUES ('strict', 1.0, 2.0, 0.0, 0.0, 0.0, 0.0), ('balanced', 3.0, 5.0, 1.0, 2.0, 0.0, 0.0), ('lenient', 5.0, 10.0, 2.0, 5.0, 1.0, 1.0))
    SELECT profile, n AS rows_scanned, mismatch, missing, risky, round(mismatch * 100.0 / greatest(n, 1), 2)::DOUBLE AS mismatch_pct, round(missing * 100.0 / greatest(n, 1), 2)::DOUBLE AS missing_pct,
    CASE WHEN mismatch <= c1 AND round(mismatch * 100.0 / greatest(n, 1), 2) <= r1 AND missing <= c2 AND round(missing * 100.0 / greatest(n, 1), 2) <= r2 AND risky <= c3 AND round(risky * 100.0 / greatest(n, 1), 2) <= r3 THEN 'accept' ELSE 'hold' END AS status
    FROM m CROSS JOIN p""")
def agg_importance_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label drift against three threshold profiles; counts are one row, profiles three."""
    o, score = observations(spark, sf_dir), F.col("score")
    risky = F.col("summary").rlike(r"(?i)\b(password|passphrase)\b|\bapi[ _-]*key\b|\b(access|refresh)[ _-]*token\b")
    m = o.agg(F.count(F.lit(1)).alias("rows_scanned"), F.count_if(score.isNotNull() & (F.col("label") != scoring.label_of(score))).alias("mismatch"), F.count_if(score.isNull()).alias("missing"), F.count_if((F.col("label") == "ignore") & risky).alias("risky"))
    profiles = spark.createDataFrame([("strict", 1.0, 2.0, 0.0, 0.0, 0.0, 0.0), ("balanced", 3.0, 5.0, 1.0, 2.0, 0.0, 0.0), ("lenient", 5.0, 10.0, 2.0, 5.0, 1.0, 1.0)], "profile string, c1 double, r1 double, c2 double, r2 double, c3 double, r3 double")
    rate = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.col("rows_scanned"), F.lit(1)), 2)
    ok = (F.col("mismatch") <= F.col("c1")) & (rate("mismatch") <= F.col("r1")) & (F.col("missing") <= F.col("c2")) & (rate("missing") <= F.col("r2")) & (F.col("risky") <= F.col("c3")) & (rate("risky") <= F.col("r3"))
    return profiles.crossJoin(F.broadcast(m)).select("profile", "rows_scanned", "mismatch", "missing", "risky", rate("mismatch").alias("mismatch_pct"), rate("missing").alias("missing_pct"), F.when(ok, "accept").otherwise("hold").alias("status"))


@query("SELECT ref, count(*) AS uses, count(DISTINCT receipt_id) AS n_receipts, CAST(epoch(max(ts)) AS BIGINT) AS last_used FROM receipts GROUP BY ref")
def agg_recent_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = receipts(spark, sf_dir).groupBy("ref", "receipt_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    return each.groupBy("ref").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("n_receipts"), F.unix_timestamp(F.max("ts")).alias("last_used"))


@query(f"""SELECT type, count(*) AS n, count(*) FILTER (days IS NOT NULL AND ts < TIMESTAMP '{NOW}' - to_days(days)) AS expired FROM (SELECT t.type, t.ts, CASE t.type WHEN 'conversation.user' THEN 60 WHEN 'conversation.assistant' THEN 90 END::INTEGER AS days FROM turns t) GROUP BY type""")
def agg_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events past the retention of their type; types without one never expire."""
    days = F.when(F.col("type") == "conversation.user", 60).when(F.col("type") == "conversation.assistant", 90)
    expired = F.col("ts") < F.timestamp_seconds(F.unix_timestamp(now()) - days * 86400)
    return turns(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(expired, F.lit(False))).alias("expired"))


@query("""SELECT lang, CASE WHEN c + a > 0 AND c * 1.0 / (c + a) > 0.7 THEN 'zh' WHEN c + a > 0 AND c * 1.0 / (c + a) > 0.3 AND a > 0 THEN 'mixed' ELSE 'en' END AS detected, count(*) AS n
    FROM (SELECT lang, len(regexp_extract_all(summary, '[㐀-鿿]')) AS c, len(regexp_extract_all(summary, '[A-Za-z0-9]')) AS a FROM observations) GROUP BY 1, 2""")
def agg_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("lang", text.language(F.col("summary")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH k AS (SELECT kind, CASE WHEN kind NOT IN ('', 'note', 'tool') THEN kind WHEN regexp_matches(lower(summary), '\\b(error|failed|failure|bug|broken|issue|problem)\\b') AND regexp_matches(lower(summary), '\\b(fix(ed)?|solution|resolved?|workaround|repair(ed)?)\\b') THEN 'learning'
    WHEN regexp_matches(lower(summary), '\\b(decided|decision|we chose|we choose|chosen)\\b') THEN 'decision' WHEN regexp_matches(lower(summary), '\\b(prefer(red|s)?|preference|always use|i like)\\b') THEN 'preference'
    WHEN regexp_matches(lower(summary), '\\b(plan(ned)? to|planning to|intend to|will|todo)\\b') THEN 'plan' ELSE 'note' END AS ruled FROM observations)
    SELECT kind AS name, 'before' AS step, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT ruled, 'after', count(*) FROM k GROUP BY 1""")
def agg_kind_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select("kind", text.kind_of(F.col("summary"), F.col("kind")).alias("ruled"))
    step = lambda c, s: o.groupBy(F.col(c).alias("name"), F.lit(s).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return step("kind", "before").unionByName(step("ruled", "after"))


@query("""SELECT label AS expected, count(*) FILTER (p = 'must_remember') AS must_remember, count(*) FILTER (p = 'nice_to_have') AS nice_to_have, count(*) FILTER (p = 'ignore') AS ignore, round(count(*) FILTER (p = label) * 1.0 / count(*), 6)::DOUBLE AS agreement
    FROM (SELECT label, CASE WHEN score >= 0.8 THEN 'must_remember' WHEN score >= 0.5 THEN 'nice_to_have' ELSE 'ignore' END AS p FROM observations WHERE score IS NOT NULL) GROUP BY label""")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).where("score is not null").select(F.col("label").alias("expected"), scoring.label_of(F.col("score")).alias("p"))
    count = lambda p: F.count_if(F.col("p") == p).alias(p)
    return o.groupBy("expected").agg(count("must_remember"), count("nice_to_have"), count("ignore"), F.round(F.count_if(F.col("p") == F.col("expected")) / F.count(F.lit(1)), 6).alias("agreement"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearly interpolated percentiles."""
    p = lambda q: F.round(F.percentile("value", q), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


@query("SELECT scope, count(v.id) AS embedded, count(o.id) AS n FROM observations o LEFT JOIN vectors v ON v.id = o.id GROUP BY scope")
def agg_embedded_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = vectors(spark, sf_dir).select(F.col("id").alias("v"))
    o = observations(spark, sf_dir).select("id", "scope")
    return o.join(ids, F.col("id") == F.col("v"), "left").groupBy("scope").agg(F.count("v").alias("embedded"), F.count("id").alias("n"))


@query("""SELECT CASE WHEN value <= 10 THEN 'le_10' WHEN value <= 100 THEN 'le_100' WHEN value <= 1000 THEN 'le_1000' ELSE 'gt_1000' END AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def agg_latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    bucket = F.when(v <= 10, "le_10").when(v <= 100, "le_100").when(v <= 1000, "le_1000").otherwise("gt_1000")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""SELECT scope, count(*) AS n, count(*) FILTER (label <> 'unknown') AS labelled, count(DISTINCT kind) AS kinds, max(id) AS newest, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM observations GROUP BY scope""")
def cli_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != "unknown").alias("labelled"), F.count_distinct("kind").alias("kinds"), F.max("id").alias("newest"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs")
    )


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN quarantined THEN 'reject' WHEN label = 'must_remember' AND trust = 'trusted' THEN 'approve' WHEN label = 'ignore' THEN 'archive' ELSE 'review' END AS action FROM observations) GROUP BY 1""")
def agg_steward_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("quarantined"), "reject").when((F.col("label") == "must_remember") & (F.col("trust") == "trusted"), "approve").when(F.col("label") == "ignore", "archive").otherwise("review")
    return observations(spark, sf_dir).groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))
