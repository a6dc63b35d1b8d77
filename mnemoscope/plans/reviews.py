"""Hygiene reviews: what is stale, doubled, bloated, unconnected or drifting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .registry import query
from .views import NOW, now, observations, receipts, table, turns

_TOKENS = r"list_filter(list_distinct(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{{3,}}|[一-鿿]{{2,}}')), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], x))"
_AGE = f"date_diff('day', ts, TIMESTAMP '{NOW}')"


@query(f"""SELECT o.id, {_AGE}::BIGINT AS age_days, o.label FROM observations o LEFT JOIN (SELECT DISTINCT ref FROM receipts WHERE ts >= TIMESTAMP '2001-06-01') r ON r.ref = o.id WHERE {_AGE} >= 60 AND o.label <> 'must_remember' AND r.ref IS NULL""")
def rev_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows that aren't must-remember and that no recent selection used."""
    age = F.datediff(now(), F.col("ts"))
    used = receipts(spark, sf_dir).where(F.col("ts") >= F.to_timestamp(F.lit("2001-06-01"))).select("ref").distinct()
    o = observations(spark, sf_dir).where((age >= 60) & (F.col("label") != "must_remember"))
    return o.join(used, F.col("id") == F.col("ref"), "left_anti").select("id", age.cast("long").alias("age_days"), "label")


@query(f"SELECT id, {_AGE}::BIGINT AS age_days FROM observations WHERE {_AGE} >= 120 AND label IN ('ignore', 'nice_to_have') AND used_count <= 1 AND state <> 'soft-archived'")
def rev_archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(now(), F.col("ts"))
    low = F.col("label").isin("ignore", "nice_to_have") & (F.col("used_count") <= 1) & (F.col("state") != "soft-archived")
    return observations(spark, sf_dir).where((age >= 120) & low).select("id", age.cast("long").alias("age_days"))


@query("SELECT id, length(summary)::BIGINT AS chars, strlen(summary)::BIGINT AS bytes FROM observations WHERE length(summary) >= 2400 OR strlen(summary) >= 4096")
def rev_bloat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars, size = F.length("summary").cast("long"), F.octet_length("summary").cast("long")
    return observations(spark, sf_dir).where((chars >= 2400) | (size >= 4096)).select("id", chars.alias("chars"), size.alias("bytes"))


@query(f"""WITH t AS (SELECT event_id, unnest({_TOKENS.format('summary')}) AS token FROM turns), n AS (SELECT greatest(2, floor(count(*) * 0.20)) AS top FROM turns),
    df AS (SELECT token, count(*) AS df FROM t GROUP BY 1), e AS (SELECT event_id, count(*) AS tokens, count(*) FILTER (df <= top) AS useful, count(*) FILTER (df BETWEEN 2 AND top) AS met
    FROM t JOIN df USING (token) CROSS JOIN n GROUP BY 1) SELECT event_id, tokens AS token_count FROM e WHERE tokens >= 2 AND useful >= 2 AND met = 0""")
def rev_weakly_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two useful tokens (in a fifth of all events at most) or more, none of which another event has.

    No pair is ever made: that a token's count is above 1 tells that another event has it.
    """
    u = turns(spark, sf_dir)
    t = u.select("event_id", F.explode(text.token_set(F.col("summary"))).alias("token"))
    top = u.agg(F.greatest(F.lit(2), F.floor(F.count(F.lit(1)) * 0.20)).alias("top"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(top))  # one row
    useful, met = F.col("df") <= F.col("top"), (F.col("df") >= 2) & (F.col("df") <= F.col("top"))
    each = t.join(df, "token").groupBy("event_id").agg(F.count(F.lit(1)).alias("token_count"), F.count_if(useful).alias("useful"), F.count_if(met).alias("met"))
    return each.where("token_count >= 2 and useful >= 2 and met = 0").select("event_id", "token_count")


@query(f"""SELECT id, priority, unused_days, CASE priority WHEN 'P1' THEN 90 ELSE 30 END::BIGINT AS threshold FROM (SELECT id, state, CASE WHEN id % 25 = 0 THEN 'P0' WHEN kind IN ('preference', 'decision', 'fact', 'learning', 'plan', 'entity') THEN 'P1' ELSE 'P2' END AS priority,
    greatest(0, date_diff('second', coalesce(last_used, ts), TIMESTAMP '{NOW}') // 86400)::BIGINT AS unused_days FROM observations) WHERE state IN ('active', 'consolidated', 'stale') AND priority <> 'P0' AND unused_days >= CASE priority WHEN 'P1' THEN 90 ELSE 30 END""")
def rev_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows unused for longer than their priority allows; P0 is protected."""
    rank = scoring.priority(F.col("kind"), F.when(F.col("id") % 25 == 0, "P0"))
    o = observations(spark, sf_dir).where("state in ('active', 'consolidated', 'stale')").select("id", rank.alias("priority"), scoring.unused_days(F.coalesce("last_used", "ts"), now()).alias("unused_days"))
    threshold = F.when(F.col("priority") == "P1", 90).otherwise(30).cast("long")
    return o.withColumn("threshold", threshold).where("priority <> 'P0' and unused_days >= threshold")


@query(f"""SELECT 'stale' AS signal, count(*) FILTER ({_AGE} >= 60 AND label <> 'must_remember') AS n FROM observations UNION ALL SELECT 'bloated', count(*) FILTER (length(summary) >= 2400) FROM observations UNION ALL SELECT 'unlabelled', count(*) FILTER (label = 'unknown') FROM observations
    UNION ALL SELECT 'quarantined', count(*) FILTER (quarantined) FROM observations UNION ALL SELECT 'risky', count(*) FILTER (regexp_matches(summary, '(?i)\\b(password|passphrase)\\b|\\b(access|refresh)[ _-]*token\\b')) FROM observations UNION ALL SELECT 'total', count(*) FROM observations""")
def rev_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals in one pass over the rows."""
    c = F.col("summary")
    signals = {
        "stale": (F.datediff(now(), F.col("ts")) >= 60) & (F.col("label") != "must_remember"), "bloated": F.length(c) >= 2400, "unlabelled": F.col("label") == "unknown", "quarantined": F.col("quarantined"),
        "risky": c.rlike(r"(?i)\b(password|passphrase)\b|\b(access|refresh)[ _-]*token\b"), "total": F.lit(True),
    }
    one = observations(spark, sf_dir).agg(*(F.count_if(v).alias(k) for k, v in signals.items()))
    return one.unpivot([], list(signals), "signal", "n")


@query(f"""WITH h AS (SELECT scope, count(*) AS n, count(*) FILTER ({_AGE} >= 200) AS old, count(*) FILTER (label = 'unknown') AS unlabelled FROM observations GROUP BY scope) SELECT scope, advice FROM (SELECT scope, 'archive_old_rows' AS advice, old * 2 >= n AS due FROM h UNION ALL SELECT scope, 'grade_rows', unlabelled * 10 >= n * 6 FROM h UNION ALL SELECT scope, 'none_needed', old * 2 < n AND unlabelled * 10 < n * 6 FROM h) WHERE due""")
def rev_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    h = o.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.datediff(now(), F.col("ts")) >= 200).alias("old"), F.count_if(F.col("label") == "unknown").alias("unlabelled"))
    old, grade = F.col("old") * 2 >= F.col("n"), F.col("unlabelled") * 10 >= F.col("n") * 6
    advice = F.array_compact(F.array(F.when(old, "archive_old_rows"), F.when(grade, "grade_rows"), F.when(~old & ~grade, "none_needed")))
    return h.select("scope", F.explode(advice).alias("advice"))


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN abs(a.n - b.n) * 2 > a.n THEN 'drifted' ELSE 'steady' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def rev_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of a month as snapshots, compared key by key."""
    e = table(spark, sf_dir, "events").withColumn("late", F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00")))
    n = e.groupBy("user_id", "event_type").agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    change = F.when(F.col("a") == 0, "added").when(F.col("b") == 0, "removed").when(F.abs(F.col("a") - F.col("b")) * 2 > F.col("a"), "drifted").otherwise("steady")
    return n.select("user_id", "event_type", change.alias("change"))


@query("""SELECT id, CASE WHEN quarantined THEN 'reject' WHEN state = 'soft-archived' THEN 'hold' WHEN label = 'ignore' AND used_count = 0 THEN 'auto_apply' WHEN trust IN ('untrusted', 'quarantined') THEN 'hold' ELSE 'review' END AS decision, CASE WHEN quarantined THEN 'high' WHEN trust = 'trusted' THEN 'low' ELSE 'medium' END AS risk FROM observations""")
def rev_governor(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quarantined")
    decision = F.when(q, "reject").when(F.col("state") == "soft-archived", "hold").when((F.col("label") == "ignore") & (F.col("used_count") == 0), "auto_apply").when(F.col("trust").isin("untrusted", "quarantined"), "hold").otherwise("review")
    return observations(spark, sf_dir).select("id", decision.alias("decision"), F.when(q, "high").when(F.col("trust") == "trusted", "low").otherwise("medium").alias("risk"))


@query("""WITH u AS (SELECT user_id, event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before_n, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS after_n FROM events GROUP BY 1, 2) SELECT event_type, count(*) FILTER (after_n > before_n) AS improved, count(*) FILTER (after_n = before_n) AS neutral, count(*) FILTER (after_n < before_n) AS regressed FROM u GROUP BY 1""")
def rev_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use before and after a change, as counts of improved, neutral and regressed."""
    late = F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    u = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_if(~late).alias("x"), F.count_if(late).alias("y"))
    return u.groupBy("event_type").agg(F.count_if(F.col("y") > F.col("x")).alias("improved"), F.count_if(F.col("y") == F.col("x")).alias("neutral"), F.count_if(F.col("y") < F.col("x")).alias("regressed"))


@query("""SELECT l_orderkey AS pack_id, count(*) AS n, sum(l_quantity)::BIGINT AS tokens, count(*) FILTER (l_returnflag = 'R') AS blocked, round(count(*) FILTER (l_returnflag <> 'R') * 1.0 / count(*), 6)::DOUBLE AS coverage FROM lineitem GROUP BY 1""")
def pck_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs (orders) with how many items were blocked and the share that was cited."""
    blocked = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("tokens"), F.count_if(blocked).alias("blocked"), F.round(F.count_if(~blocked) / F.count(F.lit(1)), 6).alias("coverage"))


@query("""WITH s AS (SELECT session_id, summary, row_number() OVER (PARTITION BY session_id, lower(summary) ORDER BY turn DESC) AS seen, turn FROM turns WHERE contains(summary, '?') OR type = 'conversation.user'), f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place FROM s WHERE seen = 1) SELECT session_id, turn, place FROM f WHERE place <= 3""")
def win_working_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest distinct open lines of each session."""
    s = turns(spark, sf_dir).where(F.contains("summary", F.lit("?")) | (F.col("type") == "conversation.user")).select("session_id", "turn", F.lower("summary").alias("line"))
    s = s.withColumn("seen", F.row_number().over(Window.partitionBy("session_id", "line").orderBy(F.desc("turn")))).where("seen = 1")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))).where("place <= 3").select("session_id", "turn", F.col("place").cast("long").alias("place"))


@query("""SELECT doc_id AS id, CASE WHEN n > 0 THEN list_aggregate(codes, 'string_agg', ',') ELSE '' END AS codes FROM (SELECT doc_id, codes, len(codes) AS n FROM (SELECT doc_id, list_filter(["""
       + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{c}' END" for c, p in text.HIGH_RISK.items())
       + """], lambda x: x IS NOT NULL) AS codes FROM documents))""")
def str_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(text.high_risk(F.col("text")), ",").alias("codes"))
