"""Claims drawn from events: attachments, adjudication, sensitivity, patterns and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import claims
from ..operators.ranking import best
from .registry import query
from .views import table

#: A claim is a user with a type of event; evidence are hours, source classes the weekdays, errors on the same days contradict.
_SCORE = "round(least(1.0, 0.15 + 0.18 * evidence + 0.2 * prior + 0.08 * contra + least(0.15, 0.05 * classes)), 3)::DOUBLE"
_STATE = """CASE WHEN release = 'retired' THEN 'retired' WHEN evidence <= 0 AND prior <= 0 THEN 'rejected' WHEN least(1.0, contra * 0.35) >= 0.7 OR contra > 0 AND evidence <= 1 THEN 'contested' WHEN prior > 0 AND evidence = 0 THEN 'tentative'
    WHEN release = 'weakening' AND evidence < 4 THEN 'fragile' WHEN evidence <= 1 AND (prior > 0 OR score < 0.55) THEN 'fragile' WHEN contra > 0 THEN 'fragile' WHEN score >= 0.75 AND evidence >= 3 THEN 'accepted' WHEN score >= 0.4 AND evidence >= 1 THEN 'tentative' ELSE 'fragile' END"""
_CLAIMS = f"""raw AS (SELECT user_id, event_type, day(ts) AS d, count(DISTINCT hour(ts)) AS evidence, count(DISTINCT event_id % 3) AS classes FROM events WHERE event_type <> 'error' AND value > 20 GROUP BY 1, 2, 3),
    bad AS (SELECT user_id, day(ts) AS d, count(*) AS contra FROM events WHERE event_type = 'error' GROUP BY 1, 2),
    c AS (SELECT r.user_id, r.event_type, r.d, r.evidence, r.classes, coalesce(b.contra, 0) AS contra, (r.user_id % 4) / 10.0::DOUBLE AS prior, CASE WHEN r.user_id % 29 = 0 THEN 'retired' WHEN r.user_id % 7 = 0 THEN 'weakening' ELSE 'active' END AS release FROM raw r LEFT JOIN bad b ON b.user_id = r.user_id AND b.d = r.d),
    s AS (SELECT *, {_SCORE} AS score FROM c), a AS (SELECT *, {_STATE} AS state FROM s)"""


def daily_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
    raw = e.where("event_type <> 'error' and value > 20").groupBy("user_id", "event_type", "d").agg(F.count_distinct("h").alias("evidence"), F.count_distinct(F.col("event_id") % 3).alias("classes"))
    bad = e.where("event_type = 'error'").groupBy("user_id", "d").agg(F.count(F.lit(1)).alias("contra"))
    u = F.col("user_id")
    c = raw.join(bad, ["user_id", "d"], "left").withColumn("contra", F.coalesce("contra", F.lit(0))).withColumn("prior", u % 4 / 10.0)
    c = c.withColumn("release", F.when(u % 29 == 0, "retired").when(u % 7 == 0, "weakening").otherwise("active"))
    c = c.withColumn("score", claims.attachment_score(F.col("evidence"), F.col("prior"), F.col("contra"), F.col("classes")))
    return c.withColumn("state", claims.adjudicate(F.col("score"), F.col("evidence"), F.col("prior"), F.col("contra"), F.col("release")))


@query(f"""WITH {_CLAIMS} SELECT user_id, event_type, d::BIGINT AS d, score, state, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band, round(least(0.99, greatest(0.05, 0.7 * score + least(0.25, 0.06 * evidence))), 3)::DOUBLE AS confidence,
    CASE WHEN evidence <= 1 AND prior > 0 THEN 'fragile' WHEN contra > 0 THEN 'contested' WHEN evidence >= 3 THEN 'supported' ELSE 'watch' END AS fragility FROM a""")
def rev_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, prior, contra = F.col("evidence"), F.col("prior"), F.col("contra")
    return daily_claims(spark, sf_dir).select(
        "user_id", "event_type", F.col("d").cast("long").alias("d"), "score", "state", claims.band(F.col("score")).alias("band"), claims.confidence(F.col("score"), evidence).alias("confidence"), claims.fragility(evidence, prior, contra).alias("fragility")
    )


@query(f"""WITH {_CLAIMS}, less AS (SELECT user_id, event_type, d, greatest(evidence - 1, 0) AS evidence, classes, contra, prior, release, state AS before FROM a), s2 AS (SELECT *, {_SCORE} AS score FROM less), a2 AS (SELECT *, {_STATE} AS after FROM s2)
    SELECT before, after, count(*) AS n FROM a2 GROUP BY 1, 2""")
def rev_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How states move when each claim loses its strongest piece of evidence."""
    c = daily_claims(spark, sf_dir).withColumnRenamed("state", "before").withColumn("evidence", F.greatest(F.col("evidence") - 1, F.lit(0)))
    c = c.withColumn("score", claims.attachment_score(F.col("evidence"), F.col("prior"), F.col("contra"), F.col("classes")))
    after = claims.adjudicate(F.col("score"), F.col("evidence"), F.col("prior"), F.col("contra"), F.col("release"))
    return c.groupBy("before", after.alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CLAIMS}, w AS (SELECT user_id, event_type, state, lag(state) OVER (PARTITION BY user_id, event_type ORDER BY d) AS prev FROM a), p AS (SELECT event_type, CASE WHEN prev = state THEN 'stable' WHEN state = 'contested' THEN 'contested_recurrence' WHEN state = 'fragile' THEN 'fragile_recurrence' ELSE 'moved' END AS pattern FROM w WHERE prev IS NOT NULL)
    SELECT event_type, pattern, count(*) AS support, round(least(0.95, 0.35 + count(*) * 0.15), 3)::DOUBLE AS confidence FROM p GROUP BY 1, 2""")
def rev_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recurs between consecutive days of each claim."""
    before = F.lag("state").over(Window.partitionBy("user_id", "event_type").orderBy("d"))
    w = daily_claims(spark, sf_dir).select("event_type", "state", before.alias("prev")).where("prev is not null")
    s = F.col("state")
    pattern = F.when(F.col("prev") == s, "stable").when(s == "contested", "contested_recurrence").when(s == "fragile", "fragile_recurrence").otherwise("moved")
    return w.groupBy("event_type", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("support"), F.round(F.least(F.lit(0.95), 0.35 + F.count(F.lit(1)) * 0.15), 3).alias("confidence"))


@query(f"""WITH {_CLAIMS}, t AS (SELECT user_id, event_type, d, state, CASE WHEN prior > 0.25 AND evidence <= 1 THEN 'prior_dominance' WHEN contra >= 2 THEN 'tension' WHEN state = 'contested' THEN 'contested' END AS threat FROM a) SELECT threat, count(*) AS n, count(DISTINCT user_id) AS users FROM t WHERE threat IS NOT NULL GROUP BY 1""")
def rev_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = daily_claims(spark, sf_dir)
    threat = F.when((F.col("prior") > 0.25) & (F.col("evidence") <= 1), "prior_dominance").when(F.col("contra") >= 2, "tension").when(F.col("state") == "contested", "contested")
    return c.withColumn("threat", threat).where("threat is not null").groupBy("threat").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {_CLAIMS}, p AS (SELECT event_type, user_id, d, CASE state WHEN 'rejected' THEN 'retire' WHEN 'contested' THEN 'weaken' WHEN 'fragile' THEN 'review' END AS proposal, score FROM a), q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE proposal WHEN 'retire' THEN 0 WHEN 'weaken' THEN 1 ELSE 2 END, score, user_id, d) AS place FROM p WHERE proposal IS NOT NULL)
    SELECT event_type, user_id, d::BIGINT AS d, proposal, place FROM q WHERE place <= 8""")
def rev_governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most pressing proposals for each type of claim."""
    s = F.col("state")
    proposal = F.when(s == "rejected", "retire").when(s == "contested", "weaken").when(s == "fragile", "review")
    p = daily_claims(spark, sf_dir).withColumn("proposal", proposal).where("proposal is not null")
    urgency = F.when(F.col("proposal") == "retire", 0).when(F.col("proposal") == "weaken", 1).otherwise(2)
    out = best(p, 8, by=[urgency, F.col("score"), F.col("user_id"), F.col("d")], groups=["event_type"])
    return out.select("event_type", "user_id", F.col("d").cast("long").alias("d"), "proposal", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {_CLAIMS}, b AS (SELECT user_id, event_type, state FROM a WHERE d = 3), e AS (SELECT user_id, event_type, state FROM a WHERE d = 20) SELECT coalesce(b.user_id, e.user_id) AS user_id, coalesce(b.event_type, e.event_type) AS event_type, CASE WHEN b.state IS NULL THEN 'added' WHEN e.state IS NULL THEN 'removed' WHEN b.state <> e.state THEN 'changed' ELSE 'same' END AS change
    FROM b FULL JOIN e ON b.user_id = e.user_id AND b.event_type = e.event_type""")
def rev_session_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of two days side by side."""
    c = daily_claims(spark, sf_dir)
    on = lambda d, name: c.where(F.col("d") == d).select("user_id", "event_type", F.col("state").alias(name))
    joined = on(3, "b").join(on(20, "e"), ["user_id", "event_type"], "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("e").isNull(), "removed").when(F.col("b") != F.col("e"), "changed").otherwise("same")
    return joined.select("user_id", "event_type", change.alias("change"))


@query(f"""WITH {_CLAIMS}, g AS (SELECT user_id, event_type, d, CASE WHEN (user_id + d) % 3 = 0 THEN 'accepted' WHEN (user_id + d) % 3 = 1 THEN 'fragile' ELSE 'contested' END AS expected FROM raw)
    SELECT g.expected, count(*) AS n, count(*) FILTER (a.state = g.expected) AS hits, round(count(*) FILTER (a.state = g.expected) * 1.0 / count(*), 6)::DOUBLE AS accuracy FROM g LEFT JOIN a ON a.user_id = g.user_id AND a.event_type = g.event_type AND a.d = g.d GROUP BY 1""")
def rev_golden_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated states against expected ones."""
    c = daily_claims(spark, sf_dir)
    k = (F.col("user_id") + F.col("d")) % 3
    c = c.withColumn("expected", F.when(k == 0, "accepted").when(k == 1, "fragile").otherwise("contested"))
    hit = F.col("state") == F.col("expected")
    return c.groupBy("expected").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count(F.lit(1)), 6).alias("accuracy"))
