"""Ranking, fusion, selection and packing over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import lexical, ranking, trigrams, vector
from .registry import query
from .views import NOW, facts, now, observations, table, turns, vectors

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Weights of a composite score in SQL, from the same tables.
_CASE = lambda col, t, other: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {other} END::DOUBLE"
COMPOSITE = (
    f"greatest(0.0, {{0}})::DOUBLE * {_CASE('label', scoring.IMPORTANCE_WEIGHTS, 1.0)} * pow(0.5::DOUBLE, greatest(0, date_diff('second', ts, TIMESTAMP '{NOW}')) / 86400.0::DOUBLE / {_CASE('kind', scoring.HALF_LIFE_DAYS, 30.0)})"
    f" * least(1.3::DOUBLE, 1.0 + 0.1 * ln(1 + used_count)) * {_CASE('state', scoring.STATE_GATES, 1.0)}"
)
#: Ranked lexical and vector lanes: benchmark items ask, at most 20 hits each.
BM25_SQL = rf"""asked AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark), sized AS (SELECT doc_id AS id, {WORDS.format('text')} AS words FROM documents),
    stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean_length FROM sized), posts AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(words) AS length, unnest(words) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1), bm AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)))), 6) AS score
    FROM posts JOIN df USING (term) JOIN asked USING (term) CROSS JOIN stats GROUP BY 1, 2), lex AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 20)"""


def lexical_lane(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of BM25: every benchmark item asks all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.bm25_best(docs, asked, k).drop("n_terms")


@query(f"WITH {BM25_SQL} SELECT query_id, id, round(score, 4) AS score, rank FROM lex WHERE rank <= 10")
def ret_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_lane(spark, sf_dir, 10).select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_COSINE = """asked AS (SELECT id AS query_id, vector::DOUBLE[] AS q FROM vectors WHERE id % 100 = 0), scored AS (SELECT query_id, id, round(list_cosine_similarity(q, vector::DOUBLE[]), 9) AS score FROM asked CROSS JOIN vectors), vec AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""


@query(f"WITH {_COSINE} SELECT query_id, id, round(score, 6) AS score, rank FROM vec")
def top_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 100."""
    v = vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector.cosine_top_k(v, asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LANES = """a AS (SELECT scope AS query_id, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank FROM observations), b AS (SELECT scope AS query_id, id, row_number() OVER (PARTITION BY scope ORDER BY ts DESC, id) AS rank FROM observations WHERE label <> 'ignore'),
    rrf AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, sum(CASE WHEN lane = 'a' THEN rank END)::BIGINT AS rank_a, sum(CASE WHEN lane = 'b' THEN rank END)::BIGINT AS rank_b FROM (SELECT 'a' AS lane, * FROM a WHERE rank <= 50 UNION ALL SELECT 'b', * FROM b WHERE rank <= 50) GROUP BY 1, 2)"""


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).select(F.col("scope").alias("query_id"), "id", F.length("summary").alias("chars"), "ts", "label")
    a = ranking.best(o, 50, by=[F.desc("chars"), F.col("id")], groups=["query_id"])
    b = ranking.best(o.where("label <> 'ignore'"), 50, by=[F.desc("ts"), F.col("id")], groups=["query_id"])
    return ranking.fuse({"a": a, "b": b}, groups=["query_id"])


@query(f"WITH {_LANES} SELECT query_id, id, round(rrf, 9) AS rrf, rank_a, rank_b FROM rrf")
def win_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lanes of each scope, the longest and the newest fifty, fused by reciprocal rank."""
    return _lanes(spark, sf_dir).select("query_id", "id", F.round("rrf", 9).alias("rrf"), F.col("rank_a").cast("long"), F.col("rank_b").cast("long"))


@query("""WITH l AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank FROM observations QUALIFY rank <= 30), g AS (SELECT scope, id, round(used_count / 20.0::DOUBLE, 6) AS score FROM observations WHERE used_count >= 5),
    u AS (SELECT scope, id, 'lexical' AS lane, 1.0::DOUBLE / (rank + 1) AS s FROM l UNION ALL SELECT scope, id, 'graph', score FROM g) SELECT scope, id, lane, round(s, 9) AS hybrid_score, row_number() OVER (PARTITION BY scope ORDER BY s DESC, lane, id) AS rank FROM u""")
def win_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits and scored neighbours of each scope in one order."""
    o = observations(spark, sf_dir)
    hits = ranking.best(o.select("scope", "id", F.length("summary").alias("chars")), 30, by=[F.desc("chars"), F.col("id")], groups=["scope"])
    near = o.where("used_count >= 5").select("scope", "id", F.round(F.col("used_count") / 20.0, 6).alias("score"))
    return ranking.blend(hits, near, groups=["scope"]).select("scope", "id", "lane", F.round("hybrid_score", 9).alias("hybrid_score"), F.col("rank").cast("long").alias("rank"))


_TIERS = "h AS (SELECT scope, id, CASE label WHEN 'must_remember' THEN 'must' WHEN 'unknown' THEN 'unknown' ELSE 'ignore' END AS t0, CASE WHEN id % 5 = 0 THEN 'nice' ELSE CASE label WHEN 'must_remember' THEN 'must' WHEN 'unknown' THEN 'unknown' ELSE 'ignore' END END AS tier, (id * 37 % 1000) / 1000.0::DOUBLE AS score, id % 50 AS created FROM observations)"


def _tier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("id") % 5 == 0, "nice").when(F.col("label") == "must_remember", "must").when(F.col("label") == "unknown", "unknown").otherwise("ignore")
    return observations(spark, sf_dir).select("scope", "id", tier.alias("tier"), (F.col("id") * 37 % 1000 / 1000.0).alias("score"), (F.col("id") % 50).alias("created"))


@query(f"""WITH {_TIERS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, tier ORDER BY score DESC, created DESC, id) AS tr, count(*) FILTER (tier = 'must') OVER w AS nm, count(*) FILTER (tier = 'nice') OVER w AS nn, count(*) FILTER (tier = 'unknown') OVER w AS nu FROM h WINDOW w AS (PARTITION BY scope)),
    q AS (SELECT *, least(2, 8, nn) AS qn, least(4, 8 - least(2, 8, nn), nm) AS qm FROM r), z AS (SELECT *, least(1, 8 - qn - qm, nu) AS qu FROM q), k AS (SELECT *, tr <= CASE tier WHEN 'must' THEN qm WHEN 'nice' THEN qn WHEN 'unknown' THEN qu ELSE 0 END AS reserved FROM z),
    w AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY reserved, score DESC, created DESC, id, tier) AS wr FROM k) SELECT scope, id, tier, NOT reserved AS wildcard FROM w WHERE reserved OR wr <= 8 - qm - qn - qu""")
def win_tier_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight hits of each scope: two nice at least, four must and one unknown at most, the rest by score."""
    return ranking.tier_quota(_tier_hits(spark, sf_dir), limit=8, must_max=4, nice_min=2, unknown_max=1, groups=["scope"]).select("scope", "id", "tier", "wildcard")


@query(f"""WITH {_TIERS} SELECT scope, id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY list_position(['must', 'nice', 'unknown'], tier), score DESC, created DESC, id) AS rank FROM h WHERE tier <> 'ignore') WHERE rank <= 12""")
def win_tier_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tier_first(_tier_hits(spark, sf_dir), limit=12, tiers=("must", "nice", "unknown"), groups=["scope"]).select("scope", "id", "tier", F.col("rank").cast("long").alias("rank"))


_SCORED = f"""rel AS (SELECT *, 1.0::DOUBLE / (61 + id % 50) AS relevance FROM observations), s AS (SELECT *, round({COMPOSITE.format('relevance')}, 12) AS final FROM rel)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a composite score; the relevance stands for a rank in some lane."""
    final = scoring.composite(1.0 / (61 + F.col("id") % 50), F.col("label"), F.col("kind"), F.col("ts"), F.col("used_count"), F.col("state"), now())
    return observations(spark, sf_dir).withColumn("final", F.round(final, 12))


@query(f"WITH {_SCORED} SELECT id, round(final, 9) AS final FROM s")
def mth_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", F.round("final", 9).alias("final"))


_TRUST = "CASE trust WHEN 'trusted' THEN 0 WHEN 'unknown' THEN 1 WHEN 'untrusted' THEN 2 ELSE 99 END"
_PLACED = f"""{_SCORED}, c AS (SELECT scope, id, kind, summary, quarantined, row_number() OVER (PARTITION BY scope ORDER BY {_TRUST}, final DESC, id DESC) AS place FROM s WHERE state <> 'soft-archived' QUALIFY place <= 24),
    e AS (SELECT *, NOT quarantined AND summary <> '' AS eligible FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY scope, kind, eligible ORDER BY place) AS kr, count(*) FILTER (eligible AND kind = 'preference') OVER w AS np, count(*) FILTER (eligible AND kind = 'decision') OVER w AS nd FROM e WINDOW w AS (PARTITION BY scope)),
    rs AS (SELECT *, CASE WHEN eligible AND kind = 'preference' AND kr <= least(1, np) THEN 1 WHEN eligible AND kind = 'decision' AND kr <= least(1, nd) THEN 2 ELSE 3 END AS reserve FROM k), pl AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY reserve, place) AS new_place FROM rs),
    q AS (SELECT *, eligible AND kind = 'event' AND row_number() OVER (PARTITION BY scope, kind, eligible ORDER BY new_place) > 3 AS capped FROM pl)"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 24 candidates of each scope in packing order, with quotas applied."""
    trust = F.when(F.col("trust") == "trusted", 0).when(F.col("trust") == "unknown", 1).when(F.col("trust") == "untrusted", 2).otherwise(99)
    rows = scored(spark, sf_dir).where("state <> 'soft-archived'").select("scope", "id", "kind", "summary", "quarantined", "final", trust.alias("trust_rank"))
    best = ranking.best(rows, 24, by=[F.col("trust_rank"), F.desc("final"), F.desc("id")], groups=["scope"]).withColumnRenamed("rank", "place")
    best = best.withColumn("eligible", ~F.col("quarantined") & (F.col("summary") != ""))
    return ranking.soft_quota(best, limit=8, groups=["scope"])


@query(f"WITH {_PLACED} SELECT scope, id, kind, new_place, capped, reserve < 3 AS reserved FROM q")
def win_soft_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("scope", "id", "kind", F.col("new_place").cast("long").alias("new_place"), "capped", "reserved")


@query(f"""WITH RECURSIVE {_PLACED}, cand AS (SELECT scope, id, greatest(1, (length(summary) + 3) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY scope ORDER BY new_place) AS p FROM q WHERE eligible AND NOT capped),
    fold AS (SELECT scope, 0::BIGINT AS p, 0::BIGINT AS used, 0::BIGINT AS taken, NULL::BIGINT AS id, false AS hit FROM (SELECT DISTINCT scope FROM cand)
    UNION ALL SELECT f.scope, f.p + 1, CASE WHEN f.taken < 8 AND f.used + c.tokens <= 1200 THEN f.used + c.tokens ELSE f.used END, CASE WHEN f.taken < 8 AND f.used + c.tokens <= 1200 THEN f.taken + 1 ELSE f.taken END, c.id, f.taken < 8 AND f.used + c.tokens <= 1200 FROM fold f JOIN cand c ON c.scope = f.scope AND c.p = f.p + 1)
    SELECT scope, id, taken AS position, used FROM fold WHERE hit""")
def pck_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context pack for each scope: at most eight memories and 1,200 tokens."""
    candidates = placed(spark, sf_dir).where("eligible and not capped").select("scope", F.col("new_place").alias("place"), "id", text.token_estimate(F.col("summary")).alias("tokens"))
    return ranking.pack_within_budget(candidates, budget=1200, limit=8, groups=["scope"]).select("scope", "id", F.col("position").cast("long").alias("position"), "used")


@query("""WITH c AS (SELECT subject, fact_id, object, greatest(1, (length(subject || predicate || object) + 3) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY subject ORDER BY CASE confidence WHEN 'operator_asserted' THEN 3 WHEN 'corroborated' THEN 2 WHEN 'source_capped' THEN 1 ELSE 0 END DESC, valid_from, fact_id) AS p FROM facts WHERE status = 'active')
    SELECT subject, fact_id AS id, p AS position FROM (SELECT *, sum(tokens) OVER (PARTITION BY subject ORDER BY p) AS upto FROM c WHERE p <= 4) WHERE p = 1 OR upto <= 1000""")
def fct_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four surest facts of each subject, oldest first among equals; the first always fits."""
    sure = F.when(F.col("confidence") == "operator_asserted", 3).when(F.col("confidence") == "corroborated", 2).when(F.col("confidence") == "source_capped", 1).otherwise(0)
    f = facts(spark, sf_dir).where("status = 'active'").select("subject", "fact_id", "valid_from", sure.alias("sure"), text.token_estimate(F.concat("subject", "predicate", "object")).alias("tokens"))
    best = ranking.best(f, 4, by=[F.desc("sure"), F.col("valid_from"), F.col("fact_id")], groups=["subject"]).select("subject", F.col("rank").alias("place"), F.col("fact_id").alias("id"), "tokens")
    return ranking.pack_within_budget(best, budget=1000, limit=4, groups=["subject"], first_always=True).select("subject", "id", F.col("position").cast("long").alias("position"))


@query(f"""WITH {BM25_SQL.replace('documents', "(SELECT event_id AS doc_id, summary AS text FROM turns)")}, hits AS (SELECT l.query_id, t.session_id, t.event_id, t.type, l.rank, l.score, CAST(epoch(t.ts) AS BIGINT) AS ts FROM lex l JOIN turns t ON t.event_id = l.id)
    SELECT query_id, session_id, count(*) AS hits, min(rank) AS best_rank, max(score) AS best_score, max(ts) AS latest, count(*) FILTER (type = 'conversation.user') AS user_hits, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank), max(ts) DESC, session_id) AS place FROM hits GROUP BY 1, 2""")
def ret_episodic_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the hits their events have for each question."""
    t = turns(spark, sf_dir)
    hits = lexical.bm25_best(t.select(F.col("event_id").alias("id"), F.col("summary").alias("text")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 20).drop("n_terms")
    best = hits.join(t.select(F.col("event_id").alias("id"), "session_id", "type", "ts"), "id")
    sessions = best.groupBy("query_id", "session_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").cast("long").alias("best_rank"), F.max("score").alias("best_score"), F.unix_timestamp(F.max("ts")).alias("latest"), F.count_if(F.col("type") == "conversation.user").alias("user_hits"))
    return ranking.ranked(sessions, by=[F.desc("hits"), F.col("best_rank"), F.desc("latest"), F.col("session_id")], groups=["query_id"], name="place").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {BM25_SQL}, truth AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), first AS (SELECT t.item_id, min(l.rank) AS rank FROM truth t LEFT JOIN lex l ON l.query_id = t.item_id AND l.id = t.doc_id GROUP BY 1)
    SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(rank), 6) AS mean_rank, count(*) FILTER (rank IS NULL) AS misses FROM first""")
def eval_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval quality: does BM25 find the documents that hold a benchmark item word for word?"""
    first = F.col("rank")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    truth = trigrams.scanned(docs, items, fold=False)
    ranks = truth.join(lexical_lane(spark, sf_dir), ["query_id", "id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return ranks.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(first <= 5, 1.0).otherwise(0.0)), 6).alias("recall_at_5"), F.round(F.avg(F.coalesce(1.0 / first, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(first.isNull()).alias("misses"),
    )


@query(f"""WITH {BM25_SQL}, {_COSINE.replace('asked AS', 'vasked AS').replace('FROM asked', 'FROM vasked')}, v AS (SELECT query_id // 100 AS query_id, id, rank FROM vec), f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(lane = 'lexical') AS in_lexical, max(lane = 'vector') AS in_vector FROM (SELECT 'lexical' AS lane, query_id, id, rank FROM lex UNION ALL SELECT 'vector', query_id, id, rank FROM v) GROUP BY 1, 2),
    o AS (SELECT f.*, round({COMPOSITE.format('rrf')}, 12) AS final FROM f JOIN observations USING (id) WHERE state <> 'soft-archived') SELECT query_id, id, round(final, 9) AS final, in_lexical, in_vector, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id DESC) AS rank FROM o) WHERE rank <= 10""")
def ret_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector lanes fused, archived rows left out, ranked by composite score; payloads are joined to ranked ids only."""
    v = vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    near = vector.cosine_top_k(v, asked, 10).withColumn("query_id", F.expr("query_id div 100"))
    fused = ranking.fuse({"lexical": lexical_lane(spark, sf_dir), "vector": near}, groups=["query_id"])
    o = observations(spark, sf_dir).where("state <> 'soft-archived'").drop("summary")
    final = scoring.composite(F.col("rrf"), F.col("label"), F.col("kind"), F.col("ts"), F.col("used_count"), F.col("state"), now())
    rows = fused.join(o, "id").withColumn("final", F.round(final, 12))
    best = ranking.best(rows, 10, by=[F.desc("final"), F.desc("id")], groups=["query_id"])
    return best.select("query_id", "id", F.round("final", 9).alias("final"), F.col("rank_lexical").isNotNull().alias("in_lexical"), F.col("rank_vector").isNotNull().alias("in_vector"), F.col("rank").cast("long").alias("rank"))
