"""Synthesis cards, shadow logs, routes, source reviews, drafts, second opinions and texts of nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text, text
from ..operators import ranking
from .filters_joins import _TOKENS, USEFUL_TOKENS_SQL, useful_tokens
from .memory import _DETAIL, _details
from .registry import query
from .views import nodes, observations, table, turns

#: Wordings of a source that is not to be trusted, and of one that is not to be shared. Fixed values.
RISK_TERMS = (
    "ignore previous instructions",
    "reveal your system prompt",
    "delete all",
    "exfiltrate",
    "api key",
    "password",
    "secret token",
)
PRIVATE_MARKERS = ("private-channel:", "private-user:", "operator-ledger", "local-only receipt")
#: Lines that state a decision or a task. Fixed values.
DECISION_LINE = r"(?i)^(?:decision|decided|決策|決定)\s*[:：-]\s*(?:.+)$"
TASK_LINE = r"(?i)^(?:todo|next|follow[- ]?up|action|下一步|待辦)\s*[:：-]\s*(?:.+)$"
MOST_CANDIDATES = 12


# Synthesis cards

_THEN, _NOW = "label = 'must_remember' AND id % 400 > 100", "label = 'must_remember' AND state <> 'soft-archived'"


@query(f"""
    SELECT *, CASE WHEN added + dropped = 0 THEN 'fresh' ELSE 'stale' END AS status
    FROM (SELECT scope, count(*) FILTER (a AND b) AS kept, count(*) FILTER (NOT a AND b) AS added, count(*) FILTER (a AND NOT b) AS dropped
          FROM (SELECT scope, {_THEN} AS a, {_NOW} AS b FROM observations) GROUP BY scope HAVING bool_or(a))
""")
def syn_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope's card was made from the rows of a label over 100 days old; how that selection differs from today's."""
    o = observations(spark, sf_dir).select("scope", F.expr(_THEN).alias("a"), F.expr(_NOW).alias("b"))
    a, b = F.col("a"), F.col("b")
    sums = o.groupBy("scope").agg(
        F.count_if(a & b).alias("kept"),
        F.count_if(~a & b).alias("added"),
        F.count_if(a & ~b).alias("dropped"),
        F.bool_or("a").alias("made"),
    )
    status = F.when(F.col("added") + F.col("dropped") == 0, "fresh").otherwise("stale")
    return sums.where("made").drop("made").withColumn("status", status)


@query(f"""
    WITH t AS (SELECT scope, unnest({_TOKENS.format("summary")}) AS token FROM turns WHERE session_id % 4 <> 0),
         n AS (SELECT scope, token, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 3)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, token) AS rank FROM n) WHERE rank <= 5
""")
def syn_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new cards could be of: the tokens that most rows of a scope share of those that no card covers (every fourth session has one)."""
    loose = turns(spark, sf_dir).where("session_id % 4 <> 0")
    tokens = loose.select("scope", F.explode(text.token_set(F.col("summary"))).alias("token"))
    counts = tokens.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    best = ranking.best(counts, 5, by=[F.desc("n"), F.col("token")], groups=["scope"])
    return best.select("scope", "token", "n", F.col("rank").cast("long").alias("rank"))


_HITS_SQL = """h AS (SELECT * FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank
    FROM observations) WHERE rank <= 8)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, id, rank): the eight longest rows of each scope stand for the hits of a search."""
    o = observations(spark, sf_dir).select("scope", "id", F.length("summary").alias("chars"))
    return ranking.best(o, 8, by=[F.desc("chars"), F.col("id")], groups=["scope"]).select("scope", "id", "rank")


@query(f"""
    WITH {_HITS_SQL}, c AS (SELECT scope, id // 500 AS card, count(*) AS n, min(rank) AS rank, string_agg(id, ',' ORDER BY rank) AS covered FROM h GROUP BY 1, 2)
    SELECT scope, 'card:' || card AS ref, rank, covered FROM c WHERE n >= 2
    UNION ALL SELECT h.scope, 'obs:' || h.id, h.rank, NULL FROM h JOIN c ON c.scope = h.scope AND c.card = h.id // 500 WHERE c.n < 2
""")
def syn_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with those that a card covers replaced by it: a card of two hits or more takes the best of their ranks and names them."""
    h = _hits(spark, sf_dir).withColumn("card", F.floor(F.col("id") / 500))
    pairs = F.array_sort(F.collect_list(F.struct("rank", "id")))  # eight of a scope at most
    cards = h.groupBy("scope", "card").agg(F.min("rank").alias("rank"), pairs.alias("hits"))
    ids = F.transform("hits", lambda x: x["id"].cast("string"))
    many = F.size("hits") >= 2
    ref = F.when(many, F.concat(F.lit("card:"), "card")).otherwise(F.concat(F.lit("obs:"), ids[0]))
    return cards.select("scope", ref.alias("ref"), F.col("rank").cast("long").alias("rank"), F.when(many, F.array_join(ids, ",")).alias("covered"))


@query(f"""
    WITH {_HITS_SQL} SELECT scope, count(*) AS selected, sha256(string_agg('obs:' || id, ',' ORDER BY rank)) AS signature FROM h GROUP BY 1
""")
def pck_shadow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pack would have selected in each scope, as a row to append: how many, and a signature of their order."""
    refs = F.array_sort(F.collect_list(F.struct("rank", "id")))  # eight of a scope at most
    of = _hits(spark, sf_dir).groupBy("scope").agg(refs.alias("refs"))
    named = F.array_join(F.transform("refs", lambda x: F.concat(F.lit("obs:"), x["id"].cast("string"))), ",")
    return of.select("scope", F.size("refs").cast("long").alias("selected"), F.sha2(named, 256).alias("signature"))


@query("""
    WITH q AS (SELECT c_custkey AS query_id, 'nation:' || (c_nationkey + CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 0 END) AS asked, c_custkey % 5 <> 0 AS ready FROM customer)
    SELECT query_id, CASE WHEN ready AND n.node_id IS NOT NULL THEN 'graph' ELSE 'episodes' END AS route,
        CASE WHEN NOT ready THEN 'graph_not_ready' WHEN n.node_id IS NULL THEN 'no_candidates' ELSE 'graph_candidates' END AS reason
    FROM q LEFT JOIN nodes n ON n.node_id = q.asked
""")
def cli_route_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each question goes: to the graph if that is ready and has what was asked for, else to the episodes."""
    wide = F.when(F.col("c_custkey") % 3 == 0, 1000).otherwise(0)
    q = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.concat(F.lit("nation:"), F.col("c_nationkey") + wide).alias("asked"),
        (F.col("c_custkey") % 5 != 0).alias("ready"),
    )
    known = nodes(spark, sf_dir).select("node_id")
    found = F.col("node_id").isNotNull()
    route = F.when(F.col("ready") & found, "graph").otherwise("episodes")
    reason = F.when(~F.col("ready"), "graph_not_ready").when(~found, "no_candidates").otherwise("graph_candidates")
    return q.join(known, F.col("asked") == F.col("node_id"), "left").select("query_id", route.alias("route"), reason.alias("reason"))


# Sources and drafts


def source_review(body: Column) -> Column:
    """Struct of line, candidate, follow-up, risk and marker counts of a source; null is empty.

    Lines are trimmed, empty ones don't count. A source with risk terms has a candidate for
    that; each line that states a decision or a task is one, twelve in all at most.
    """
    body = F.coalesce(body, F.lit(""))
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), lambda x: F.trim(x, F.lit(" \t\f\x0b"))), lambda x: x != "")
    count = lambda words: sum(F.contains(F.lower(body), F.lit(w)).cast("int") for w in words)
    risks = count(RISK_TERMS)
    said = F.slice(F.filter(lines, lambda x: x.rlike(DECISION_LINE) | x.rlike(TASK_LINE)), 1, MOST_CANDIDATES - F.least(risks, F.lit(1)))
    tasks = F.filter(said, lambda x: ~x.rlike(DECISION_LINE))
    return F.struct(
        F.size(lines).alias("line_count"),
        (F.size(said) + F.least(risks, F.lit(1))).alias("candidate_count"),
        F.size(tasks).alias("follow_up_count"),
        risks.alias("risk_term_count"),
        count(PRIVATE_MARKERS).alias("private_marker_count"),
    )


_MARKED = """CASE event_id % 4 WHEN 0 THEN 'Decision: ' || replace(summary, '. ', chr(10) || 'TODO - ') WHEN 1 THEN 'Next: ' || summary || chr(13) || chr(10) || ' api key, password ' || chr(10)
    WHEN 2 THEN replace(summary, '. ', chr(10) || 'decided-') || ' Operator-Ledger' ELSE summary END"""
_COUNT_SQL = " + ".join("contains(lower(body), '{}')::INT".format(w) for w in RISK_TERMS)


@query(f"""
    WITH b AS (SELECT event_id, {_MARKED} AS body FROM turns),
        l AS (SELECT event_id, list_filter(list_transform(regexp_split_to_array(body, '\\r\\n|\\r|\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines,
            {_COUNT_SQL} AS risks, {" + ".join(f"contains(lower(body), '{w}')::INT" for w in PRIVATE_MARKERS)} AS marks FROM b),
        s AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{DECISION_LINE}') OR regexp_matches(x, '{TASK_LINE}'))[1:{MOST_CANDIDATES} - least(risks, 1)] AS said FROM l)
    SELECT event_id, len(lines) AS line_count, len(said) + least(risks, 1) AS candidate_count, len(list_filter(said, lambda x: NOT regexp_matches(x, '{DECISION_LINE}'))) AS follow_up_count,
        risks AS risk_term_count, marks AS private_marker_count FROM s
""")
def str_source_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a source to review; most are given lines that state something, since the table has none."""
    r = turns(spark, sf_dir).select("event_id", source_review(F.expr(_MARKED)).alias("r"))
    names = ("line_count", "candidate_count", "follow_up_count", "risk_term_count", "private_marker_count")
    return r.select("event_id", *(F.col(f"r.{n}").cast("long").alias(n) for n in names))


@query(f"""
    WITH {USEFUL_TOKENS_SQL}, y AS (SELECT session_id, type, count(*) AS n FROM turns GROUP BY 1, 2),
        types AS (SELECT session_id, sum(n) AS events, string_agg(type || ':' || n, ' | ' ORDER BY n DESC, type) AS said FROM y GROUP BY 1),
        k AS (SELECT session_id, token, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, token) AS rank FROM useful GROUP BY 1, 2 HAVING count(*) >= 2),
        tokens AS (SELECT session_id, string_agg(token, ', ' ORDER BY rank) AS said FROM k WHERE rank <= 3 GROUP BY 1)
    SELECT session_id, CAST(events AS BIGINT) || ' events in scope' || session_id % 5 || ' share ' || coalesce(tokens.said, 'related context') || ' (' || types.said || ')' AS draft
    FROM types LEFT JOIN tokens USING (session_id)
""")
def agg_cluster_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each session's events: how many, the three tokens that most of them share, and their three types."""
    types = turns(spark, sf_dir).groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "type", "n")))  # there are three types
    said = F.array_join(F.transform("types", lambda x: F.concat(x["type"], F.lit(":"), x["n"].cast("string"))), " | ")
    types = types.groupBy("session_id").agg(F.sum("n").alias("events"), ordered.alias("types"))
    held = useful_tokens(spark, sf_dir).groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    best = ranking.best(held, 3, by=[F.desc("n"), F.col("token")], groups=["session_id"])
    tokens = best.groupBy(F.col("session_id").alias("s")).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("tokens"))
    shared = F.coalesce(F.array_join(F.transform("tokens", lambda x: x["token"]), ", "), F.lit("related context"))
    draft = F.format_string("%d events in scope%d share %s (%s)", "events", F.col("session_id") % 5, shared, said)
    return types.join(tokens, F.col("session_id") == F.col("s"), "left").select("session_id", draft.alias("draft"))


# Second opinions

#: From which score on a downshift is looked at by a person, and which shift is small enough to apply unseen. Fixed values.
HIGHER_VALUE, SMALL_SHIFT, STRONG_REUSE = 0.50, 0.10, 2
#: The age that proposals of this query count as stale.
STALE_DAYS = 60


def challenged(code: Column, delta: Column, score: Column, age: Column, uses: Column, label_agrees: Column) -> Column:
    """Struct of risk (low, medium, high) and reasons for a proposed change of importance; null evidence is weak evidence.

    A label that doesn't go with the new score, or an unknown reason code, is high by
    itself; else every doubt makes it medium and every test says how it went.
    """
    stale, reuse = code == "stale_pressure", code == "reuse_signal"
    aligned = code == "label_alignment"
    old, used = F.coalesce(age >= STALE_DAYS, F.lit(False)), F.coalesce(uses, F.lit(0))
    # (applies to, is a doubt, reason if so, reason if not)
    tests = (
        (F.lit(True), F.abs(delta) > SMALL_SHIFT + 1e-9, "importance_delta_exceeds_auto_apply_cap", "bounded_importance_delta"),
        (stale, ~old, "staleness_evidence_weak", "age_threshold_met"),
        (stale, used > 0, "recent_use_conflict", "no_recent_use_conflict"),
        (stale, F.coalesce(score >= HIGHER_VALUE, F.lit(False)), "higher_value_memory_requires_review", None),
        (reuse, used < STRONG_REUSE, "reuse_signal_not_strong_enough", "reuse_signal_confirmed"),
        (aligned, delta != 0, "label_alignment_should_not_move_score", "label_alignment_only"),
    )
    doubts = [on & doubt for on, doubt, _, _ in tests]
    said = F.array(*(F.when(on, F.when(doubt, yes).otherwise(F.lit(no))) for on, doubt, yes, no in tests))
    known = F.coalesce(stale | reuse | aligned, F.lit(False))
    blocked = F.when(~label_agrees, "importance_label_mismatch").when(~known, "invalid_importance_reason_code")
    return F.struct(
        F.when(blocked.isNotNull(), "high").when(F.exists(F.array(*doubts), lambda x: x), "medium").otherwise("low").alias("risk"),
        F.when(blocked.isNotNull(), F.array(blocked)).otherwise(F.array_compact(said)).alias("reasons"),
    )


_PROPOSED = """CASE id % 4 WHEN 0 THEN 'stale_pressure' WHEN 1 THEN 'reuse_signal' WHEN 2 THEN 'label_alignment' ELSE CASE WHEN id % 8 = 3 THEN 'stale_pressure' ELSE 'guess' END END"""
_DELTA = "CASE id % 4 WHEN 0 THEN -10 WHEN 1 THEN 5 WHEN 2 THEN CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END ELSE -20 END"


@query(f"""
    WITH p AS (SELECT id, {_PROPOSED} AS code, {_DELTA} AS d, id % 101 AS score, id % 400 AS age, id % 7 AS uses, id % 11 <> 0 AS agrees FROM observations WHERE score IS NOT NULL),
        r AS (SELECT id, code, CASE WHEN NOT agrees THEN ['importance_label_mismatch'] WHEN code = 'guess' THEN ['invalid_importance_reason_code'] ELSE list_filter([
            CASE WHEN abs(d) > 10 THEN 'importance_delta_exceeds_auto_apply_cap' ELSE 'bounded_importance_delta' END,
            CASE WHEN code = 'stale_pressure' THEN CASE WHEN age < 60 THEN 'staleness_evidence_weak' ELSE 'age_threshold_met' END END,
            CASE WHEN code = 'stale_pressure' THEN CASE WHEN uses > 0 THEN 'recent_use_conflict' ELSE 'no_recent_use_conflict' END END,
            CASE WHEN code = 'stale_pressure' AND score >= 50 THEN 'higher_value_memory_requires_review' END,
            CASE WHEN code = 'reuse_signal' THEN CASE WHEN uses < 2 THEN 'reuse_signal_not_strong_enough' ELSE 'reuse_signal_confirmed' END END,
            CASE WHEN code = 'label_alignment' THEN CASE WHEN d <> 0 THEN 'label_alignment_should_not_move_score' ELSE 'label_alignment_only' END END], lambda x: x IS NOT NULL) END AS reasons FROM p)
    SELECT id, code, array_to_string(reasons, ',') AS reasons, CASE WHEN list_has_any(reasons, ['importance_label_mismatch', 'invalid_importance_reason_code']) THEN 'high'
        WHEN list_has_any(reasons, ['importance_delta_exceeds_auto_apply_cap', 'staleness_evidence_weak', 'recent_use_conflict', 'higher_value_memory_requires_review', 'reuse_signal_not_strong_enough', 'label_alignment_should_not_move_score'])
        THEN 'medium' ELSE 'low' END AS risk FROM r
""")
def rev_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second opinion on a proposed change of each scored row's importance."""
    o = observations(spark, sf_dir).where("score is not null")
    i = F.col("id")
    p = o.select("id", "score", "used_count", F.expr(_PROPOSED).alias("code"), (F.expr(_DELTA) / 100.0).alias("delta"))
    said = challenged(F.col("code"), F.col("delta"), F.col("score"), i % 400, F.col("used_count"), i % 11 != 0)
    return p.select("id", "code", said.alias("s")).select("id", "code", F.array_join("s.reasons", ",").alias("reasons"), F.col("s.risk").alias("risk"))


# Nested JSON

_INNER_SQL = """CASE event_id % 4 WHEN 0 THEN 'Stale' WHEN 1 THEN '2024-01-01' WHEN 2 THEN 'odd'
    ELSE 'obs:' || user_id || CASE WHEN user_id = event_id THEN '' ELSE chr(10) || 'obs:' || event_id END END"""


@query(f"""SELECT event_id, event_type || chr(10) || {_INNER_SQL} || CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN '' ELSE chr(10) || json_extract_string(props, '$.k') END AS search FROM events""")
def jsn_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searchable text of each event: its type, the strings of its detail and those of its properties."""
    d = _details(spark, sf_dir).withColumnRenamed("event_id", "id")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props").join(d, F.col("event_id") == F.col("id"))
    return e.select("event_id", json_text.search_text(F.col("event_type"), F.col("detail"), F.col("props")).alias("search"))


@query(f"""SELECT event_id, 'lifecycle ' || CASE event_id % 4 WHEN 0 THEN 'state  Stale ' WHEN 1 THEN 'archived_at 2024-01-01' WHEN 2 THEN 'state odd archived_at  '
    ELSE 'refs obs:' || user_id || ' x obs:' || event_id END AS spoken FROM (SELECT *, {_DETAIL} AS d FROM events)""")
def jsn_spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and values of each detail as one text."""
    return _details(spark, sf_dir).select("event_id", json_text.spoken(F.col("detail")).alias("spoken"))


_PAYLOAD = """CASE event_id % 5 WHEN 0 THEN '{"stdout": "x", " STDERR ": 1, "note": "mail a.b@c.org now"}' WHEN 1 THEN '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}'
    WHEN 2 THEN concat('{"z": "password: hunter', user_id, '", "y": [1, null, true]}') WHEN 3 THEN concat('{"text": "', repeat('xy', 3000), '"}') ELSE props END"""


@query(f"""SELECT event_id, body, contains(body, '"_truncated":') AS truncated FROM (SELECT event_id, CASE event_id % 5
    WHEN 0 THEN '{{"_redacted_output_fields":2,"note":"mail [REDACTED_EMAIL] now"}}' WHEN 1 THEN '{{"a":{{"b":{{"c":{{"d":{{"e":{{"f":"[TRUNCATED_DEPTH]"}}}}}}}}}}}}'
    WHEN 2 THEN '{{"y":[1,null,true],"z":"[REDACTED_SECRET]"}}'
    WHEN 3 THEN '{{"_truncated":true,"original_bytes":4110,"preview":"{{\\"text\\":\\"' || repeat('xy', 123) || 'x","reason":"payload_cap"}}'
    ELSE replace(props, ' ', '') END AS body FROM events)""")
def jsn_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made safe and small; four of five are given something to leave out, since the table has nothing of that kind."""
    # The work of a row is far more than its bytes, by which a file is cut to tasks.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "props").repartition("event_id").select("event_id", json_text.bounded(F.expr(_PAYLOAD)).alias("body"))
    return e.withColumn("truncated", F.contains("body", F.lit('"_truncated":')))
