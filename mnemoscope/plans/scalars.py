"""Text, number, time and JSON functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from .registry import query
from .views import NOW, now, observations, receipts, table, turns

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[ \t\n\r\f\x0B]+"


@query(rf"""SELECT id, md5(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LOWER.format("trim(raw)")}, '{_SPACE}', '-', 'g'), '[^a-z0-9._:/-]+', '-', 'g'), '-+', '-', 'g'), '^[./:_-]+', ''), '[./:_-]+$', ''), '')) AS scope
    FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '  Team ' || source || '!! ' WHEN 1 THEN '--' || lang || '/' || source || '::' WHEN 2 THEN text ELSE '///' END AS raw FROM documents)""")
def str_scope_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 4
    raw = F.when(i == 0, F.concat(F.lit("  Team "), "source", F.lit("!! "))).when(i == 1, F.concat(F.lit("--"), "lang", F.lit("/"), "source", F.lit("::"))).when(i == 2, F.col("text")).otherwise("///")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.scope_token(raw).cast("binary")).alias("scope"))


#: For an engine without look-behind: a plus sign after a digit begins no number, so it is set aside meanwhile.
_REDACTED_SQL = r"""replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g'),
    '([0-9])\+', '\1' || chr(1), 'g'), '\+?[0-9][0-9\-\s()]{7,}[0-9]', '[REDACTED_PHONE]', 'g'), chr(1), '+')"""


@query(rf"""SELECT doc_id AS id, md5({_REDACTED_SQL}) AS digest, len(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b'))::BIGINT AS emails FROM documents""")
def str_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.redact(F.col("text")).cast("binary")).alias("digest"), F.regexp_count("text", F.lit(text.EMAIL)).cast("long").alias("emails"))


@query(rf"""SELECT doc_id AS id, regexp_matches(text, '{text.any_of(text.SECRET_LIKE)}') AS secret, regexp_matches(text, '(?i)\b(stdout|stderr|exit\s*code|traceback|stack\s*trace)\b|\b(tool[_\s-]?call|tool[_\s-]?result|command output)\b') AS tool_output FROM documents""")
def str_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.col("text").rlike(r"(?i)\b(stdout|stderr|exit\s*code|traceback|stack\s*trace)\b|\b(tool[_\s-]?call|tool[_\s-]?result|command output)\b")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.looks_secret(F.col("text")).alias("secret"), tool.alias("tool_output"))


@query("""SELECT doc_id AS id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens, CASE WHEN length(f) <= 120 THEN f ELSE rtrim(substr(f, 1, 119), ' ') || '…' END AS preview FROM (SELECT doc_id, text, trim(regexp_replace(text, '\n', ' ', 'g'), ' ') AS f FROM documents)""")
def str_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.token_estimate(F.col("text")).alias("tokens"), text.preview(F.col("text")).alias("preview"))


@query(r"""SELECT page_id AS id, CASE WHEN contains(u, 'decision') THEN 'decision' WHEN contains(u, 'log') THEN 'log' WHEN contains(u, 'spec') THEN 'spec' WHEN contains(u, 'roadmap') THEN 'roadmap' ELSE 'doc' END AS doc_kind,
    nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '') AS path, sha1(page_id || chr(10) || url || chr(10) || html) AS content_hash FROM (SELECT *, lower(url) AS u FROM pages)""")
def str_doc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.lower("url")
    kind = F.when(F.contains(u, F.lit("decision")), "decision").when(F.contains(u, F.lit("log")), "log").when(F.contains(u, F.lit("spec")), "spec").when(F.contains(u, F.lit("roadmap")), "roadmap").otherwise("doc")
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), kind.alias("doc_kind"), part("^[a-z]+://([^/?#]+)").alias("host"), part("^[a-z]+://[^/?#]+(/[^?#]*)").alias("path"), F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), "url", "html").cast("binary")).alias("content_hash"))


@query(r"""WITH p AS (SELECT o_orderkey AS id, trim(CASE o_orderkey % 6 WHEN 0 THEN 'docs/a.md#L' || o_custkey WHEN 1 THEN 'docs/b.md#L9-L' || (o_custkey % 20) WHEN 2 THEN 'https://x.example/' || o_custkey WHEN 3 THEN 'receipt:' || o_custkey WHEN 4 THEN ' notes.md#part-' || o_custkey || ' ' ELSE o_comment END) AS t FROM (SELECT *, CASE WHEN o_orderkey % 12 = 5 THEN '' ELSE 'free text ' || o_orderpriority END AS o_comment FROM orders))
    SELECT id, kind, CASE WHEN kind IN ('file_line', 'file_anchor') THEN regexp_extract(t, '^([^#]+)#', 1) END AS path, CASE WHEN kind = 'file_line' THEN a END AS line_start, CASE WHEN kind = 'file_line' THEN greatest(a, coalesce(b, a)) END AS line_end, CASE WHEN kind = 'file_anchor' THEN regexp_extract(t, '#(.*)$', 1) END AS anchor
    FROM (SELECT *, CASE WHEN t = '' THEN 'none' WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN 'url' WHEN regexp_matches(t, '^[^#]+#L\d+(-L?\d+)?$') THEN 'file_line' WHEN regexp_matches(t, '^[^#]+#[^\s#]+$') THEN 'file_anchor' WHEN regexp_matches(t, '^(receipt:|graph_refresh_receipt:)\S+$') THEN 'receipt' ELSE 'opaque' END AS kind,
    TRY_CAST(regexp_extract(t, '#L(\d+)', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(t, '#L\d+-L?(\d+)$', 1) AS INTEGER) AS b FROM p)""")
def str_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("docs/a.md#L"), c)).when(k % 6 == 1, F.concat(F.lit("docs/b.md#L9-L"), c % 20)).when(k % 6 == 2, F.concat(F.lit("https://x.example/"), c)).when(k % 6 == 3, F.concat(F.lit("receipt:"), c))
        .when(k % 6 == 4, F.concat(F.lit(" notes.md#part-"), c, F.lit(" "))).when(k % 12 == 5, "").otherwise(F.concat(F.lit("free text "), "o_orderpriority"))
    )
    ref = table(spark, sf_dir, "orders").select(k.alias("id"), text.provenance(raw).alias("r"))
    return ref.select("id", "r.kind", "r.path", "r.line_start", "r.line_end", "r.anchor")


@query("""WITH raw AS (SELECT doc_id AS id, CASE doc_id % 8 WHEN 0 THEN '0.' || (doc_id % 97) WHEN 1 THEN (doc_id % 101)::VARCHAR WHEN 2 THEN (doc_id % 101) || '%' WHEN 3 THEN (doc_id % 101) || '/100' WHEN 4 THEN ' Must-Remember ' WHEN 5 THEN 'low' WHEN 6 THEN 'nice to have' ELSE lang END AS t FROM documents),
    s AS (SELECT id, lower(trim(t)) AS t FROM raw), v AS (SELECT id, CASE WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]+)?%$') THEN CAST(rtrim(t, '%') AS DOUBLE) / 100 WHEN regexp_matches(t, '^[0-9]+/100$') THEN CAST(split_part(t, '/', 1) AS DOUBLE) / 100
    WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]+)?$') THEN CASE WHEN CAST(t AS DOUBLE) > 1 AND CAST(t AS DOUBLE) <= 100 AND CAST(t AS DOUBLE) = floor(CAST(t AS DOUBLE)) THEN CAST(t AS DOUBLE) / 100 ELSE CAST(t AS DOUBLE) END
    WHEN replace(replace(t, '-', '_'), ' ', '_') IN ('ignore', 'low') THEN 0 WHEN replace(replace(t, '-', '_'), ' ', '_') IN ('nice_to_have', 'medium') THEN 0.5 WHEN replace(replace(t, '-', '_'), ' ', '_') IN ('must_remember', 'high') THEN 0.8 END::DOUBLE AS score FROM s)
    SELECT id, CASE WHEN score IS NOT NULL THEN round(least(1, score), 9) END::DOUBLE AS score, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.8 THEN 'must_remember' WHEN score >= 0.5 THEN 'nice_to_have' ELSE 'ignore' END AS label FROM v""")
def mth_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = (
        F.when(i % 8 == 0, F.concat(F.lit("0."), i % 97)).when(i % 8 == 1, (i % 101).cast("string")).when(i % 8 == 2, F.concat(i % 101, F.lit("%"))).when(i % 8 == 3, F.concat(i % 101, F.lit("/100")))
        .when(i % 8 == 4, " Must-Remember ").when(i % 8 == 5, "low").when(i % 8 == 6, "nice to have").otherwise(F.col("lang"))
    )
    score = scoring.parse_importance(raw)
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.round(score, 9).alias("score"), scoring.label_of(score).alias("label"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, (l_orderkey % 5)::DOUBLE AS ev, (l_partkey % 4)::DOUBLE AS sh, (l_suppkey % 10) / 10.0::DOUBLE AS rec, l_discount * 5 AS lex, (l_linenumber)::DOUBLE AS tok FROM lineitem)
    SELECT id, line, round(least(0.95, round(0.62 + round(0.16 * least(1, ev / 3), 3) + round(0.12 * least(1, sh / 2), 3) + round(0.08 * least(1, rec), 3) + round(0.07 * least(1, lex), 3) + round(0.05 * least(1, tok / 4), 3), 3)), 3)::DOUBLE AS confidence FROM p""")
def mth_link_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    c = scoring.link_confidence("receipt_co_selection", (F.col("l_orderkey") % 5).cast("double"), (F.col("l_partkey") % 4).cast("double"), F.col("l_suppkey") % 10 / 10.0, F.col("l_discount") * 5, F.col("l_linenumber").cast("double"))
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), c.alias("confidence"))


@query(f"""SELECT ref, round(sum(pow(2.0::DOUBLE, -date_diff('day', ts, TIMESTAMP '{NOW}') / 30.0::DOUBLE)), 6) AS recency, max(date_diff('day', ts, TIMESTAMP '{NOW}'))::BIGINT AS oldest_days FROM receipts GROUP BY ref""")
def mth_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each reference, halved for every thirty days of age."""
    days = F.datediff(now(), F.col("ts"))
    return receipts(spark, sf_dir).groupBy("ref").agg(F.round(F.sum(F.pow(F.lit(2.0), -days / 30.0)), 6).alias("recency"), F.max(days).cast("long").alias("oldest_days"))


@query("""SELECT e.event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid, count(*) AS n FROM events e GROUP BY 1, 2, 3""")
def jsn_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(v, "$.k", "bigint").alias("k"), v.isNotNull().alias("valid"))
    return e.groupBy("event_type", "k", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, sum(k)::BIGINT AS total, count(DISTINCT event_type) AS types, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM (SELECT user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 0 GROUP BY user_id""")
def map_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type as a map for each user, and the sum of its values."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")).where("k >= 0")
    by_type = e.groupBy("user_id", "event_type").agg(F.sum("k").alias("k"))
    m = by_type.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "k"))).alias("m"))
    return m.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("m").cast("long").alias("types"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


@query(r"""SELECT event_id, CASE WHEN regexp_matches(t, '(?i)^\s*([-*+]|\d+[.)])?\s*(todo|task|reminder)\b') THEN 'task' WHEN contains(t, '?') THEN 'question' ELSE 'other' END AS class, len(string_split(t, chr(10)))::BIGINT AS lines FROM (SELECT event_id, summary AS t FROM turns)""")
def str_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("summary")
    kind = F.when(t.rlike(r"(?i)^\s*([-*+]|\d+[.)])?\s*(todo|task|reminder)\b"), "task").when(F.contains(t, F.lit("?")), "question").otherwise("other")
    return turns(spark, sf_dir).select("event_id", kind.alias("class"), F.size(F.split(t, "\n")).cast("long").alias("lines"))


@query(r"""SELECT doc_id AS id, len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(?i)\b(error|warn|fail|password|license)'))::VARCHAR[])::BIGINT AS anomalies, md5(array_to_string(lines[1:3], chr(10))) AS head, md5(array_to_string(lines[-3:], chr(10))) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def str_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in short: how many lines, how many that stand out, and digests of its first and last three."""
    lines = F.split("text", "\n")
    odd = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)\b(error|warn|fail|password|license)"))).cast("long")
    tail = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3)
    digest = lambda xs: F.md5(F.array_join(xs, "\n").cast("binary"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(lines).cast("long").alias("n_lines"), odd.alias("anomalies"), digest(F.slice(lines, 1, 3)).alias("head"), digest(tail).alias("tail"))


@query(r"""WITH o AS (SELECT id, kind, lower(summary) AS t FROM observations), f AS (SELECT id, regexp_matches(t, '(prefer|always|never|must|should|do not|required|rule|policy)') AS a, regexp_matches(t, '(decide|decision|chose|we will|mvp|scope|architecture)') AS b, regexp_matches(t, 'https?://\S+') AS c, regexp_matches(t, '(cron|how to|python -m)') AS d,
    regexp_matches(t, '(error|failed|exception|traceback|timeout|unauthorized|forbidden)') AS e, regexp_matches(t, '\b(lol|thanks|thx|ok|got it|nice)\b') AS g, regexp_matches(t, '(done|finished|pushed|merged|wip)') AS h FROM o)
    SELECT id, round(least(1, greatest(0, 0.30::DOUBLE + CASE WHEN a THEN 0.40 ELSE 0 END + CASE WHEN b THEN 0.30 ELSE 0 END + CASE WHEN c THEN 0.20 ELSE 0 END + CASE WHEN d THEN 0.20 ELSE 0 END + CASE WHEN e THEN 0.15 ELSE 0 END - CASE WHEN g THEN 0.25 ELSE 0 END - CASE WHEN h AND NOT (c OR e) THEN 0.20 ELSE 0 END)), 6)::DOUBLE AS score FROM f""")
def str_heuristic_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance from wording: signals add to or take from a base of 0.30."""
    t = F.lower("summary")
    has = lambda p: t.rlike(p)
    link, error = has(r"https?://\S+"), has("(error|failed|exception|traceback|timeout|unauthorized|forbidden)")
    signals = (
        (has("(prefer|always|never|must|should|do not|required|rule|policy)"), 0.40), (has("(decide|decision|chose|we will|mvp|scope|architecture)"), 0.30), (link, 0.20), (has("(cron|how to|python -m)"), 0.20),
        (error, 0.15), (has(r"\b(lol|thanks|thx|ok|got it|nice)\b"), -0.25), (has("(done|finished|pushed|merged|wip)") & ~(link | error), -0.20),
    )
    total = sum((F.when(c, w).otherwise(0.0) for c, w in signals), F.lit(0.30))
    return observations(spark, sf_dir).select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6).alias("score"))
