"""Predicates, joins and set comparisons over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import graph
from ..operators.ranking import best
from .registry import query
from .views import NOW, edges, facts, nodes, now, observations, receipts, table, turns, vectors

_TOKENS = r"list_filter(list_distinct(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{{3,}}|[一-鿿]{{2,}}')), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "], x))"


@query("SELECT scope, id FROM observations WHERE trim(lower(scope)) = 'src3'")
def flt_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(text.scope_token(F.col("scope")) == "src3").select("scope", "id")


@query("SELECT id, state FROM observations WHERE state <> 'soft-archived' AND NOT quarantined")
def flt_retrievable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither archived nor quarantined."""
    return observations(spark, sf_dir).where("state <> 'soft-archived' and not quarantined").select("id", "state")


@query("SELECT o.id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations n WHERE n.id % 10 = 9 AND n.id - 7 = o.id)")
def flt_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no other row replaces; here every row that ends in 9 replaces the one seven before it."""
    o = observations(spark, sf_dir)
    replaced = o.where("id % 10 = 9").select((F.col("id") - 7).alias("id"))
    return o.select("id").join(replaced, "id", "left_anti")


@query("""SELECT id, score FROM (SELECT id, -1.0::DOUBLE * (CASE WHEN contains(lower(summary), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(summary), 'license') THEN 1 ELSE 0 END) AS score,
    contains(lower(summary), 'the') AND contains(lower(summary), 'license') AS hit FROM observations) WHERE hit""")
def flt_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of a plain query as substrings; the score is minus the number of terms."""
    has = [F.contains(F.lower("summary"), F.lit(t)) for t in ("the", "license")]
    score = -1.0 * sum((F.when(h, 1).otherwise(0) for h in has), F.lit(0))
    return observations(spark, sf_dir).where(has[0] & has[1]).select("id", score.cast("double").alias("score"))


@query(f"SELECT event_id, session_id, turn, type FROM turns WHERE type IN ('conversation.user', 'conversation.assistant') AND ts BETWEEN TIMESTAMP '{NOW}' - to_days(60) AND TIMESTAMP '{NOW}' - to_days(10)")
def flt_episodic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = lambda d: F.timestamp_seconds(F.unix_timestamp(now()) - d * 86400)
    return turns(spark, sf_dir).where(F.col("type").isin("conversation.user", "conversation.assistant") & F.col("ts").between(back(60), back(10))).select("event_id", "session_id", "turn", "type")


@query("SELECT node_id, node_type FROM nodes WHERE node_type = 'customer' AND tag <> 'BUILDING' OR tag = 'supply'")
def flt_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("node_type = 'customer' and tag <> 'BUILDING' or tag = 'supply'").select("node_id", "node_type")


@query("SELECT src, dst, type FROM edges WHERE starts_with(provenance, 'supplier.md#')")
def flt_provenance_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("provenance").startswith("supplier.md#")).select("src", "dst", "type")


@query(f"SELECT id, CASE WHEN last_used < TIMESTAMP '{NOW}' - to_days(20) THEN 'stale' ELSE 'fresh' END AS freshness FROM observations")
def flt_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale if last used over twenty days ago; an unknown time isn't stale."""
    stale = F.coalesce(F.col("last_used") < F.timestamp_seconds(F.unix_timestamp(now()) - 20 * 86400), F.lit(False))
    return observations(spark, sf_dir).select("id", F.when(stale, "stale").otherwise("fresh").alias("freshness"))


@query("""SELECT event_id, CASE WHEN regexp_matches(t, '^/[a-z]+') THEN 'command' WHEN regexp_matches(t, '^(hi|hello|hey|thanks|thank you|ok|okay|yes|no)[.!? ]*$') THEN 'greeting' WHEN length(t) < 3 THEN 'short' ELSE 'ask' END AS class
    FROM (SELECT event_id, lower(trim(summary)) AS t FROM turns)""")
def flt_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that need no recall: commands, greetings and very short ones."""
    t = F.lower(F.trim("summary"))
    kind = F.when(t.rlike("^/[a-z]+"), "command").when(t.rlike("^(hi|hello|hey|thanks|thank you|ok|okay|yes|no)[.!? ]*$"), "greeting").when(F.length(t) < 3, "short").otherwise("ask")
    return turns(spark, sf_dir).select("event_id", kind.alias("class"))


@query("SELECT id FROM observations o WHERE id NOT IN (SELECT id FROM vectors)")
def jon_unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id").join(vectors(spark, sf_dir).select("id"), "id", "left_anti")


@query("SELECT o.id, v.id IS NULL AS missing FROM observations o LEFT JOIN vectors v ON v.id = o.id WHERE v.id IS NULL OR v.model <> o.id % 10")
def jon_embedding_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a vector or with one of another model than they should have."""
    v = vectors(spark, sf_dir).select(F.col("id").alias("v"), "model")
    return observations(spark, sf_dir).select("id").join(v, F.col("id") == F.col("v"), "left").where("v is null or model <> id % 10").select("id", F.col("v").isNull().alias("missing"))


@query("""WITH r AS (SELECT node_id, CASE WHEN k % 50 = 0 THEN 'error' WHEN k % 31 = 0 THEN 'stale' ELSE 'ok' END AS status FROM (SELECT 'customer:' || c_custkey AS node_id, c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'runtime:' || s_suppkey, s_suppkey FROM supplier))
    SELECT coalesce(n.node_id, r.node_id) AS node_id, r.status, CASE WHEN r.node_id IS NULL THEN 'missing_in_runtime' WHEN n.node_id IS NULL THEN 'runtime_only' WHEN r.status IN ('stale', 'error', 'missing') THEN 'non_ok' ELSE 'ok' END AS finding
    FROM (SELECT node_id FROM nodes WHERE node_type = 'customer') n FULL JOIN r ON r.node_id = n.node_id""")
def jon_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topology's customers against a runtime report made from the same keys."""
    status = lambda k: F.when(k % 50 == 0, "error").when(k % 31 == 0, "stale").otherwise("ok")
    report = lambda name, key, kind: table(spark, sf_dir, name).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("node_id"), status(F.col(key)).alias("status"), F.col(key).alias("position"), F.col(key).alias("k"))
    runtime = report("customer", "c_custkey", "customer:").where("k % 7 <> 0").unionByName(report("supplier", "s_suppkey", "runtime:"))
    return graph.drift(nodes(spark, sf_dir).where("node_type = 'customer'"), runtime)


@query("""WITH c AS (SELECT CASE WHEN node_type = 'part' AND hash_key % 9 = 0 THEN node_id || ':old' ELSE node_id END AS node_id, node_type, CASE WHEN hash_key % 5 = 0 THEN 'changed' ELSE tag END AS tag FROM (SELECT *, CAST(split_part(node_id, ':', 2) AS BIGINT) AS hash_key FROM nodes) WHERE hash_key % 23 <> 1)
    SELECT coalesce(s.node_id, c.node_id) AS node_id, CASE WHEN c.node_id IS NULL THEN 'missing' WHEN s.node_id IS NULL THEN 'stale' ELSE 'contract_mismatch' END AS finding FROM nodes s FULL JOIN c ON s.node_id = c.node_id
    WHERE c.node_id IS NULL OR s.node_id IS NULL OR s.node_type IS DISTINCT FROM c.node_type OR s.tag IS DISTINCT FROM c.tag""")
def jon_node_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph against an edited copy of it: some nodes gone, renamed or with another tag."""
    seed = nodes(spark, sf_dir)
    k = F.split("node_id", ":")[1].cast("long")
    curated = seed.where(k % 23 != 1).select(F.when((F.col("node_type") == "part") & (k % 9 == 0), F.concat("node_id", F.lit(":old"))).otherwise(F.col("node_id")).alias("node_id"), "node_type", F.when(k % 5 == 0, "changed").otherwise(F.col("tag")).alias("tag"))
    return graph.node_diff(seed, curated)


@query("""WITH c AS (SELECT src, dst, CASE WHEN type = 'placed_by' AND length(src) % 3 = 0 THEN 'ordered_by' ELSE type END AS type, CASE WHEN ends_with(src, '7') THEN provenance || '0' ELSE provenance END AS provenance FROM edges),
    a AS (SELECT src, dst, type, list_sort(list(provenance)) AS p FROM edges GROUP BY 1, 2, 3), b AS (SELECT src, dst, type, list_sort(list(provenance)) AS p FROM c GROUP BY 1, 2, 3)
    SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.type, b.type) AS type, CASE WHEN b.p IS NULL THEN 'missing' WHEN a.p IS NULL THEN 'stale' ELSE 'contract_mismatch' END AS finding
    FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst AND a.type = b.type WHERE a.p IS DISTINCT FROM b.p""")
def jon_edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = edges(spark, sf_dir)
    kind = F.when((F.col("type") == "placed_by") & (F.length("src") % 3 == 0), "ordered_by").otherwise(F.col("type"))
    curated = seed.select("src", "dst", kind.alias("type"), F.when(F.col("src").endswith("7"), F.concat("provenance", F.lit("0"))).otherwise(F.col("provenance")).alias("provenance"))
    return graph.edge_diff(seed, curated)


@query("""SELECT l.subject, l.predicate, l.fact_id AS fact_id, r.fact_id AS other_id FROM facts l JOIN facts r ON l.subject = r.subject AND l.predicate = r.predicate AND l.fact_id < r.fact_id
    AND (l.valid_to IS NULL OR r.valid_from < l.valid_to) AND (r.valid_to IS NULL OR l.valid_from < r.valid_to) WHERE l.status = 'active' AND r.status = 'active'""")
def jon_interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts of one subject and single-valued predicate whose intervals overlap; touching ones don't."""
    f = facts(spark, sf_dir).where("status = 'active'")
    l, r = f.alias("l"), f.alias("r")  # noqa: E741
    overlap = (F.col("l.valid_to").isNull() | (F.col("r.valid_from") < F.col("l.valid_to"))) & (F.col("r.valid_to").isNull() | (F.col("l.valid_from") < F.col("r.valid_to")))
    on = (F.col("l.subject") == F.col("r.subject")) & (F.col("l.predicate") == F.col("r.predicate")) & (F.col("l.fact_id") < F.col("r.fact_id"))
    return l.join(r, on & overlap).select("l.subject", "l.predicate", "l.fact_id", F.col("r.fact_id").alias("other_id"))


@query("""SELECT o.o_orderkey AS order_id, f.fact_id, f.object FROM orders o JOIN facts f ON f.subject = 'customer:' || o.o_custkey AND f.valid_from <= CAST(o.o_orderdate AS TIMESTAMP) - to_days(90)
    AND (f.valid_to IS NULL OR CAST(o.o_orderdate AS TIMESTAMP) - to_days(90) < f.valid_to) WHERE f.status NOT IN ('superseded', 'invalidated', 'retracted', 'stale')""")
def jon_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that held ninety days before each order: an equality on the subject and a range on time."""
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - 90 * 86400)
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("who"), at.alias("at"))
    f = facts(spark, sf_dir).where("status not in ('superseded', 'invalidated', 'retracted', 'stale')")
    held = (F.col("subject") == F.col("who")) & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return f.join(asked, held).select("order_id", "fact_id", "object")


#: Tokens of turns that are in no more than four fifths of all turns (three at least), and all links by two of them.
USEFUL_TOKENS_SQL = f"""t AS (SELECT session_id, event_id, scope, unnest({_TOKENS.format('summary')}) AS token FROM turns), top AS (SELECT greatest(3, floor(count(*) * 0.80)) AS top FROM turns),
    useful AS (SELECT t.* FROM t JOIN (SELECT token, count(*) AS df FROM t GROUP BY 1) USING (token) CROSS JOIN top WHERE df <= top)"""
TOKEN_LINKS_SQL = f"""{USEFUL_TOKENS_SQL}, links AS (SELECT a.event_id AS left_id, b.event_id AS right_id, count(*) AS shared FROM useful a JOIN useful b
    ON a.scope = b.scope AND a.token = b.token AND a.event_id < b.event_id AND a.session_id <> b.session_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def useful_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, event_id, scope, token): distinct tokens of each turn that are in four fifths of all turns at most (three at least)."""
    u = turns(spark, sf_dir)
    t = u.select("session_id", "event_id", "scope", F.explode(text.token_set(F.col("summary"))).alias("token"))
    top = u.agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * 0.80)).alias("top"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(top)).where("df <= top").select("token")  # one row
    return t.join(df, "token", "left_semi")


#: Frequent tokens of an event that stars are drawn around, and pairs of events that a task counts.
FREQUENT, PAIRS_A_TASK = 8, 2_000_000


def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, session_id, event_id, token, n): the useful tokens that two sessions of a scope have or more, as a number for each scope and token, and how many turns of the scope have it; written once."""
    graph.ensure_checkpoint_dir(spark)
    u = turns(spark, sf_dir)
    t = u.select("session_id", "event_id", "scope", F.explode(text.token_set(F.col("summary"))).alias("word"))
    top = u.agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * 0.80)).alias("top"))
    counts = t.groupBy("scope", "word").agg(F.count(F.lit(1)).alias("n"), F.min("session_id").alias("s0"), F.max("session_id").alias("s1")).checkpoint()
    useful = counts.groupBy(F.col("word").alias("w")).agg(F.sum("n").alias("df")).crossJoin(F.broadcast(top)).where("df <= top").select("w")  # one row
    # Written, so that a number stays with its word.
    numbers = counts.where("s0 < s1").join(useful, F.col("word") == F.col("w"), "left_semi").select("scope", "word", "n", F.monotonically_increasing_id().alias("token")).checkpoint()
    return t.join(numbers, ["scope", "word"]).select("scope", "session_id", "event_id", "token", "n").checkpoint()


@query(f"""WITH {USEFUL_TOKENS_SQL} SELECT a.event_id, b.event_id AS other_id, count(*) AS shared FROM useful a JOIN useful b
    ON a.scope = b.scope AND a.token = b.token AND a.session_id <> b.session_id WHERE a.session_id % 100 = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def jon_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of other sessions of the scope that share two useful tokens or more with an event of an asked session (ids divisible by 100).

    The asked events meet all others by token; a token in many events is a skewed key of a plain join, which adaptive execution splits.
    The pairs, which grow with the square of the events, are counted in as many tasks as they need at ``PAIRS_A_TASK`` each.
    """
    t = shared_tokens(spark, sf_dir)
    here = F.col("session_id") % 100 == 0
    asked = t.where(here).select("token", F.col("event_id").alias("asked"), F.col("session_id").alias("own"))
    n = t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(here).alias("asked")).agg(F.sum(F.col("n") * F.col("asked"))).first()[0] or 0
    # Nearly every row of a token is another pair, so nothing is counted before the rows of a pair meet.
    pairs = t.join(asked, "token").where("own <> session_id").select("asked", "event_id").repartition(n // PAIRS_A_TASK + 1, "asked", "event_id")
    return pairs.groupBy(F.col("asked").alias("event_id"), F.col("event_id").alias("other_id")).agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


def token_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, label): connected components of all links by two shared useful tokens, without the links.

    The events that have the same two tokens are one component if they are of two sessions, since each is linked to all of
    other sessions; so a star stands for their links. An event's id is of one session.

    1. Stars around the pairs of each event's ``FREQUENT`` most frequent tokens give most components, with work in proportion to events.
    2. A link that is still missing joins two components, so its tokens are held in both, and one of its ends lies outside the
       largest of its scope. All pairs of such tokens of these events, each once, are looked for among the events that have the rarer of the two.
    """
    t = shared_tokens(spark, sf_dir).where("event_id is not null")
    top = best(t.select("event_id", "session_id", "token", "n"), FREQUENT, by=[F.col("n").desc(), F.col("token")], groups=["event_id"])
    held = top.groupBy("event_id").agg(F.min("session_id").alias("session_id"), F.sort_array(F.collect_list("token")).alias("x"))
    each = held.select("event_id", "session_id", F.explode(F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, FREQUENT), lambda b: F.struct(a.alias("p"), b.alias("q")))))).alias("y")).select("event_id", "session_id", "y.*").checkpoint()
    stars = each.groupBy("p", "q").agg(F.min("event_id").alias("to"), F.min("session_id").alias("s0"), F.max("session_id").alias("s1")).where("s0 < s1").select("p", "q", "to")
    labels = graph.components(each.join(stars, ["p", "q"]).select(F.col("event_id").alias("a"), F.col("to").alias("b")).union(_links_by_repeats(t)).where("a <> b").distinct())
    owned = t.select("scope", "session_id", "event_id", "token", "n").join(labels, F.col("event_id") == F.col("node"), "left").select("scope", "session_id", "event_id", "token", "n", F.coalesce("label", "event_id").alias("label")).checkpoint()
    sizes = owned.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("m")).groupBy(F.col("scope").alias("s")).agg(F.max_by("label", F.struct("m", "label")).alias("largest"))
    open_ = owned.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("token")
    rest = owned.join(open_, "token").checkpoint()
    strays = rest.join(sizes, F.col("scope") == F.col("s")).where("label <> largest").select("event_id", "token", "n")
    other = strays.select("event_id", F.col("token").alias("q"), F.col("n").alias("m"))
    asked = strays.join(other, "event_id").where("n < m or n = m and token < q").select("token", "q").distinct()
    found = rest.select("token", "event_id", "session_id", "label").join(asked, "token").join(rest.select("event_id", F.col("token").alias("q")), ["event_id", "q"])
    met = found.groupBy("token", "q", "label").agg(F.min("session_id").alias("s0"), F.max("session_id").alias("s1")).checkpoint()
    low = met.groupBy("token", "q").agg(F.min("label").alias("low"), F.min("s0").alias("s0"), F.max("s1").alias("s1")).where("s0 < s1").select("token", "q", "low")
    missing = met.join(low, ["token", "q"]).where("label <> low").select(F.col("label").alias("a"), F.col("low").alias("b")).distinct().checkpoint()
    if missing.isEmpty():
        return labels
    joined = graph.components(missing).select(F.col("node").alias("was"), F.col("label").alias("now"))
    alone = joined.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return labels.join(joined, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")).union(alone)


def _links_by_repeats(t: DataFrame) -> DataFrame:
    """Links (a, b) that one token makes alone: an event told twice has it twice, which counts as two shared ones."""
    each = t.groupBy("token", "event_id", "session_id").agg(F.count(F.lit(1)).alias("times"))
    twice = lambda c: F.when(F.col("times") > 1, F.col(c))
    again = each.groupBy("token").agg(
        F.min(twice("event_id")).alias("to"), F.min(twice("session_id")).alias("s0"), F.max(twice("session_id")).alias("s1"), (F.min("session_id") < F.max("session_id")).alias("linked")
    ).where("linked and to is not null").select("token", "to", "s0", "s1")
    return each.join(again, "token").where("times > 1 or s0 < s1 or session_id <> s0").select(F.col("event_id").alias("a"), F.col("to").alias("b"))


@query("""WITH r AS (SELECT DISTINCT receipt_id, ref, ts FROM (SELECT receipt_id, ref, max(ts) AS ts FROM receipts GROUP BY 1, 2)) SELECT a.ref AS left_ref, b.ref AS right_ref, count(*) AS n, CAST(epoch(max(greatest(a.ts, b.ts))) AS BIGINT) AS last_ts
    FROM r a JOIN r b ON a.receipt_id = b.receipt_id AND a.ref < b.ref GROUP BY 1, 2 HAVING count(*) >= 2""")
def jon_co_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that were selected together at least twice; a receipt names a handful of references."""
    r = receipts(spark, sf_dir).groupBy("receipt_id", "ref").agg(F.max("ts").alias("ts"))
    a, b = r.alias("a"), r.alias("b")
    pairs = a.join(b, (F.col("a.receipt_id") == F.col("b.receipt_id")) & (F.col("a.ref") < F.col("b.ref")))
    return pairs.groupBy(F.col("a.ref").alias("left_ref"), F.col("b.ref").alias("right_ref")).agg(F.count(F.lit(1)).alias("n"), F.unix_timestamp(F.max(F.greatest("a.ts", "b.ts"))).alias("last_ts")).where("n >= 2")


@query("""SELECT n.node_id, least(coalesce(e.n, 0) * 0.25, 1.0)::DOUBLE AS bonus FROM nodes n LEFT JOIN (SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM edges WHERE contains(type, 'located') UNION ALL SELECT dst FROM edges WHERE contains(type, 'located')) GROUP BY 1) e ON e.node_id = n.node_id WHERE n.node_type IN ('nation', 'customer')""")
def jon_edge_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter for each edge of a node whose text has the asked token, one at most."""
    hit = edges(spark, sf_dir).where(F.contains("type", F.lit("located")))
    n = hit.select(F.col("src").alias("e")).union(hit.select("dst")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    return nodes(spark, sf_dir).where("node_type in ('nation', 'customer')").join(n, F.col("node_id") == F.col("e"), "left").select("node_id", F.least(F.coalesce("n", F.lit(0)) * 0.25, F.lit(1.0)).cast("double").alias("bonus"))


@query(f"""SELECT d.doc_id AS id, s.id IS NOT NULL AS present FROM (SELECT doc_id, lower(trim(source)) || chr(9) || text AS sig FROM documents WHERE doc_id % 3 = 0) d LEFT JOIN (SELECT min(doc_id) AS id, lower(trim(source)) || chr(9) || text AS sig FROM documents WHERE doc_id % 3 <> 0 GROUP BY 2) s ON s.sig = d.sig""")
def jon_capsule_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items of a bundle a store already holds, by kind and text; digests are joined, not texts."""
    sig = F.md5(F.concat_ws("\t", F.lower(F.trim("source")), "text").cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", sig.alias("sig"))
    store = d.where("doc_id % 3 <> 0").groupBy("sig").agg(F.min("doc_id").alias("s"))
    return d.where("doc_id % 3 = 0").join(store, "sig", "left").select(F.col("doc_id").alias("id"), F.col("s").isNotNull().alias("present"))


@query("SELECT kind, name, n FROM (SELECT 'shared' AS kind, l_shipmode AS name, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode FROM lineitem WHERE l_quantity > 25 INTERSECT SELECT l_returnflag FROM lineitem WHERE l_quantity <= 25) GROUP BY 2 UNION ALL SELECT 'only_left', CAST(p AS VARCHAR), count(*) FROM (SELECT l_partkey AS p FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity <= 30) GROUP BY 2)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INTERSECT and EXCEPT of keys from two parts of a table."""
    li = table(spark, sf_dir, "lineitem")
    shared = li.where("l_quantity > 25").select("l_returnflag").intersect(li.where("l_quantity <= 25").select("l_returnflag"))
    only = li.where("l_quantity > 45").select("l_partkey").subtract(li.where("l_quantity <= 30").select("l_partkey"))
    one = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name"), F.lit(1).cast("long").alias("n"))
    return one(shared, "shared", "l_returnflag").unionByName(one(only, "only_left", "l_partkey"))


@query("SELECT src, dst, type, min(provenance) AS provenance, count(*) AS n FROM edges GROUP BY 1, 2, 3")
def set_edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("src", "dst", "type").agg(F.min("provenance").alias("provenance"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT o.id, 'stale' AS to_state, o.state IN ('active', 'consolidated') AS legal FROM observations o WHERE o.state <> 'stale' AND date_diff('second', o.ts, TIMESTAMP '{NOW}') >= 180 * 86400""")
def pck_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed changes of state, each with whether the lifecycle allows it."""
    legal = spark.createDataFrame(scoring.TRANSITIONS, "state string, to_state string").withColumn("legal", F.lit(True))
    asked = observations(spark, sf_dir).where((F.col("state") != "stale") & (scoring.unused_days(F.col("ts"), now()) >= 180)).select("id", "state", F.lit("stale").alias("to_state"))
    return asked.join(F.broadcast(legal), ["state", "to_state"], "left").select("id", "to_state", F.coalesce("legal", F.lit(False)).alias("legal"))


@query("SELECT a.id AS id, b.id AS near_id FROM observations a JOIN observations b ON b.id BETWEEN a.id - 2 AND a.id + 2 WHERE a.id % 100 = 0")
def cli_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows within two of each asked id (those divisible by 100), as an equality on the shifted id."""
    o = observations(spark, sf_dir).select("id")
    asked = o.where("id % 100 = 0").select(F.col("id").alias("asked"), F.explode(F.sequence(F.col("id") - 2, F.col("id") + 2)).alias("id"))
    return asked.join(o, "id").select(F.col("asked").alias("id"), F.col("id").alias("near_id"))


@query(f"SELECT doc_id AS id, list_sort({_TOKENS.format('text')})[1] AS first_token, len({_TOKENS.format('text')}) AS n FROM documents")
def str_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_sort(text.token_set(F.col("text")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.get(tokens, F.lit(0)).alias("first_token"), F.size(tokens).cast("long").alias("n"))


@query("""SELECT user_id, ts, prev_type, event_type FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type FROM events) WHERE prev_type IS DISTINCT FROM event_type""")
def win_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event whose type differs from the one before it of the same user."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("ts"), "event_type", before.alias("prev_type"))
    return e.where(~F.col("prev_type").eqNullSafe(F.col("event_type"))).select("user_id", "ts", "prev_type", "event_type")
