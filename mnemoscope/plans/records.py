"""Record keeping: imports, triage, traces, write-back, routing and small selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import graph, lexical, ranking, trigrams
from ..sources.sinks import TRUST_RANK
from .registry import query
from .retrieval import BM25_SQL, lexical_lane
from .views import NOW, edges, facts, nodes, now, observations, receipts, table, turns

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("""SELECT i.doc_id AS id, CASE WHEN s.doc_id IS NOT NULL THEN 'skipped_id' WHEN t.k IS NOT NULL THEN 'skipped_text' ELSE 'imported' END AS outcome FROM documents i LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 = 0) s ON s.doc_id = i.doc_id
    LEFT JOIN (SELECT DISTINCT md5(trim(text)) AS k FROM documents WHERE doc_id % 5 = 0) t ON t.k = md5(trim(i.text))""")
def src_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of some records would do to a store that holds others: known ids and known texts are skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.trim("text").cast("binary")).alias("k"))
    store = d.where("doc_id % 5 = 0")
    ids, texts = store.select(F.col("doc_id").alias("s")), store.select(F.col("k").alias("t")).distinct()
    joined = d.join(ids, F.col("doc_id") == F.col("s"), "left").join(texts, F.col("k") == F.col("t"), "left")
    return joined.select(F.col("doc_id").alias("id"), F.when(F.col("s").isNotNull(), "skipped_id").when(F.col("t").isNotNull(), "skipped_text").otherwise("imported").alias("outcome"))


@query("""SELECT event_id AS id, event_type, value FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-25' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)""")
def cli_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors since a time that no earlier triage has seen."""
    e = table(spark, sf_dir, "events")
    fresh = e.where((F.col("event_type") == "error") & (F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))))
    return fresh.join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").select(F.col("event_id").alias("id"), "event_type", "value")


@query("SELECT p.ask, p.pos, o.id, o.kind FROM (SELECT c_custkey AS ask, unnest([c_custkey % 97, c_custkey % 13, c_custkey % 200]) AS id, unnest([0, 1, 2]) AS pos FROM customer) p JOIN observations o ON o.id = p.id")
def cli_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by lists of ids, each with its place in the list."""
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(c.alias("ask"), F.posexplode(F.array(c % 97, c % 13, c % 200)).alias("pos", "id"))
    return asked.join(observations(spark, sf_dir).select("id", "kind"), "id").select("ask", "pos", "id", "kind")


@query("SELECT id, coalesce(nullif(d.kind, 'note'), p.new_kind) AS kind, coalesce(d.last_used, p.seen) IS NOT NULL AS used FROM observations d LEFT JOIN (SELECT p_partkey AS pid, p_type AS new_kind, TIMESTAMP '2024-01-01' AS seen FROM part WHERE p_size > 25) p ON p.pid = d.id")
def cli_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill only what is missing from a second table."""
    p = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("pid"), F.col("p_type").alias("new_kind"), F.to_timestamp(F.lit("2024-01-01")).alias("seen"))
    joined = observations(spark, sf_dir).select("id", "kind", "last_used").join(p, F.col("id") == F.col("pid"), "left")
    return joined.select("id", F.coalesce(F.nullif("kind", F.lit("note")), "new_kind").alias("kind"), F.coalesce("last_used", "seen").isNotNull().alias("used"))


@query("""SELECT id, list_aggregate(list_filter([CASE WHEN quarantined THEN 'quarantined' END, CASE WHEN state = 'soft-archived' THEN 'archived' END, CASE WHEN label = 'ignore' THEN 'low_importance' END, CASE WHEN length(summary) > 4800 THEN 'over_budget' END, CASE WHEN trust = 'quarantined' THEN 'trust' END, 'considered'], lambda x: x IS NOT NULL), 'string_agg', ',') AS reasons,
    NOT quarantined AND state <> 'soft-archived' AND length(summary) <= 4800 AND trust <> 'quarantined' AS included FROM observations""")
def cli_pack_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each candidate is or isn't in a pack: all reasons, in order."""
    long, q, archived, trust = F.length("summary") > 4800, F.col("quarantined"), F.col("state") == "soft-archived", F.col("trust") == "quarantined"
    reasons = F.array_compact(F.array(F.when(q, "quarantined"), F.when(archived, "archived"), F.when(F.col("label") == "ignore", "low_importance"), F.when(long, "over_budget"), F.when(trust, "trust"), F.lit("considered")))
    return observations(spark, sf_dir).select("id", F.array_join(reasons, ",").alias("reasons"), (~q & ~archived & ~long & ~trust).alias("included"))


@query(f"""WITH {BM25_SQL} SELECT l.query_id, d.source AS project, count(*) AS support, round(sum(l.score), 4) AS score, row_number() OVER (PARTITION BY l.query_id ORDER BY count(*) DESC, round(sum(l.score), 4) DESC, d.source) AS place FROM lex l JOIN documents d ON d.doc_id = l.id GROUP BY 1, 2""")
def cli_project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects (sources) by the hits that support them."""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    by = lexical_lane(spark, sf_dir).join(sources, "id").groupBy("query_id", "project").agg(F.count(F.lit(1)).alias("support"), F.round(F.sum("score"), 4).alias("score"))
    return ranking.ranked(by, by=[F.desc("support"), F.desc("score"), F.col("project")], groups=["query_id"], name="place").withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {BM25_SQL} SELECT b.item_id, max(CASE WHEN d.source = 'src' || (b.item_id % 20) THEN 1 ELSE 0 END)::BIGINT AS hit, min(CASE WHEN d.source = 'src' || (b.item_id % 20) THEN l.rank END) AS first_rank FROM benchmark b JOIN lex l ON l.query_id = b.item_id AND l.rank <= 10 JOIN documents d ON d.doc_id = l.id GROUP BY 1""")
def eval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the expected source among the first ten hits of each question?"""
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    hits = lexical_lane(spark, sf_dir, 10).join(sources, "id")
    right = F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return hits.groupBy(F.col("query_id").alias("item_id")).agg(F.max(F.when(right, 1).otherwise(0)).cast("long").alias("hit"), F.min(F.when(right, F.col("rank"))).cast("long").alias("first_rank"))


@query("""WITH g AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS o FROM lineitem WHERE l_quantity > 20), p AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS o FROM lineitem WHERE l_quantity > 30 OR l_discount > 0.08), x AS (SELECT coalesce(g.o, p.o) AS o, g.s IS NOT NULL AS gold, p.s IS NOT NULL AS found FROM g FULL JOIN p ON g.s = p.s AND g.o = p.o)
    SELECT o AS object, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (found AND NOT gold) AS fp, count(*) FILTER (gold AND NOT found) AS fn, round(count(*) FILTER (gold AND found) * 1.0 / count(*) FILTER (found), 6)::DOUBLE AS precision, round(count(*) FILTER (gold AND found) * 1.0 / count(*) FILTER (gold), 6)::DOUBLE AS recall FROM x GROUP BY 1""")
def eval_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted statements against expected ones: true and false positives, precision and recall."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("s"), F.col("l_returnflag").alias("object")).agg(F.max(F.col("l_quantity") > 20).alias("gold"), F.max((F.col("l_quantity") > 30) | (F.col("l_discount") > 0.08)).alias("found"))
    tp, found, gold = F.count_if(F.col("gold") & F.col("found")), F.count_if("found"), F.count_if("gold")
    return li.where("gold or found").groupBy("object").agg(
        tp.alias("tp"), F.count_if(F.col("found") & ~F.col("gold")).alias("fp"), F.count_if(F.col("gold") & ~F.col("found")).alias("fn"), F.round(tp / found, 6).alias("precision"), F.round(tp / gold, 6).alias("recall")
    )


@query("""WITH t AS (SELECT session_id, turn, length(summary)::BIGINT AS chars, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back FROM turns), u AS (SELECT *, sum(chars) OVER (PARTITION BY session_id ORDER BY back) AS held FROM t) SELECT session_id, turn, back <= 2 AS protected FROM u WHERE back <= 2 OR held <= 3000""")
def win_prompt_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns that fit 3,000 characters; the last two always stay."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    t = turns(spark, sf_dir).select("session_id", "turn", F.length("summary").cast("long").alias("chars"), back.alias("back"))
    held = F.sum("chars").over(Window.partitionBy("session_id").orderBy("back"))
    return t.withColumn("held", held).where("back <= 2 or held <= 3000").select("session_id", "turn", (F.col("back") <= 2).alias("protected"))


@query("""WITH h AS (SELECT o_custkey AS ask, o_orderkey % 50 AS id, (o_orderkey * 13 % 997) / 997.0::DOUBLE AS score FROM orders), b AS (SELECT ask, id, max(score) AS score FROM h GROUP BY 1, 2) SELECT ask, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 3""")
def win_dedup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each id, and the three best ids of each question."""
    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ask"), (k % 50).alias("id")).agg(F.max(k * 13 % 997 / 997.0).alias("score"))
    return ranking.best(h, 3, by=[F.desc("score"), F.col("id")], groups=["ask"]).select("ask", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT s.scope AS ask, f.scope, f.ord FROM (SELECT DISTINCT scope FROM observations) s, LATERAL (SELECT s.scope AS scope, 0 AS ord UNION ALL SELECT 'src0', 1 UNION ALL SELECT 'src1', 2) f), h AS (SELECT p.ask, o.id, min(p.ord) AS ord FROM p JOIN observations o ON o.scope = p.scope WHERE o.label = 'ignore' AND o.state <> 'soft-archived' GROUP BY 1, 2)
    SELECT ask, id, ord::BIGINT AS ord, place FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY ord, id DESC) AS place FROM h) WHERE place <= 5""")
def win_scoped_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows for each scope, from itself first and then from two fallback scopes."""
    o = observations(spark, sf_dir).select("id", "scope", "label", "state")
    plan = o.select(F.col("scope").alias("ask")).distinct().select("ask", F.posexplode(F.array("ask", F.lit("src0"), F.lit("src1"))).alias("ord", "scope"))
    hits = o.where("label = 'ignore' and state <> 'soft-archived'").join(plan, "scope").groupBy("ask", "id").agg(F.min("ord").cast("long").alias("ord"))
    return ranking.best(hits, 5, by=[F.col("ord"), F.desc("id")], groups=["ask"]).select("ask", "id", "ord", F.col("rank").cast("long").alias("place"))


@query("""WITH b AS (SELECT src AS near, * FROM edges WHERE type <> 'contains' UNION ALL SELECT dst, * FROM edges WHERE type <> 'contains'), s AS (SELECT node_id AS start FROM nodes WHERE node_type = 'supplier'), h1 AS (SELECT s.start, b.*, 1 AS depth FROM s JOIN b ON b.near = s.start),
    f1 AS (SELECT DISTINCT start, n FROM (SELECT start, src AS n FROM h1 UNION ALL SELECT start, dst FROM h1) WHERE n <> start), h2 AS (SELECT f1.start, b.*, 2 AS depth FROM f1 JOIN b ON b.near = f1.n), u AS (SELECT start, src, dst, type, provenance, min(depth) AS depth FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2, 3, 4, 5)
    SELECT start, src, dst, type, depth::BIGINT AS depth, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, src, dst, type, provenance) AS n FROM u) WHERE n <= 40""")
def grf_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two undirected steps around every supplier, at most forty edges each, nearest first."""
    e = edges(spark, sf_dir).where("type <> 'contains'")
    starts = nodes(spark, sf_dir).where("node_type = 'supplier'").select(F.col("node_id").alias("start"), "node_id")
    out = graph.nearest_edges(e, starts, 40)
    return out.select("start", "src", "dst", "type", "depth", F.col("rank").cast("long").alias("place"))


@query("""SELECT fact_id, CASE WHEN nxt IS NOT NULL AND (valid_to IS NULL OR valid_to > nxt) THEN 'closed' ELSE 'as_is' END AS change, CAST(epoch(CASE WHEN nxt IS NOT NULL AND (valid_to IS NULL OR valid_to > nxt) THEN nxt ELSE valid_to END) AS BIGINT) AS valid_to FROM (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, fact_id) AS nxt FROM facts WHERE status = 'active')""")
def fct_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each new value of a single-valued predicate closes the one before it."""
    after = F.lead("valid_from").over(Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id"))
    f = facts(spark, sf_dir).where("status = 'active'").withColumn("nxt", after)
    close = F.col("nxt").isNotNull() & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("nxt")))
    return f.select("fact_id", F.when(close, "closed").otherwise("as_is").alias("change"), F.unix_timestamp(F.when(close, F.col("nxt")).otherwise(F.col("valid_to"))).alias("valid_to"))


@query("""WITH snap AS (SELECT o_orderkey AS fact_id, md5(o_orderstatus) AS d, 'order' AS kind FROM orders UNION ALL SELECT o_orderkey, md5(CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE o_orderpriority END), 'prio' FROM orders), live AS (SELECT o_orderkey AS fact_id, md5(o_orderstatus) AS d, 'order' AS kind FROM orders UNION ALL SELECT o_orderkey, md5(o_orderpriority), 'prio' FROM orders)
    SELECT f.fact_id, CASE WHEN f.status = 'active' AND bool_or(s.d <> l.d) THEN 'stale' ELSE f.status END AS status FROM facts f JOIN snap s ON s.fact_id = f.fact_id JOIN live l ON l.fact_id = s.fact_id AND l.kind = s.kind GROUP BY f.fact_id, f.status""")
def fct_effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact is stale once the digest of any of its sources has changed."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    digest = lambda c: F.md5(c.cast("binary"))
    of = lambda prio: F.explode(F.array(F.struct(F.lit("order").alias("kind"), digest(F.col("o_orderstatus")).alias("d")), F.struct(F.lit("prio").alias("kind"), digest(prio).alias("d")))).alias("s")
    snap = o.select(k.alias("fact_id"), of(F.when(k % 41 == 0, "x").otherwise(F.col("o_orderpriority")))).select("fact_id", "s.kind", F.col("s.d").alias("then"))
    live = o.select(k.alias("fact_id"), of(F.col("o_orderpriority"))).select("fact_id", "s.kind", F.col("s.d").alias("today"))
    changed = snap.join(live, ["fact_id", "kind"]).groupBy("fact_id").agg(F.bool_or(F.col("then") != F.col("today")).alias("changed"))
    return facts(spark, sf_dir).select("fact_id", "status").join(changed, "fact_id").select("fact_id", F.when((F.col("status") == "active") & F.col("changed"), "stale").otherwise(F.col("status")).alias("status"))


@query("""WITH f AS (SELECT fact_id, subject, object, valid_from, fact_id - 4 AS old FROM facts), dead AS (SELECT DISTINCT old FROM f WHERE fact_id % 6 = 0) SELECT f.fact_id, CASE WHEN d.old IS NOT NULL THEN 'superseded' WHEN f.valid_from < TIMESTAMP '1996-01-01' THEN 'stale' WHEN contains(f.subject, '11') OR contains('customer:1100', f.subject) THEN 'active' ELSE 'not_applicable' END AS class FROM f LEFT JOIN dead d ON d.old = f.fact_id""")
def fct_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that bear on a target: superseded and old ones are told apart first."""
    f = facts(spark, sf_dir).select("fact_id", "subject", "valid_from")
    dead = f.where("fact_id % 6 = 0").select((F.col("fact_id") - 4).alias("old")).distinct()
    applies = F.contains("subject", F.lit("11")) | F.contains(F.lit("customer:1100"), F.col("subject"))
    kind = F.when(F.col("old").isNotNull(), "superseded").when(F.col("valid_from") < F.to_timestamp(F.lit("1996-01-01")), "stale").when(applies, "active").otherwise("not_applicable")
    return f.join(dead, F.col("fact_id") == F.col("old"), "left").select("fact_id", kind.alias("class"))


@query(f"""SELECT o.id, o.used_count + coalesce(r.n, 0) AS used_count, CAST(epoch(CASE WHEN r.n > 0 THEN TIMESTAMP '{NOW}' ELSE o.last_used END) AS BIGINT) AS last_used FROM observations o LEFT JOIN (SELECT ref, count(DISTINCT receipt_id) AS n FROM receipts WHERE ts >= TIMESTAMP '2001-06-01' GROUP BY 1) r ON r.ref = o.id""")
def pck_use_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use counts after recent selections, written as new rows."""
    n = receipts(spark, sf_dir).where(F.col("ts") >= F.to_timestamp(F.lit("2001-06-01"))).groupBy("ref").agg(F.count_distinct("receipt_id").alias("n"))
    o = observations(spark, sf_dir).select("id", "used_count", "last_used").join(n, F.col("id") == F.col("ref"), "left")
    return o.select("id", (F.col("used_count") + F.coalesce("n", F.lit(0))).alias("used_count"), F.unix_timestamp(F.when(F.col("n") > 0, now()).otherwise(F.col("last_used"))).alias("last_used"))


@query(rf"""WITH q AS (SELECT item_id, trim(lower(coalesce(text, ''))) AS phrase, list_distinct(regexp_extract_all({_LOWER.format('text')}, '[a-z0-9_]{{3,}}')) AS terms FROM benchmark), t AS (SELECT item_id, phrase, len(terms) AS n, unnest(terms) AS term FROM q),
    d AS (SELECT doc_id, length(text) AS chars, unnest(list_distinct(regexp_extract_all({_LOWER.format('text')}, '[a-z0-9_]{{3,}}'))) AS term FROM documents), c AS (SELECT t.item_id, t.phrase, d.doc_id, count(*) * 1.0 / max(t.n) AS part, least(max(d.chars), 5000) AS chars FROM t JOIN d USING (term) GROUP BY 1, 2, 3),
    m AS (SELECT item_id, c.doc_id, round(part + CASE WHEN contains(lower(x.text), phrase) THEN 0.25 ELSE 0 END - c.chars / 1000000.0, 6)::DOUBLE AS score FROM c JOIN documents x ON x.doc_id = c.doc_id) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 5""")
def ret_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the share of a question's terms they have, and a quarter more if they hold it as it stands; shorter ones first among equals."""
    words = lambda: F.array_distinct(F.regexp_extract_all(text.ascii_lower(F.col("text")), F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    q = items.select("item_id", words().alias("terms")).select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    d = lexical.only_asked(docs.select("doc_id", F.length("text").alias("chars"), F.explode(words()).alias("term")), q, "term")
    part = d.join(q, "term").groupBy("item_id", "doc_id").agg((F.count(F.lit(1)) / F.max("n")).alias("part"), F.least(F.max("chars"), F.lit(5000)).alias("chars"))
    held = trigrams.scanned(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("query_id"), F.trim("text").alias("text")))
    both = part.join(held, (F.col("item_id") == F.col("query_id")) & (F.col("doc_id") == F.col("id")), "left")
    m = both.select("item_id", "doc_id", F.round(F.col("part") + F.when(F.col("id").isNotNull(), 0.25).otherwise(0.0) - F.col("chars") / 1000000.0, 6).alias("score"))
    return ranking.best(m, 5, by=[F.desc("score"), F.col("doc_id")], groups=["item_id"]).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT n_name AS name, lower(replace(n_name, '_', ' ')) AS alias FROM nation), q AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'nation ' || s_nationkey WHEN 1 THEN 'about nation ' || s_nationkey || ' please' WHEN 2 THEN 'nation' ELSE 'supplier only' END AS t FROM supplier),
    s AS (SELECT q.id, c.name, CASE WHEN c.alias = q.t THEN 1.0 WHEN contains(' ' || q.t || ' ', ' ' || c.alias || ' ') THEN 0.88 WHEN contains(q.t, 'nation') THEN 0.5 ELSE 0 END::DOUBLE AS score FROM q CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, name) AS second FROM s WHERE score > 0)
    SELECT q.id, CASE WHEN r.id IS NULL THEN 'unresolved' WHEN r.second >= r.score - 0.05 THEN 'ambiguous' WHEN r.score < 0.74 THEN 'low_confidence' ELSE 'resolved' END AS status, r.name FROM q LEFT JOIN r ON r.id = q.id AND r.k = 1""")
def ret_project_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in questions resolved to one of a list of candidates; near ties stay ambiguous.

    A candidate meets a question through a shared word, so no pair without one is made.
    """
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    asked = F.when(k % 4 == 0, F.concat(F.lit("nation "), n)).when(k % 4 == 1, F.concat(F.lit("about nation "), n, F.lit(" please"))).when(k % 4 == 2, "nation").otherwise("supplier only")
    q = table(spark, sf_dir, "supplier").select(k.alias("id"), asked.alias("t"))
    alias = F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))
    c = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), alias.alias("alias"), F.explode(F.array_distinct(F.split(alias, " "))).alias("word"))
    met = q.select("id", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).join(c, "word").groupBy("id", "t", "name", "alias").agg(F.count(F.lit(1)).alias("shared"), F.max(F.when(F.col("word") == "nation", 1).otherwise(0)).alias("kind"))
    inside = F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))
    score = F.when(F.col("alias") == F.col("t"), 1.0).when(inside, 0.88).otherwise(F.least(F.lit(0.72), F.col("kind") / 2.0))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "name")
    r = met.withColumn("score", score).where("score > 0").withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("k = 1").select(F.col("id").alias("rid"), "name", "score", "second")
    status = F.when(F.col("rid").isNull(), "unresolved").when(F.col("second") >= F.col("score") - 0.05, "ambiguous").when(F.col("score") < 0.74, "low_confidence").otherwise("resolved")
    return q.select("id").join(r, F.col("id") == F.col("rid"), "left").select("id", status.alias("status"), "name")


_SHAPES = """CASE event_id % 6 WHEN 0 THEN '{"result_count": ' || (event_id % 9) || '}' WHEN 1 THEN '{"results": [1, 2, ' || event_id || ']}' WHEN 2 THEN '{"details": {"results": "' || (event_id % 7) || '"}}' WHEN 3 THEN '{"receipt": {"lifecycle": {"selectedTotal": ' || (event_id % 5) || '}}}' WHEN 4 THEN '{"receipt": {"lifecycle": {"selected_counts": {"a": 2, "b": ' || (event_id % 4) || '}}}}' ELSE 'not json' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id % 9 WHEN 1 THEN 3 WHEN 2 THEN event_id % 7 WHEN 3 THEN event_id % 5 WHEN 4 THEN 2 + event_id % 4 END::BIGINT AS n FROM events""")
def jsn_recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of results of a recall, wherever its record keeps it: a count, a list, nested, or a map to be summed."""
    v = F.try_parse_json(F.expr(_SHAPES))
    whole = lambda path: F.try_variant_get(v, path, "string").try_cast("bigint")
    listed = lambda path: F.size(F.try_variant_get(v, path, "array<variant>"))
    summed = F.aggregate(F.map_values(F.try_variant_get(v, "$.receipt.lifecycle.selected_counts", "map<string,bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    length = F.when(F.try_variant_get(v, "$.results", "array<variant>").isNotNull(), listed("$.results")).cast("bigint")
    n = F.coalesce(whole("$.result_count"), length, whole("$.details.results"), whole("$.receipt.lifecycle.selectedTotal"), summed)
    return table(spark, sf_dir, "events").select("event_id", n.alias("n"))


@query(r"""SELECT event_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(summary, '<[^>]*>', ' ', 'g'), '[\x00-\x08\x0E-\x1F]', '', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS clean, nullif(regexp_extract(summary, '\b(\d{4})[-_](\d{2})[-_](\d{2})\b', 0), '') AS date_hint, trim(regexp_replace(translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM turns""")
def str_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without tags and control characters, their first date and a slug."""
    s = F.col("summary")
    clean = text.squeeze(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"[\x00-\x08\x0E-\x1F]", ""))
    slug = F.btrim(F.regexp_replace(text.ascii_lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    return turns(spark, sf_dir).select("event_id", F.md5(clean.cast("binary")).alias("clean"), F.nullif(F.regexp_extract(s, r"\b(\d{4})[-_](\d{2})[-_](\d{2})\b", 0), F.lit("")).alias("date_hint"), slug.alias("slug"))


@query(r"""WITH t AS (SELECT session_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(translate(summary, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9À-ɏ]+', ' ', 'g'), ' +'), lambda x: x <> '')) AS w FROM turns), p AS (SELECT session_id, turn, w, lag(w) OVER (PARTITION BY session_id ORDER BY turn) AS b FROM t)
    SELECT session_id, turn, CASE WHEN len(w) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(w, b)) * 1.0 / (len(w) + len(b) - len(list_intersect(w, b))), 6) END::DOUBLE AS jaccard FROM p WHERE b IS NOT NULL""")
def str_turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of its words each turn shares with the one before it."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(text.ascii_lower(F.col("summary")), "[^a-z0-9À-ɏ]+", " "), " +"), lambda x: x != ""))
    t = turns(spark, sf_dir).select("session_id", "turn", words.alias("w"))
    p = t.withColumn("b", F.lag("w").over(Window.partitionBy("session_id").orderBy("turn"))).where("b is not null")
    return p.select("session_id", "turn", F.round(text.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


@query("""SELECT node_type AS module, count(*) AS n, min(node_id) AS first_id, count(DISTINCT tag) AS tags, (SELECT count(*) FROM edges e WHERE starts_with(e.src, node_type || ':')) AS out_edges FROM nodes GROUP BY node_type""")
def snk_module_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules (node types) with their sizes and outgoing edges."""
    out = edges(spark, sf_dir).groupBy(F.substring_index("src", ":", 1).alias("m")).agg(F.count(F.lit(1)).alias("out_edges"))
    n = nodes(spark, sf_dir).groupBy(F.col("node_type").alias("module")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first_id"), F.count_distinct("tag").alias("tags"))
    return n.join(out, F.col("module") == F.col("m"), "left").select("module", "n", "first_id", "tags", F.coalesce("out_edges", F.lit(0)).alias("out_edges"))


@query("""SELECT id, kind, CASE WHEN quarantined OR label = 'must_remember' THEN 'high' WHEN used_count >= 4 THEN 'medium' ELSE 'low' END AS risk, NOT quarantined AND label <> 'must_remember' AND used_count < 4 AND state IN ('stale', 'captured') AS auto_apply FROM observations WHERE state <> 'soft-archived'""")
def rev_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a change, by risk, with those that may be applied without review."""
    grave = F.col("quarantined") | (F.col("label") == "must_remember")
    risk = F.when(grave, "high").when(F.col("used_count") >= 4, "medium").otherwise("low")
    return observations(spark, sf_dir).where("state <> 'soft-archived'").select("id", "kind", risk.alias("risk"), (~grave & (F.col("used_count") < 4) & F.col("state").isin("stale", "captured")).alias("auto_apply"))


@query("""WITH n AS (SELECT trust, CASE trust WHEN 'trusted' THEN 2 WHEN 'untrusted' THEN 1 ELSE 0 END AS r, scope, id FROM observations) SELECT id, r <= 1 AND scope IN ('src1', 'src2') OR r <= 1 AND scope = 'src0' AS admitted FROM n""")
def pck_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an untrusted caller with scopes src1 and src2 may read; src0 stands for global."""
    rank = scoring.looked_up(TRUST_RANK, F.col("trust"), 0)
    return observations(spark, sf_dir).select("id", ((rank <= TRUST_RANK["untrusted"]) & F.col("scope").isin("src0", "src1", "src2")).alias("admitted"))
