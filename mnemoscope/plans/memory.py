"""Gates, text shapes, packs, graph bundles, facts and reviews of a memory store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking
from .filters_joins import USEFUL_TOKENS_SQL, useful_tokens
from .registry import query
from .views import NOW, days_before_now, edges, facts, nodes, now, observations, receipts, table, turns

PROBLEM_WORDS = r"error|failed|exception|panic"
CLIP = "\n…\n"


# Filters


@query("SELECT id, coalesce(nullif(CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'global' ELSE scope END, ''), 'global') AS held FROM observations WHERE coalesce(CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'global' ELSE scope END, 'global') = 'global' AND label IN ('must_remember', 'unknown')")
def flt_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the global scope by label; a missing scope counts as global."""
    held = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, "global").otherwise(F.col("scope"))
    o = observations(spark, sf_dir).select("id", "label", F.coalesce(held, F.lit("global")).alias("held"))
    return o.where("held = 'global' and label in ('must_remember', 'unknown')").select("id", "held")


def doc_in_scope(repo: Column, path: Column, scope: Column, strategy: str, prefixes: Column | None = None) -> Column:
    """Whether a document belongs to a scope, by ``none``, ``repo_prefix``, ``path_prefix`` or ``map`` (an array of prefixes)."""
    repo, path = F.lower(F.coalesce(repo, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    every = scope.isNull() | scope.isin("", "global")
    starts = lambda p: F.startswith(path, F.concat(p, F.lit("/")))
    if strategy == "repo_prefix":
        key = F.element_at(F.split(scope, "[:/]"), -1)
        own = (key == "") | (repo == key) | starts(key)
    elif strategy == "path_prefix":
        prefix = F.replace(scope, F.lit(":"), F.lit("/"))
        own = starts(prefix) | (path == prefix) | F.contains(path, F.concat(F.lit("/"), prefix, F.lit("/")))
    elif strategy == "map":
        own = F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda p: (repo == p) | starts(p) | (path == p))
    else:
        own = F.lit(True)
    return every | own


@query("""SELECT page_id AS id, h = 'site0' OR starts_with(p, 'site0/') AS by_repo, starts_with(p, 'team/docs/') OR p = 'team/docs' OR contains(p, '/team/docs/') AS by_path, h = 'site1' OR starts_with(p, 'wiki/') OR h = 'wiki' OR p = 'wiki' OR p = 'site1' OR starts_with(p, 'site1/') AS by_map
    FROM (SELECT page_id, 'site' || (page_id % 3) AS h, CASE page_id % 4 WHEN 0 THEN 'wiki/a' WHEN 1 THEN 'x/team/docs/b' WHEN 2 THEN 'site0/c' ELSE 'd' END AS p FROM pages)""")
def flt_doc_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a scope by three strategies; pages stand for documents of a repository."""
    i = F.col("page_id")
    repo = F.concat(F.lit("site"), i % 3)
    path = F.when(i % 4 == 0, "wiki/a").when(i % 4 == 1, "x/team/docs/b").when(i % 4 == 2, "site0/c").otherwise("d")
    return table(spark, sf_dir, "pages").select(
        i.alias("id"), doc_in_scope(repo, path, F.lit("proj/site0"), "repo_prefix").alias("by_repo"), doc_in_scope(repo, path, F.lit("team:docs"), "path_prefix").alias("by_path"),
        doc_in_scope(repo, path, F.lit("wiki"), "map", F.array(F.lit("wiki"), F.lit("site1"))).alias("by_map"),
    )


#: Every third turn gets one of these in front: marks, and words that are none.
_MARKS = ("<private>", "</Private> ", "[noexport] ", "see [PRIVATE] ", "[NoMem]", "private: ", "a private matter ", "[deny] ", "")


@query(f"""SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {list(_MARKS)}[event_id % {len(_MARKS)} + 1] ELSE '' END || summary AS s FROM turns)
    WHERE NOT (contains(lower(s), '<private>') OR contains(lower(s), '</private>') OR contains(lower(s), '[noexport]') OR contains(lower(s), '[private]') OR contains(lower(s), '[nomem]') OR contains(upper(s), 'PRIVATE:'))""")
def flt_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without a mark that keeps them private."""
    mark = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("event_id") % len(_MARKS) + 1).cast("int"))).otherwise("")
    return turns(spark, sf_dir).withColumn("summary", F.concat(mark, "summary")).where(~text.is_private(F.col("summary"))).select("event_id")


@query("SELECT src, dst, type FROM edges WHERE trim(provenance) <> '' AND contains(provenance, '#L')")
def flt_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that name a source and a place in it."""
    p = text.provenance(F.col("provenance"))
    return edges(spark, sf_dir).where((F.trim("provenance") != "") & (p["kind"] == "file_line")).select("src", "dst", "type")


@query("SELECT id FROM observations WHERE contains(lower(summary), 'license') OR contains(lower(kind), 'plan') OR contains(lower(scope), 'wiki') OR contains(lower(label), 'remember')")
def flt_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which one of four columns holds its asked term, whatever the case."""
    asked = {"summary": "license", "kind": "plan", "scope": "wiki", "label": "remember"}
    hit = reduce(Column.__or__, (F.contains(F.lower(c), F.lit(term)) for c, term in asked.items()))
    return observations(spark, sf_dir).where(hit).select("id")


@query("SELECT id, ts, rank FROM (SELECT id, epoch(ts)::BIGINT AS ts, row_number() OVER (ORDER BY ts DESC, id DESC) AS rank FROM observations WHERE kind = 'decision') WHERE rank <= 20")
def flt_timeline_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty rows of a kind."""
    o = observations(spark, sf_dir).where("kind = 'decision'").select("kind", "id", F.unix_timestamp("ts").alias("ts"))
    return ranking.best(o, 20, by=[F.desc("ts"), F.desc("id")], groups=["kind"]).select("id", "ts", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {USEFUL_TOKENS_SQL} SELECT a.event_id AS left_id, b.event_id AS right_id, count(*) AS shared FROM useful a JOIN useful b
    ON a.session_id = b.session_id AND a.token = b.token AND a.event_id < b.event_id WHERE a.session_id % 100 = 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def jon_session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of one asked session (ids divisible by 100) with two shared useful tokens or more."""
    t = useful_tokens(spark, sf_dir).where("session_id % 100 = 0").select("session_id", "token", "event_id")
    other = t.select("session_id", "token", F.col("event_id").alias("right_id"))
    pairs = t.join(other, ["session_id", "token"]).where("event_id < right_id")
    return pairs.groupBy(F.col("event_id").alias("left_id"), "right_id").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query("SELECT n.node_id, e.type, count(*) AS n, min(e.dst) AS first_dst FROM nodes n JOIN edges e ON e.src = n.node_id WHERE n.node_type IN ('nation', 'order') AND n.node_id NOT LIKE '%9' GROUP BY 1, 2")
def grf_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asked nodes point to: for each kind of edge how many targets, and the least."""
    asked = nodes(spark, sf_dir).where("node_type in ('nation', 'order') and node_id not like '%9'").select("node_id")
    return edges(spark, sf_dir).join(asked, F.col("src") == F.col("node_id")).groupBy("node_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first_dst"))


# Text and JSON


@query("SELECT doc_id AS id, length(text) > 600 AS clipped, md5(CASE WHEN length(text) > 600 THEN substr(text, 1, 400) || chr(10) || '…' || chr(10) || right(text, 197) ELSE text END) AS digest FROM documents")
def str_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of at most 600 characters: the first 400, a mark and the end, where more was there."""
    tail = 600 - 400 - len(CLIP)
    cut = F.concat(F.substring("text", 1, 400), F.lit(CLIP), F.substring("text", -tail, tail))
    clamped = F.when(F.length("text") > 600, cut).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.length("text") > 600).alias("clipped"), F.md5(clamped.cast("binary")).alias("digest"))


_PARTS_SQL = r"""list_filter(list_transform({0}, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"""
_SPLIT_SQL = f"""b AS (SELECT event_id, summary, {_PARTS_SQL.format("regexp_split_to_array(summary, chr(10) || '+')")} AS lines FROM turns),
    c AS (SELECT event_id, CASE WHEN len(lines) > 1 THEN lines ELSE {_PARTS_SQL.format("string_split(regexp_replace(summary, '([.!?。！？])[ \t\n\r\f\v]+', '\\1' || chr(1), 'g'), chr(1))")} END[1:16] AS parts FROM b)"""


def split_candidates(body: Column, *, most: int = 16) -> Column:
    """Lines, or the sentences of a single line, trimmed and not empty; the first ``most``."""
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x, F.lit(" \t\n\r\f\x0b"))), lambda x: x != "")
    lines = trimmed(F.split(body, r"\n+"))
    return F.slice(F.when(F.size(lines) > 1, lines).otherwise(trimmed(F.split(body, r"(?<=[.!?。！？])\s+"))), 1, most)


@query(f"WITH {_SPLIT_SQL} SELECT event_id, i AS position, md5(parts[i]) AS digest FROM (SELECT event_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM c)")
def str_capture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = turns(spark, sf_dir).select("event_id", F.posexplode(split_candidates(F.col("summary"))).alias("position", "part"))
    return parts.select("event_id", (F.col("position") + 1).cast("long").alias("position"), F.md5(F.col("part").cast("binary")).alias("digest"))


@query("""SELECT session_id, count(*) AS questions, min(line) AS first_line FROM (SELECT DISTINCT session_id, line FROM (SELECT session_id, trim(regexp_replace(unnest(string_split(CASE WHEN session_id % 2 = 0 THEN replace(summary, '.', '?') ELSE summary END, chr(10))), '[ \t\r\f\v]+', ' ', 'g')) AS line FROM turns
    WHERE type = 'conversation.user') WHERE contains(line, '?') OR contains(line, '？')) GROUP BY 1""")
def str_open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of a session's user turns with a question mark: how many, and the least. Even sessions ask where the table ends a sentence."""
    asked = F.when(F.col("session_id") % 2 == 0, F.replace("summary", F.lit("."), F.lit("?"))).otherwise(F.col("summary"))
    lines = turns(spark, sf_dir).where("type = 'conversation.user'").select("session_id", F.explode(F.split(asked, "\n")).alias("line"))
    asked = lines.select("session_id", text.squeeze(F.col("line")).alias("line")).where(F.contains("line", F.lit("?")) | F.contains("line", F.lit("？"))).distinct()
    return asked.groupBy("session_id").agg(F.count(F.lit(1)).alias("questions"), F.min("line").alias("first_line"))


@query("""WITH r AS (SELECT user_id, props, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type FROM events WHERE json_valid(props)),
    k AS (SELECT DISTINCT user_id, unnest(json_keys(props)) AS key FROM r)
    SELECT r.user_id, count(*) AS row_count, (SELECT string_agg(key, ', ' ORDER BY key) FROM k WHERE k.user_id = r.user_id) AS fields, count(*) FILTER (event_type = 'error') AS anomalies, greatest(0, count(*) - least(3, count(*)) * 2 - count(*) FILTER (event_type = 'error')) AS omitted FROM r GROUP BY 1""")
def str_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each user's JSON rows: how many, which fields, how many look like problems, how many a summary of 3 + 3 leaves out."""
    rows = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull()).select("user_id", F.json_object_keys("props").alias("keys"), F.lower("event_type").rlike(PROBLEM_WORDS).alias("bad"))
    fields = rows.select("user_id", F.explode("keys").alias("key")).distinct().groupBy(F.col("user_id").alias("u")).agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("fields"))
    sums = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_if("bad").alias("anomalies"))
    n = F.col("row_count")
    omitted = F.greatest(F.lit(0), n - F.least(F.lit(3), n) * 2 - F.col("anomalies"))
    return sums.join(fields, F.col("user_id") == F.col("u")).select("user_id", "row_count", "fields", "anomalies", omitted.cast("long").alias("omitted"))


@query("""WITH m AS (SELECT item_id AS query_id, 'src/' || d.source AS path, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id % 50 = b.item_id % 50), h AS (SELECT query_id, path, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT query_id, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM h) WHERE rank <= 8""")
def str_search_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results by path: the eight paths with most matches of each question."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50).alias("slot"))
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("slot"), F.concat(F.lit("src/"), "source").alias("path"))
    # Counted before they meet, so that the join is of counts.
    found = b.join(d.groupBy("slot", "path").agg(F.count(F.lit(1)).alias("n")), "slot").select("query_id", "path", "n")
    return ranking.best(found, 8, by=[F.desc("n"), F.col("path")], groups=["query_id"]).select("query_id", "path", "n", F.col("rank").cast("long").alias("rank"))


_DETAIL = """'{"lifecycle": {' || CASE event_id % 4 WHEN 0 THEN '"state": " Stale "' WHEN 1 THEN '"archived_at": "2024-01-01"' WHEN 2 THEN '"state": "odd", "archived_at": " "' ELSE '"refs": ["obs:' || user_id || '", {"x": "obs:' || event_id || '"}]' END || '}}'"""


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, detail): JSON of a lifecycle, made from events."""
    i = F.col("event_id")
    inner = (
        F.when(i % 4 == 0, '"state": " Stale "').when(i % 4 == 1, '"archived_at": "2024-01-01"').when(i % 4 == 2, '"state": "odd", "archived_at": " "')
        .otherwise(F.concat(F.lit('"refs": ["obs:'), "user_id", F.lit('", {"x": "obs:'), i, F.lit('"}]')))
    )
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"lifecycle": {'), inner, F.lit("}}")).alias("detail"))


@query(f"""SELECT event_id, CASE WHEN s IN ('active', 'captured', 'categorized', 'consolidated', 'stale', 'soft-archived') THEN s WHEN trim(coalesce(a, '')) <> '' THEN 'soft-archived' ELSE 'active' END AS state
    FROM (SELECT event_id, lower(trim(coalesce(json_extract_string(d, '$.lifecycle.state'), ''))) AS s, json_extract_string(d, '$.lifecycle.archived_at') AS a FROM (SELECT event_id, {_DETAIL} AS d FROM events))""")
def jsn_lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a JSON detail names; an archiving time without one means soft-archived, nothing means active."""
    get = lambda n: F.coalesce(F.get_json_object("detail", f"$.lifecycle.{n}"), F.lit(""))
    said = F.lower(F.trim(get("state")))
    known = said.isin("active", "captured", "categorized", "consolidated", "stale", "soft-archived")
    return _details(spark, sf_dir).select("event_id", F.when(known, said).when(F.trim(get("archived_at")) != "", "soft-archived").otherwise("active").alias("state"))


@query(f"""SELECT event_id, CAST(unnest(list_distinct(regexp_extract_all(d, '"obs:(\\d+)"', 1))) AS BIGINT) AS ref FROM (SELECT event_id, {_DETAIL} AS d FROM events)""")
def jsn_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to observations anywhere in a JSON detail, each once."""
    refs = F.array_distinct(F.regexp_extract_all("detail", F.lit(r'"obs:(\d+)"'), F.lit(1)))
    return _details(spark, sf_dir).select("event_id", F.explode(refs).alias("ref")).select("event_id", F.col("ref").cast("long").alias("ref"))


@query("""SELECT fact_id, 'fact_' || substr(sha256('{"object":"' || object || '","predicate":"' || predicate || '","subject":"' || subject || '","valid_from":"' || strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') || '"}'), 1, 20) AS stable_id FROM facts""")
def jsn_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id from a fact's canonical JSON: sorted keys, no spaces."""
    f = facts(spark, sf_dir)
    body = F.to_json(F.struct("object", "predicate", "subject", F.date_format("valid_from", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from")))
    return f.select("fact_id", F.concat(F.lit("fact_"), F.substring(F.sha2(body.cast("binary"), 256), 1, 20)).alias("stable_id"))


# Packs and recall


@query("""WITH c AS (SELECT scope, id, CASE label WHEN 'must_remember' THEN 0 WHEN 'nice_to_have' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS tier, length(summary) AS chars FROM observations),
    p AS (SELECT s.scope AS asked, s.scope, 0 AS step FROM (SELECT DISTINCT scope FROM observations) s UNION ALL SELECT s.scope, f.scope, 1 FROM (SELECT DISTINCT scope FROM observations) s CROSS JOIN (SELECT min(scope) AS scope FROM observations) f WHERE s.scope <> f.scope),
    r AS (SELECT asked, id, step, tier, row_number() OVER (PARTITION BY asked ORDER BY step, tier, chars DESC, id) AS rank FROM p JOIN c USING (scope)) SELECT asked AS scope, id, step, tier, rank FROM r WHERE rank <= 12""")
def win_policy_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by policy: the own scope first, then a fallback scope; in each, must and nice, then unknown, then the rest."""
    tier = F.when(F.col("label").isin("must_remember", "nice_to_have"), 0).when(F.col("label") == "unknown", 1).otherwise(2)
    c = observations(spark, sf_dir).select("scope", "id", tier.alias("tier"), F.length("summary").alias("chars"))
    # A scope's best twelve are all that any plan can take from it.
    c = ranking.best(c, 12, by=[F.col("tier"), F.desc("chars"), F.col("id")], groups=["scope"]).drop("rank").checkpoint()
    scopes = c.select(F.col("scope").alias("asked")).distinct()
    own = scopes.select("asked", F.col("asked").alias("scope"), F.lit(0).alias("step"))
    first = scopes.agg(F.min("asked").alias("scope"))
    fallback = scopes.crossJoin(F.broadcast(first)).where("asked <> scope").select("asked", "scope", F.lit(1).alias("step"))  # one row
    hits = own.unionByName(fallback).join(c, "scope").select("asked", "id", "step", "tier", "chars")
    best = ranking.best(hits, 12, by=[F.col("step"), F.col("tier"), F.desc("chars"), F.col("id")], groups=["asked"])
    return best.select(F.col("asked").alias("scope"), "id", "step", "tier", F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT doc_id AS id, strlen(text) AS raw, least(strlen(text), 40 + 8 * length(regexp_replace(text, '[^\n]', '', 'g'))) AS packed, doc_id % 9 = 0 AS denied FROM documents)
    SELECT id, CASE WHEN packed >= raw OR (packed + 3) // 4 >= (raw + 3) // 4 THEN 'blocked' WHEN denied THEN 'blocked' ELSE 'packed' END AS decision,
    CASE WHEN packed >= raw OR (packed + 3) // 4 >= (raw + 3) // 4 THEN 'not-smaller' WHEN denied THEN 'admission-denied' ELSE 'stored-and-packed' END AS reason FROM p""")
def pck_artifact_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is stored and packed: only if the packed form is smaller in bytes and tokens, and admission allows it."""
    raw = F.octet_length("text").cast("long")
    packed = F.least(raw, 40 + 8 * F.regexp_count("text", F.lit("\n")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), raw.alias("raw"), packed.alias("packed"), (F.col("doc_id") % 9 == 0).alias("denied"))
    larger = (F.col("packed") >= F.col("raw")) | (F.floor((F.col("packed") + 3) / 4) >= F.floor((F.col("raw") + 3) / 4))
    reason = F.when(larger, "not-smaller").when(F.col("denied"), "admission-denied").otherwise("stored-and-packed")
    return d.select("id", F.when(reason == "stored-and-packed", "packed").otherwise("blocked").alias("decision"), reason.alias("reason"))


@query("""WITH a AS (SELECT scope, id, trust, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank FROM observations),
    b AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank FROM observations WHERE trust NOT IN ('quarantined', 'untrusted'))
    SELECT coalesce(x.scope, y.scope) AS scope, count(x.id) AS without_policy, count(y.id) AS with_policy, count(*) FILTER (y.id IS NULL) AS removed, count(*) FILTER (x.id IS NULL) AS added
    FROM (SELECT * FROM a WHERE rank <= 10) x FULL JOIN (SELECT * FROM b WHERE rank <= 10) y ON x.scope = y.scope AND x.id = y.id GROUP BY 1""")
def pck_policy_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same selection with and without the trust policy, compared."""
    o = observations(spark, sf_dir).select("scope", "id", "trust", F.length("summary").alias("chars"))
    top = lambda df, name: ranking.best(df, 10, by=[F.desc("chars"), F.col("id")], groups=["scope"]).select("scope", "id", F.lit(1).alias(name))
    both = top(o, "a").join(top(o.where("trust not in ('quarantined', 'untrusted')"), "b"), ["scope", "id"], "full")
    return both.groupBy("scope").agg(F.count("a").alias("without_policy"), F.count("b").alias("with_policy"), F.count_if(F.expr("b is null")).alias("removed"), F.count_if(F.expr("a is null")).alias("added"))


@query(f"""WITH t AS (SELECT event_id, scope, {"lower(trim(regexp_replace(summary, '[^0-9A-Za-z一-鿿]+', ' ', 'g')))"} AS body, session_id AS hour FROM turns)
    SELECT event_id, scope, hour FROM (SELECT *, lag(hour) OVER (PARTITION BY scope, md5(body) ORDER BY hour, event_id) AS before FROM t) WHERE before IS NULL OR hour - before >= 24""")
def stm_todo_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a scope without those that say the same as an entry less than 24 hours before; a session's number stands for its hour."""
    t = turns(spark, sf_dir).select("event_id", "scope", F.md5(text.fingerprint(F.col("summary")).cast("binary")).alias("body"), F.col("session_id").alias("hour"))
    before = F.lag("hour").over(Window.partitionBy("scope", "body").orderBy("hour", "event_id"))
    return t.withColumn("before", before).where("before is null or hour - before >= 24").select("event_id", "scope", "hour")


# Graph


@query("SELECT node_id, node_type FROM nodes WHERE node_id IN ('customer:1', 'part:2') OR tag = 'EUROPE' OR lower(tag) = 'brand#17'")
def grf_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by their name (the tag, whatever the case) or their full name."""
    wanted = F.col("node_id").isin("customer:1", "part:2") | F.lower("tag").isin("europe", "brand#17")
    return nodes(spark, sf_dir).where(wanted).select("node_id", "node_type")


@query("""WITH hit AS (SELECT * FROM edges WHERE starts_with(provenance, 'customer.md#')) SELECT n.node_id, n.node_type, count(*) AS edges FROM nodes n JOIN (SELECT src AS node_id FROM hit UNION ALL SELECT dst FROM hit) h ON h.node_id = n.node_id GROUP BY 1, 2""")
def grf_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that edges of one file touch, with how many."""
    hit = edges(spark, sf_dir).where(F.startswith("provenance", F.lit("customer.md#")))
    touched = hit.select("src").union(hit.select("dst")).groupBy(F.col("src").alias("t")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes(spark, sf_dir).join(touched, F.col("node_id") == F.col("t")).select("node_id", "node_type", "edges")


@query("""SELECT e.dst AS centre, 'node ' || n.node_id || ' [' || n.node_type || ']' AS line FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.type = 'part_of'
    UNION ALL SELECT dst, 'edge ' || src || ' -' || type || '-> ' || dst || ' (' || provenance || ')' FROM edges WHERE type = 'part_of'""")
def grf_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A neighbourhood as lines of text, one for each node and edge; rows, so that a hub isn't one long string."""
    near = edges(spark, sf_dir).where("type = 'part_of'")
    line = F.concat(F.lit("node "), "node_id", F.lit(" ["), "node_type", F.lit("]"))
    of_nodes = near.join(nodes(spark, sf_dir), F.col("src") == F.col("node_id")).select(F.col("dst").alias("centre"), line.alias("line"))
    arrow = F.concat(F.lit("edge "), "src", F.lit(" -"), "type", F.lit("-> "), "dst", F.lit(" ("), "provenance", F.lit(")"))
    return of_nodes.unionByName(near.select(F.col("dst").alias("centre"), arrow.alias("line")))


@query("""WITH plain AS (SELECT node_id, row_number() OVER (PARTITION BY node_type ORDER BY tag, node_id) AS rank, node_type FROM nodes WHERE node_type IN ('nation', 'supplier')),
    d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
    graph AS (SELECT node_id, node_type, row_number() OVER (PARTITION BY node_type ORDER BY coalesce(degree, 0) DESC, node_id) AS rank FROM nodes LEFT JOIN d ON node = node_id WHERE node_type IN ('nation', 'supplier'))
    SELECT coalesce(p.node_id, g.node_id) AS node_id, p.rank AS plain_rank, g.rank AS graph_rank FROM (SELECT * FROM plain WHERE rank <= 10) p FULL JOIN (SELECT * FROM graph WHERE rank <= 10) g ON p.node_id = g.node_id""")
def grf_search_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search without and with the graph (by degree), side by side."""
    n = nodes(spark, sf_dir).where("node_type in ('nation', 'supplier')")
    e = edges(spark, sf_dir)
    degree = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = lambda df, by, name: ranking.best(df, 10, by=by, groups=["node_type"]).select("node_id", F.col("rank").cast("long").alias(name))
    plain = top(n, [F.col("tag"), F.col("node_id")], "plain_rank")
    linked = n.join(degree, F.col("node_id") == F.col("node"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return plain.join(top(linked, [F.desc("degree"), F.col("node_id")], "graph_rank"), "node_id", "full")


# Facts


@query(f"""SELECT fact_id, subject, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE valid_to END AS valid_to, CASE WHEN hit THEN 'invalidated' ELSE status END AS status FROM (SELECT *, fact_id % 100 = 0 AND status = 'active' AS hit FROM facts)""")
def fct_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts after asked ones (ids divisible by 100) that are active are invalidated as of now; nothing else changes."""
    hit = (F.col("fact_id") % 100 == 0) & (F.col("status") == "active")
    return facts(spark, sf_dir).select("fact_id", "subject", F.when(hit, now()).otherwise(F.col("valid_to")).alias("valid_to"), F.when(hit, "invalidated").otherwise(F.col("status")).alias("status"))


@query("""WITH q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'what of customer:' || c_custkey || ' now' WHEN 1 THEN 'what of customer:' || (c_custkey + 1000000) ELSE 'what now' END AS text FROM customer),
    s AS (SELECT query_id, nullif(regexp_extract(text, '(customer:\\d+)', 1), '') AS subject FROM q), cur AS (SELECT subject, count(*) AS n FROM facts WHERE status = 'active' AND valid_to IS NULL GROUP BY 1)
    SELECT query_id, s.subject, n IS NOT NULL AS used, CASE WHEN s.subject IS NULL THEN 'no_subject_detected' WHEN n IS NULL THEN 'unknown_subject_or_no_current_facts' ELSE 'fact_view' END AS reason, coalesce(n, 0) AS n_facts FROM s LEFT JOIN cur ON cur.subject = s.subject""")
def fct_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a subject with current facts go to the fact view, others elsewhere, with the reason."""
    k = F.col("c_custkey")
    known, unknown = F.concat(F.lit("what of customer:"), k, F.lit(" now")), F.concat(F.lit("what of customer:"), k + 1_000_000)
    q = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.when(k % 3 == 0, known).when(k % 3 == 1, unknown).otherwise("what now").alias("text"))
    q = q.select("query_id", F.nullif(F.regexp_extract("text", r"(customer:\d+)", 1), F.lit("")).alias("subject"))
    current = facts(spark, sf_dir).where("status = 'active' and valid_to is null").groupBy(F.col("subject").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(F.col("subject").isNull(), "no_subject_detected").when(F.col("n").isNull(), "unknown_subject_or_no_current_facts").otherwise("fact_view")
    return q.join(current, F.col("subject") == F.col("s"), "left").select("query_id", "subject", F.col("n").isNotNull().alias("used"), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("n_facts"))


# Reviews and tools


@query("""WITH c AS (SELECT subject AS claim, max(valid_from) AS latest, count(*) AS n FROM facts WHERE status = 'active' GROUP BY 1), r AS (SELECT 'customer:' || o_custkey AS claim, count(*) AS releases, max(o_orderkey) AS last_release FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c.claim, n AS facts, coalesce(releases, 0) AS releases, last_release, releases IS NOT NULL AS released FROM c LEFT JOIN r ON r.claim = c.claim""")
def rev_claim_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current claims with the receipts that released them; subjects of active facts stand for claims, finished orders for receipts."""
    c = facts(spark, sf_dir).where("status = 'active'").groupBy(F.col("subject").alias("claim")).agg(F.count(F.lit(1)).alias("facts"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.concat(F.lit("customer:"), "o_custkey").alias("r")).agg(F.count(F.lit(1)).alias("releases"), F.max("o_orderkey").alias("last_release"))
    return c.join(done, F.col("claim") == F.col("r"), "left").select("claim", "facts", F.coalesce("releases", F.lit(0)).alias("releases"), "last_release", F.col("releases").isNotNull().alias("released"))


@query("""WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY 1) SELECT user_id, 'contradiction_pressure' AS trigger, 'high' AS severity, errors AS evidence FROM t WHERE errors * 5 >= n AND errors >= 3
    UNION ALL SELECT user_id, 'no_op_stability', 'low', n FROM t WHERE errors = 0""")
def rev_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that patterns set off: much error pressure, or none at all."""
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))
    row = lambda name, severity, n: ("user_id", F.lit(name).alias("trigger"), F.lit(severity).alias("severity"), F.col(n).alias("evidence"))
    return t.where("errors * 5 >= n and errors >= 3").select(*row("contradiction_pressure", "high", "errors")).unionByName(t.where("errors = 0").select(*row("no_op_stability", "low", "n")))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, 'https://' || regexp_extract(url, '://([^/]+)', 1) AS expected, CASE WHEN page_id % 5 = 0 THEN url END AS forbidden, url FROM pages)
    SELECT host, count(*) AS total, count(*) FILTER (starts_with(url, expected) AND (forbidden IS NULL OR forbidden <> url)) AS passed, count(*) FILTER (NOT starts_with(url, expected)) AS expected_mismatch, count(*) FILTER (forbidden = url) AS forbidden_selected FROM p GROUP BY 1""")
def rev_routing_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of a router by host: how many passed, missed the expected path or chose a forbidden one."""
    host = F.regexp_extract("url", "://([^/]+)", 1)
    p = table(spark, sf_dir, "pages").select(host.alias("host"), F.startswith("url", F.concat(F.lit("https://"), host)).alias("hit"), F.when(F.col("page_id") % 5 == 0, F.col("url")).alias("forbidden"), "url")
    bad = F.col("forbidden").isNotNull() & (F.col("forbidden") == F.col("url"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit") & ~bad).alias("passed"), F.count_if(~F.col("hit")).alias("expected_mismatch"), F.count_if(bad).alias("forbidden_selected"))


@query("""WITH m AS (SELECT scope, count(*) AS n, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (label = 'unknown') AS unknown, count(*) FILTER (length(summary) >= 2400) AS bloated FROM observations GROUP BY 1)
    SELECT scope, 'review_stale' AS advice, stale AS evidence FROM m WHERE stale * 10 >= n UNION ALL SELECT scope, 'label_more', unknown FROM m WHERE unknown * 2 >= n UNION ALL SELECT scope, 'split_long', bloated FROM m WHERE bloated * 10 >= n""")
def rev_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for a scope, each kind only where its evidence is enough."""
    o = observations(spark, sf_dir)
    m = o.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("state = 'stale'")).alias("stale"), F.count_if(F.expr("label = 'unknown'")).alias("unknown"), F.count_if(F.length("summary") >= 2400).alias("bloated"))
    advice = [("review_stale", "stale", 10), ("label_more", "unknown", 2), ("split_long", "bloated", 10)]
    rows = [F.when(F.col(c) * k >= F.col("n"), F.struct(F.lit(a).alias("advice"), F.col(c).alias("evidence"))) for a, c, k in advice]
    return m.select("scope", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select("scope", "x.advice", "x.evidence")


@query("SELECT o.id FROM observations o LEFT JOIN receipts r ON r.ref = o.id AND r.receipt_id % 500 = 0 WHERE regexp_matches(o.summary, '(?i)\\b(todo|task|must)\\b|\n') AND r.ref IS NULL")
def cli_new_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look like tasks (a marker, or a list of lines) and that no earlier state knows; each 500th receipt stands for the state."""
    known = receipts(spark, sf_dir).where("receipt_id % 500 = 0").select("ref").distinct()
    return observations(spark, sf_dir).where(F.col("summary").rlike(r"(?i)\b(todo|task|must)\b|\n")).join(known, F.col("id") == F.col("ref"), "left_anti").select("id")


@query("""SELECT user_id AS job, count(*) FILTER (event_type = 'error') AS failures, max(k) AS last_k FROM (SELECT user_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0""")
def cli_job_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with failures; a number that is written as a string counts as one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy(F.col("user_id").alias("job")).agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("k").alias("last_k")).where("failures > 0")


@query("""WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 10 = 0 THEN embedding[1:8] ELSE embedding END AS e FROM embeddings) SELECT label, count(*) FILTER (len(e) = d) AS usable, count(*) FILTER (len(e) <> d) AS skipped FROM v CROSS JOIN (SELECT max(len(embedding)) AS d FROM embeddings) GROUP BY 1""")
def cli_vector_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors of each model have the asked length; each tenth is cut, as an older model would leave it."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    dim = v.agg(F.max(F.size("embedding")).alias("d"))
    cut = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    sized = v.select("label", F.size(cut).alias("n")).crossJoin(F.broadcast(dim))  # one row
    return sized.groupBy("label").agg(F.count_if(F.expr("n = d")).alias("usable"), F.count_if(F.expr("n <> d")).alias("skipped"))


@query("""WITH h AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS base_rank FROM observations),
    s AS (SELECT scope, id, base_rank, CASE WHEN id % 3 = 0 THEN NULL ELSE (id * 37) % 101 END AS score FROM h WHERE base_rank <= 20)
    SELECT scope, id, base_rank, CASE WHEN score IS NULL THEN 'base' ELSE 'rerank' END AS stage, row_number() OVER (PARTITION BY scope ORDER BY score DESC NULLS LAST, base_rank) AS rank FROM s""")
def cli_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the order of scores from a second ranker; those it didn't score stay behind in their old order."""
    o = observations(spark, sf_dir).select("scope", "id", F.length("summary").alias("chars"))
    base = ranking.best(o, 20, by=[F.desc("chars"), F.col("id")], groups=["scope"]).withColumnRenamed("rank", "base_rank")
    scores = o.where("id % 3 <> 0").select(F.col("id").alias("i"), (F.col("id") * 37 % 101).alias("score"))
    hits = base.join(scores, F.col("id") == F.col("i"), "left")
    ordered = ranking.ranked(hits, by=[F.col("score").desc_nulls_last(), F.col("base_rank")], groups=["scope"])
    stage = F.when(F.col("score").isNull(), "base").otherwise("rerank")
    return ordered.select("scope", "id", F.col("base_rank").cast("long").alias("base_rank"), stage.alias("stage"), F.col("rank").cast("long").alias("rank"))


@query("""WITH seed AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY length(summary) DESC, id) AS rank FROM observations), near AS (SELECT DISTINCT s.scope, o.id, greatest(1, (length(o.summary) + 3) // 4) AS tokens FROM seed s JOIN observations o ON o.scope = s.scope AND o.id BETWEEN s.id - 2 AND s.id + 2 WHERE s.rank <= 5),
    run AS (SELECT *, sum(tokens) OVER (PARTITION BY scope ORDER BY id) AS upto FROM near) SELECT scope, id, tokens, upto FROM run WHERE upto <= 6000""")
def cli_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seed hits of each scope with their neighbours of the same scope, within a budget of tokens."""
    o = observations(spark, sf_dir).select("scope", "id", F.length("summary").alias("chars"), text.token_estimate(F.col("summary")).alias("tokens"))
    seeds = ranking.best(o, 5, by=[F.desc("chars"), F.col("id")], groups=["scope"])
    around = seeds.select("scope", F.explode(F.sequence(F.col("id") - 2, F.col("id") + 2)).alias("id")).distinct()
    near = around.join(o.select("scope", "id", "tokens"), ["scope", "id"])  # 25 rows a scope at most
    upto = F.sum("tokens").over(Window.partitionBy("scope").orderBy("id"))
    return near.select("scope", "id", "tokens", upto.alias("upto")).where("upto <= 6000")


@query("SELECT a.scope, count(*) AS n, count(*) FILTER (b.scope <> a.scope) AS leaks FROM observations a JOIN observations b ON b.id = a.id WHERE a.scope = b.scope OR b.scope = 'global' GROUP BY 1")
def cli_scope_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index by scope, and how many came from another one (none may)."""
    o = observations(spark, sf_dir).select("id", "scope")
    index = o.withColumnRenamed("scope", "held").withColumnRenamed("id", "i")
    met = o.join(index, (F.col("id") == F.col("i")) & ((F.col("scope") == F.col("held")) | (F.col("held") == "global")))
    return met.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("held <> scope")).alias("leaks"))


@query("""SELECT d.doc_id AS id, md5(d.text) AS fingerprint FROM documents d LEFT JOIN (SELECT DISTINCT md5(text) AS f FROM documents WHERE doc_id % 2 = 0) k ON k.f = md5(d.text) WHERE d.doc_id % 2 = 1 AND k.f IS NULL""")
def cli_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents (odd ids) whose text no captured one (even ids) has; capturing twice changes nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    known = d.where("doc_id % 2 = 0").select("fingerprint").distinct()
    return d.where("doc_id % 2 = 1").join(known, "fingerprint", "left_anti").select(F.col("doc_id").alias("id"), "fingerprint")


@query("""WITH c AS (SELECT src, dst, type, CASE WHEN hash_k = 0 THEN 'somewhere' ELSE provenance END AS provenance FROM (SELECT *, length(src) % 3 AS hash_k FROM edges WHERE type IN ('part_of', 'located_in'))), k AS (SELECT *, regexp_matches(provenance, '^[^#]+#L\\d+$') AS ok FROM c), t AS (SELECT type, bool_or(ok) AS any_ok FROM k GROUP BY 1)
    SELECT src, dst, k.type, ok FROM k JOIN t USING (type) WHERE ok OR NOT any_ok""")
def cli_pack_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph candidates with a structured source; a group that has none keeps all, so a pack is never empty for that."""
    e = edges(spark, sf_dir).where("type in ('part_of', 'located_in')")
    source = F.when(F.length("src") % 3 == 0, "somewhere").otherwise(F.col("provenance"))
    k = e.select("src", "dst", "type", (text.provenance(source)["kind"] == "file_line").alias("ok"))
    some = k.groupBy(F.col("type").alias("t")).agg(F.bool_or("ok").alias("some"))
    return k.join(some, F.col("type") == F.col("t")).where("ok or not some").select("src", "dst", "type", "ok")
