"""What changes over time: entries said again, harvests, patches and their undoing."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, json_walk, lexical, patches, recall, trigrams
from ..operators.graph import ensure_checkpoint_dir
from ..sources import readers
from ..streaming import dedupe, harvest
from .registry import query
from .views import observations, table

#: Twenty documents stand for the entries of an hour, a language for a scope.
_AN_HOUR = 20


@query(f"""WITH RECURSIVE e AS (SELECT coalesce(lang, '') AS scope, doc_id AS id, doc_id // {_AN_HOUR} * 3600 AS sec, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<[^>]+>', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS form FROM documents),
    n AS (SELECT *, list_distinct(string_split(form, ' ')) AS ws, row_number() OVER (PARTITION BY scope ORDER BY sec, id, form) AS i FROM e),
    s AS (SELECT scope, 0::BIGINT AS i, CAST([] AS STRUCT(sec BIGINT, form VARCHAR, ws VARCHAR[])[]) AS kept, NULL::BIGINT AS id FROM (SELECT DISTINCT scope FROM n) UNION ALL
    SELECT n.scope, n.i, CASE WHEN x.again THEN s.kept ELSE list_concat(s.kept, [struct_pack(sec := n.sec, form := n.form, ws := n.ws)])[-{dedupe.RECENT}:] END, CASE WHEN x.again THEN NULL ELSE n.id END
    FROM s JOIN n ON n.scope = s.scope AND n.i = s.i + 1, LATERAL (SELECT len(list_filter(s.kept, lambda k: n.sec - k.sec <= {dedupe.HOURS * 3600} AND n.form <> '' AND k.form <> '' AND (n.form = k.form
        OR (least(length(n.form), length(k.form)) >= {dedupe.PART_CHARS} AND (contains(n.form, k.form) OR contains(k.form, n.form)))
        OR len(list_intersect(n.ws, k.ws)) >= {dedupe.SIMILARITY} * (len(n.ws) + len(k.ws) - len(list_intersect(n.ws, k.ws)))))) > 0 AS again) x)
    SELECT scope, id FROM s WHERE id IS NOT NULL""")
def stm_dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language without those near to one kept in the 24 hours before, the latest 64 kept ones compared."""
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("lang").alias("scope"), F.timestamp_seconds(F.floor(F.col("doc_id") / _AN_HOUR) * 3600).alias("ts"), F.col("doc_id").alias("id"), "text")
    return dedupe.first_in_window(e).select("scope", "id")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_LABEL = "CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'must_remember' ELSE 'ignore' END"


@query(f"""SELECT d.doc_id, CASE WHEN d.doc_id < (SELECT avg(doc_id) FROM documents) THEN 0 ELSE 1 END AS batch, CASE WHEN regexp_matches(lower(d.source), '^[a-z0-9._:/-]+$') THEN lower(d.source) END AS scope, {_LABEL} AS label,
    sha256(trim(coalesce(d.text, ''))) AS hash, trim(coalesce(d.text, '')) <> '' AS has_vector, '{{"doc_id":' || d.doc_id || CASE WHEN l.quality IS NULL THEN '' ELSE ',"importance":{{"score":' || CASE WHEN l.quality = 1 THEN '0.9' ELSE '0.1' END || '}}' END || ',"scope":"' || d.source || '"}}' AS detail
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def stm_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in an inbox, taken in by two runs, the second with the rest of the files: rows, labels, merged details and whether each text has its vector."""
    d, quality = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), "quality")
    score = F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.1)
    line = F.to_json(F.struct(F.col("text").alias("summary"), F.when(score.isNotNull(), F.struct(F.struct(score.alias("score")).alias("importance"))).alias("detail"), "doc_id", F.col("source").alias("scope")))
    lines = d.join(quality, F.col("doc_id") == F.col("i"), "left").select("doc_id", line.alias("value"))
    middle = d.agg(F.avg("doc_id")).first()[0]
    inbox, store = _folder(spark, "inbox"), _folder(spark, "store")
    for part in (lines.where(F.col("doc_id") < F.lit(middle)), lines.where(F.col("doc_id") >= F.lit(middle))):
        part.select("value").write.mode("append").text(inbox)
        harvest.harvest(spark, inbox, store, files_per_batch=1 << 20)
    own = harvest.Store(spark, store)
    vectors = own.vectors.read().select(F.col("hash").alias("h"), F.lit(True).alias("found"))
    rows = own.observations.read().join(vectors, F.col("hash") == F.col("h"), "left")
    return rows.select(
        F.get_json_object("detail", "$.doc_id").cast("long").alias("doc_id"), F.split_part("id", F.lit("-"), F.lit(1)).cast("int").alias("batch"), "scope", "label", "hash",
        F.coalesce("found", F.lit(False)).alias("has_vector"), "detail",
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_VECTORS = f"""w AS (SELECT id, unnest({_WORDS}) AS word FROM t), m AS (SELECT id, word, count(*) AS n FROM w GROUP BY ALL), h AS (SELECT id, n, unnest([0, 1]) AS b, md5(word || ':' || unnest([0, 1])) AS d FROM m),
    x AS (SELECT id, b * 8 + k AS k, sum(n * (('0x' || d[4 * k + 1:4 * k + 4])::BIGINT * 2 - 65535)) / 65535.0::DOUBLE AS v FROM h, (SELECT unnest(range(8)) AS k) GROUP BY id, b * 8 + k)"""


@query(f"""WITH t AS (SELECT doc_id AS id, text FROM documents), {_VECTORS} SELECT id, round(sqrt(sum(v * v)), 6) AS norm, round(max(v), 9) AS largest, CAST(arg_max(k, struct_pack(v := v, k := -k)) AS INTEGER) AS at FROM x GROUP BY id""")
def udf_text_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of whole texts: length, largest number and its place; texts without words have none."""
    v = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.text_vector(F.col("text"), 16).alias("v")).where("exists(v, x -> x <> 0)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("id", F.round(norm, 6).alias("norm"), F.round(F.array_max("v"), 9).alias("largest"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("at"))


@query(f"""WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {_VECTORS}, z AS (SELECT id, sqrt(sum(v * v)) AS norm FROM x GROUP BY id),
    c AS (SELECT -1 - q.id AS query_id, d.id, round(sum(q.v * d.v) / any_value(zq.norm) / any_value(zd.norm), 9) AS score FROM x q JOIN x d ON d.k = q.k AND q.id < 0 AND d.id >= 0 JOIN z zq ON zq.id = q.id JOIN z zd ON zd.id = d.id GROUP BY q.id, d.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def ret_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a question's text to its five nearest documents, both by hashed vectors."""
    embed = lambda rows, name: rows.select(F.col(rows.columns[0]).alias(name), text.text_vector(F.col("text"), 16).alias("vector")).where("exists(vector, x -> x <> 0)")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    ensure_checkpoint_dir(spark)
    # A search reads its vectors more than once; they are written, so that each text is read once.
    hits = recall.recall(docs, asked, vectors=embed(docs, "id").checkpoint(), asked_vectors=embed(asked, "query_id"), mode="vector", k=5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH o AS (SELECT id, trim(coalesce(summary, '')) AS s, score, scope FROM observations)
    SELECT id, CASE WHEN s = '' THEN 'empty text' END AS error, CASE WHEN s <> '' THEN coalesce(score, 0.0) END AS importance, CASE WHEN s <> '' THEN CASE WHEN coalesce(score, 0.0) >= 0.8 THEN 'must_remember' WHEN coalesce(score, 0.0) >= 0.5 THEN 'nice_to_have' ELSE 'ignore' END END AS label,
    CASE WHEN s <> '' THEN sha256('- [FACT] ' || s || ' (importance: ' || printf('%.2f', coalesce(score, 0.0)) || ', ' || CASE WHEN coalesce(score, 0.0) >= 0.8 THEN 'must_remember' WHEN coalesce(score, 0.0) >= 0.5 THEN 'nice_to_have' ELSE 'ignore' END || ')') END AS line FROM o""")
def src_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What storing each observation by hand would append: label, Markdown line (its digest) or error."""
    o = observations(spark, sf_dir).select("id", F.col("summary").alias("text"), F.lit("fact").alias("category"), F.coalesce("score", F.lit(0.0)).alias("importance"), "scope")
    kept = harvest.remember(o, keep=("id",))
    return kept.select("id", "error", "importance", "label", F.sha2(F.col("markdown").cast("binary"), 256).alias("line"))


_DETAILS = """d AS (SELECT id, label, state, '{"importance":{"label":"' || label || '"' || CASE WHEN score IS NULL THEN '' ELSE ',"score":' || CAST(round(score * 100) AS INTEGER) END || '}}' AS detail, coalesce(score < 0.3, false) AS low, state = 'stale' AND (label <> 'must_remember' OR coalesce(score < 0.3, false)) AS old FROM observations)"""


@query(f"""WITH {_DETAILS} SELECT id, CASE WHEN low AND old THEN '{{"importance":{{"label":"ignore","method":"optimize_assist","score":' || CAST(regexp_extract(detail, '"score":([0-9]+)', 1) AS INTEGER) || '}},"lifecycle":{{"archive_reason_code":"stale_low_importance","archived_at":"2024-06-01"}}}}'
    WHEN low THEN '{{"importance":{{"label":"ignore","method":"optimize_assist","score":' || CAST(regexp_extract(detail, '"score":([0-9]+)', 1) AS INTEGER) || '}}}}'
    WHEN old THEN left(detail, length(detail) - 1) || ',"lifecycle":{{"archive_reason_code":"stale_low_importance","archived_at":"2024-06-01"}}}}' ELSE detail END AS detail FROM d""")
def opt_assist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details after five runs: labels of low scores changed, stale records archived, that undone and done again, and an undoing of the first run that is refused as later runs touched its records."""
    o = observations(spark, sf_dir).select("id", "label", "score", "state")
    score = F.when(F.col("score").isNotNull(), F.concat(F.lit(',"score":'), F.round(F.col("score") * 100).cast("int").cast("string")))
    base = o.select("id", F.concat(F.lit('{"importance":{"label":"'), F.col("label"), F.lit('"'), F.coalesce(score, F.lit("")), F.lit("}}")).alias("detail"), "score", "state")
    log = patches.log(spark, _folder(spark, "assist"))
    offer = lambda rows, action, patch: rows.select(
        F.concat(F.lit(f"{action}-"), F.col("id").cast("string")).alias("proposal_id"), "id", F.lit(action).alias("action"), F.lit(patches.APPROVED).alias("decision"), F.lit(patches.LANE).alias("lane"),
        F.lit(patch).alias("patch"), F.lit(None).cast("string").alias("expected_sha256"),
    )
    labels = offer(base.where("score < 0.3"), "adjust_importance_score", '{"importance": {"label": "ignore", "method": "optimize_assist"}}')
    old = offer(base.where("state = 'stale'"), "set_soft_archive_candidate", '{"lifecycle": {"archived_at": "2024-06-01", "archive_reason_code": "stale_low_importance"}}')
    many = 1 << 60
    free, now = patches.Limits(many, many, many, many, 9), datetime(2024, 6, 1)
    base = base.select("id", "detail")
    patches.apply(log, base, labels, run=0, now=now, limits=free)
    patches.apply(log, base, old, run=1, now=now, limits=free)
    patches.undo(log, base, 1, run=2, now=now)
    patches.apply(log, base, old, run=3, now=now, limits=free)
    patches.undo(log, base, 0, run=4, now=now)
    return patches.current(base, log.read())


_PHRASES = r"""SELECT item_id * 2 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string((regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))[2:3], ' ') FROM benchmark"""


@query(rf"""WITH q AS (SELECT query_id, lower(text) AS phrase FROM ({_PHRASES}) WHERE length(text) >= 3), d AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS body FROM documents)
    SELECT query_id, id, len(list_filter(range(1, length(body) - length(phrase) + 2), lambda i: body[i:i + length(phrase) - 1] = phrase))::BIGINT AS n FROM q JOIN d ON contains(body, phrase)""")
def ret_trigram_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, and their second and third words, as phrases in whole documents, by an index that is stored first."""
    b = table(spark, sf_dir, "benchmark")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    asked = b.select((F.col("item_id") * 2).alias("query_id"), "text").union(b.select(F.col("item_id") * 2 + 1, F.array_join(F.slice(words, 2, 2), " ")))
    index = trigrams.TrigramIndex(spark, _folder(spark, "trigrams"))
    index.write(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return index.matches(asked.where(F.length("text") >= trigrams.SIZE))


_TREE = """'{"refs": ["obs:' || user_id || '", {"x": [" obs:' || event_id || ' ", "obs:' || event_id || 'z"]}], "obs:1": "said \\"obs:2\\"", "props": ' || props || '}'"""


@query(f"""SELECT DISTINCT event_id AS id, CAST(regexp_extract(trim(j.atom ->> '$'), '^obs:(\\d+)$', 1) AS BIGINT) AS ref FROM (SELECT event_id, {_TREE} AS detail FROM events WHERE json_valid(props)) e, json_tree(e.detail) j
    WHERE j.type = 'VARCHAR' AND regexp_full_match(trim(j.atom ->> '$'), 'obs:\\d+')""")
def jsn_reference_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that whole strings of a nested detail are, at any depth; keys and quoted ones within strings don't count."""
    e = table(spark, sf_dir, "events").where(F.try_parse_json("props").isNotNull())
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    detail = F.concat(F.lit('{"refs": ["obs:'), u, F.lit('", {"x": [" obs:'), i, F.lit(' ", "obs:'), i, F.lit('z"]}], "obs:1": "said \\"obs:2\\"", "props": '), F.col("props"), F.lit("}"))
    return json_walk.references(e.select(F.col("event_id").alias("id"), detail.alias("detail")))


@query("""WITH e AS (SELECT *, event_type <> 'error' AS healthy FROM events), bad AS (SELECT user_id, max(struct_pack(ts := ts, id := event_id)) AS bad FROM e WHERE NOT healthy GROUP BY 1),
    s AS (SELECT e.user_id, count(*) FILTER (b.bad IS NULL OR struct_pack(ts := e.ts, id := e.event_id) > b.bad) AS streak FROM e LEFT JOIN bad b ON b.user_id = e.user_id GROUP BY 1),
    w AS (SELECT user_id, round(avg(CASE WHEN value >= 20 THEN 1 ELSE 0 END), 4) AS ratio FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY 1),
    l AS (SELECT user_id, count(*) AS runs, count(*) FILTER (value > 100) AS mutations FROM e WHERE event_type = 'click' GROUP BY 1),
    m AS (SELECT user_id, count(*) AS groups FROM (SELECT user_id, props FROM e WHERE event_type = 'view' AND value < 15 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
    x AS (SELECT s.user_id AS subject, s.streak, coalesce(w.ratio, 0.0) AS ratio, coalesce(l.runs, 0) AS runs, coalesce(l.mutations, 0) AS mutations, coalesce(m.groups, 0) AS groups FROM s LEFT JOIN w USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN m USING (user_id)),
    b AS (SELECT *, list_filter([CASE WHEN streak < 3 THEN 'live_green_streak_below_threshold' END, CASE WHEN runs < 2 THEN 'lifecycle_runs_below_threshold' END, CASE WHEN ratio < 0.3 THEN 'writeback_eligible_ratio_below_threshold' END, CASE WHEN mutations > 0 THEN 'lifecycle_mutation_not_shadow' END], lambda r: r IS NOT NULL) AS rb FROM x),
    c AS (SELECT *, list_filter([CASE WHEN len(rb) > 0 THEN 'stage_b_not_ready' END, CASE WHEN runs < 2 THEN 'lifecycle_runs_below_threshold' END, CASE WHEN groups > 1 THEN 'repeated_miss_pressure_high' END], lambda r: r IS NOT NULL) AS rc FROM b)
    SELECT subject, CASE WHEN len(rb) = 0 THEN 'ready' ELSE 'hold' END AS stage_b, array_to_string(rb, ',') AS reasons_b, CASE WHEN len(rc) = 0 THEN 'ready' ELSE 'hold' END AS stage_c, array_to_string(rc, ',') AS reasons_c, CAST(ratio AS DOUBLE) AS eligible_ratio, streak FROM c""")
def opt_policy_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage gates of each user: events are checks (errors fail), purchases and sign-ups writes, clicks shadow runs, views of little value misses."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "subject")
    of = lambda *types: e.where(F.col("event_type").isin(*types))
    out = gates.policy_loop(
        e.select("subject"), e.select("subject", "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("healthy")), of("purchase", "signup").select("subject", (F.col("value") >= 20).alias("eligible")),
        of("click").select("subject", F.when(F.col("value") > 100, "archived").otherwise("none").alias("mutation")), of("view").where("value < 15").select("subject", F.col("props").alias("query")), gates.Thresholds(3, 2, 2, 0.3, 2, 1),
    )
    return out.withColumns({c: F.array_join(c, ",") for c in ("reasons_b", "reasons_c")})


_ASCII_WORDS = "list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{3,}'))"


@query(f"""WITH q AS (SELECT item_id AS query_id, text, {_ASCII_WORDS} AS words, list_filter([CASE WHEN regexp_matches(text, '(?i)tion') THEN 'A' END, CASE WHEN regexp_matches(text, '(?i)ei.*ung') THEN 'B' END], lambda x: x IS NOT NULL) AS found FROM benchmark),
    n AS (SELECT count(*) AS docs FROM documents), p AS (SELECT word, count(*) * 1.0::DOUBLE / any_value(docs) AS weight FROM (SELECT unnest({_ASCII_WORDS}) AS word FROM documents), n GROUP BY word),
    s AS (SELECT query_id, sum(weight) AS total FROM (SELECT query_id, unnest(words) AS word FROM q WHERE len(found) = 0) u JOIN p USING (word) GROUP BY 1),
    x AS (SELECT q.query_id, q.found, CASE WHEN len(found) = 0 THEN round(coalesce(total, 0) / greatest(len(words), 1), 6) END AS score FROM q LEFT JOIN s USING (query_id))
    SELECT query_id, CASE WHEN len(found) > 0 THEN 'keyword:' || array_to_string(found, '+') WHEN score >= 0.03 THEN 'probe_strong' WHEN score >= 0.01 THEN 'probe_weak' ELSE 'off' END AS reason, len(found) > 0 OR score >= 0.03 AS fires, score FROM x""")
def cli_graph_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark questions may ask the graph: by their wording, else by how common their words are in the documents."""
    words = F.array_distinct(F.regexp_extract_all(text.ascii_lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]{3,}"), F.lit(0)))
    docs = table(spark, sf_dir, "documents")
    probe = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("docs")))).select("word", (F.col("n") / F.col("docs")).alias("weight"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return gates.graph_auto(asked, {"A": "tion", "B": "ei.*ung"}, probe, words=words, strong=0.03, weak=0.01)


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(upper(x), '\[SECRET\]|\[PRIVATE\]|\[NOEXPORT\]|\[NOMEM\]')) AS xs FROM documents),
    r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS cur, 0::BIGINT AS next, 0::BIGINT AS own FROM p UNION ALL SELECT r.doc_id, r.i + 1, CASE WHEN n > {readers.CHUNK_CHARS} THEN 0 WHEN over THEN n + 2 ELSE cur + n + 2 END, next + over::BIGINT + (n > {readers.CHUNK_CHARS})::BIGINT, next + over::BIGINT
        FROM r JOIN p ON p.doc_id = r.doc_id AND r.i < len(xs), LATERAL (SELECT length(xs[r.i + 1]) AS n) a, LATERAL (SELECT cur > 0 AND cur + n + 2 > {readers.CHUNK_CHARS} AS over) b),
    x AS (SELECT r.doc_id, i, own, xs[i] AS x FROM r JOIN p ON p.doc_id = r.doc_id WHERE i > 0),
    c AS (SELECT doc_id, own, 0 AS k, string_agg(x, chr(10) || chr(10) ORDER BY i) AS text FROM x WHERE length(x) <= {readers.CHUNK_CHARS} GROUP BY 1, 2 UNION ALL
        SELECT doc_id, own, k, regexp_replace(substr(x, (k * {readers.CHUNK_CHARS} + 1)::INTEGER, {readers.CHUNK_CHARS}), '^\s+|\s+$', '', 'g') FROM (SELECT *, unnest(range((length(x) - 1) // {readers.CHUNK_CHARS} + 1)) AS k FROM x WHERE length(x) > {readers.CHUNK_CHARS}))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY own, k) - 1 AS INTEGER) AS ordinal, length(text) AS chars, sha256(text) AS digest FROM c WHERE text <> ''""")
def src_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of whole paragraphs (a line stands for one), as the walk through a workspace cuts its files."""
    chunks = readers.paragraph_chunks(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")))
    return chunks.select("doc_id", "ordinal", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_NAMED = "list_distinct(list_filter(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+(?:#[0-9]+)?'), lambda w: length(w) >= 3))"


@query(f"""WITH s AS (SELECT item_id AS query_id, 'need obs#' || (item_id * 10 + 3) || ' ' || text AS query FROM benchmark), l AS (SELECT doc_id // 10 AS query_id, doc_id AS id, '- obs#' || doc_id || ' ' || lang || ' :: ' || replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents)
    SELECT query_id, id, (CASE WHEN query LIKE '%obs#' || id || ' %' THEN 10 ELSE 0 END + len(list_filter(list_intersect({_NAMED.format('query')}, {_NAMED.format('line')}), lambda w: NOT starts_with(w, 'obs#'))))::BIGINT AS score FROM s JOIN l USING (query_id)""")
def cli_named_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of ten documents each, one a line, ranked against the benchmark's questions by the id that a question names and by shared words."""
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("- obs#"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit(" :: "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    # Ten lines make a snippet.
    snippets = d.groupBy(F.expr("doc_id div 10").alias("q")).agg(F.array_join(F.collect_list(line), "\n").alias("snippet"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("need obs#"), (F.col("item_id") * 10 + 3).cast("string"), F.lit(" "), "text").alias("query"))
    return lexical.named_ids(asked.join(snippets, F.col("query_id") == F.col("q")).select("query_id", "query", "snippet"))
